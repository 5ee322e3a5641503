"""Vector codes: codebooks of parts, trained in rounds with norm-of-sum bounds.

A vector is cut into parts; each part has a codebook whose entries move once a round. Every row keeps, for each group of entries, a lower bound on
its distance to the group and the round in which that bound was exact. The codebooks of all rounds are kept, so a bound is lowered by the
true net displacement of the entries since its round (the norm of the sum of their moves), not by the sum of the norms. Only groups whose bound
does not exceed the distance to the best entry so far are scanned again, exactly; the group of the row's last entry always is. Bounds are
rounded down, exact distances are whole numbers in doubles, so pruning never changes a result.

A round is one pass: rows with their bounds go to a table in the shared folder, and each task adds one row of sums an entry, which are added up
in Spark; the driver sees one number for each entry and component. The table of the round before is dropped.

Defined results: rows whose vector is null or holds null or non-finite components are dropped; the dimension is that of the smallest kept vec_id,
rows of another one get a null code and errors and teach nothing; a dimension that the parts do not divide gives the first parts one component more;
repeated vec_ids count once for the first codebook (the smallest vector), null ones not at all, and all their rows are coded; with fewer ids
there are fewer entries, without any the codes are null; components beyond 2**52 stay there, errors stop at 2**63 - 1; equal labels, null
ones too, share their sum of errors (null if no row of theirs has one); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.llm.common import left_by_key, stored, unstored

PARTS, ENTRIES, ROUNDS, GROUPS, SCALE = 4, 256, 4, 16, 1024
#: whole numbers stop here; the low bits of a component are summed apart; rows a matrix product takes
EDGE, LOW, CHUNK = 1 << 52, 26, 4096
_SUMS = "part int, entry int, rows long, highs array<bigint>, lows array<bigint>"


@dataclass
class Codebooks:
    """first: where each part begins (and the end); history: part -> round -> entries x components; groups: part -> members."""

    first: list[int]
    history: list[list[np.ndarray]] = field(default_factory=list)
    groups: list[list[np.ndarray]] = field(default_factory=list)

    @property
    def entries(self) -> list[np.ndarray]:
        return [h[-1] for h in self.history]

    def sha256(self) -> str:
        """Of all components as decimals, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for c in self.entries for x in c.ravel().tolist()).encode()).hexdigest()


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as whole numbers in doubles."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -EDGE, EDGE)


def sound(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def clustered(entries: np.ndarray, count: int) -> list[np.ndarray]:
    """Members of at most `count` groups of near entries (a few rounds of means; any grouping is right, near ones prune more)."""
    points = entries.astype(np.float64)
    centres = points[np.linspace(0, len(points) - 1, min(count, len(points))).astype(int)]
    for _ in range(5):
        own = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([points[own == g].mean(axis=0) if (own == g).any() else centres[g] for g in range(len(centres))])
    return [m for m in (np.flatnonzero(own == g) for g in range(len(centres))) if len(m)]


def _down(x: np.ndarray) -> np.ndarray:
    """As half-precision numbers that are not larger."""
    h = np.minimum(x, 65504).astype(np.float16)
    return np.where(h.astype(np.float64) > x, np.nextafter(h, np.float16(-np.inf)), h)


def _wide(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Nearest entry where doubles cannot hold the squares: entries that rounding cannot tell apart are compared as whole numbers."""
    c = book.astype(np.float64)
    d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    close = d <= d.min(axis=1, keepdims=True) * (1 + 1e-9)
    best = close.argmax(axis=1)
    for i in np.flatnonzero(close.sum(axis=1) > 1):
        row = [int(v) for v in x[i]]
        exact = {j: sum((a - int(b)) ** 2 for a, b in zip(row, book[j], strict=True)) for j in np.flatnonzero(close[i]).tolist()}
        best[i] = min(exact, key=lambda j: (exact[j], j))
    return best


def nearest(x: np.ndarray, books: list[np.ndarray], groups: list[np.ndarray], last: np.ndarray | None, low: np.ndarray, stamp: np.ndarray) -> np.ndarray:
    """Nearest entry of books[-1] for each row of x (ties: lower index); `low` and `stamp` (rows x groups) are brought up to date.

    last: entries of the round before, None in the first. books: the codebook of each round so far.
    """
    book, now = books[-1], len(books) - 1
    size = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * x.shape[1] * size * size >= 1 << 53:
        low[:], stamp[:] = 0, now
        return np.concatenate([_wide(x[i : i + 256], book) for i in range(0, len(x), 256)] or [np.zeros(0, np.int64)])
    c = book.astype(np.float64)
    x2, c2 = (x * x).sum(axis=1), (c * c).sum(axis=1)
    best, code = np.full(len(x), np.inf), np.zeros(len(x), np.int64)

    def scan(rows: np.ndarray, g: int) -> None:
        members = groups[g]
        d = x2[rows, None] - 2 * (x[rows] @ c[members].T) + c2[members]
        at = d.argmin(axis=1)
        least, entry = d[np.arange(len(rows)), at], members[at]
        better = (least < best[rows]) | ((least == best[rows]) & (entry < code[rows]))
        best[rows], code[rows] = np.where(better, least, best[rows]), np.where(better, entry, code[rows])
        low[rows, g], stamp[rows, g] = _down(np.sqrt(least)), now

    if last is None:
        for g in range(len(groups)):
            scan(np.arange(len(x)), g)
        return code
    group = np.empty(len(book), np.int64)
    for g, members in enumerate(groups):
        group[members] = g
    own = group[last]
    for g in range(len(groups)):
        scan(np.flatnonzero(own == g), g)
    for g, members in enumerate(groups):
        moved = np.array([np.sqrt(((c[members] - b[members].astype(np.float64)) ** 2).sum(axis=1)).max() for b in books]) * (1 + 1e-9)
        reach = low[:, g].astype(np.float64) - moved[stamp[:, g]]
        scan(np.flatnonzero((own != g) & (reach <= np.sqrt(best) * (1 + 1e-9))), g)
    return code


def squared(x: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Exact squared distance to the entry of each row, as Python or NumPy whole numbers."""
    d = x.astype(np.int64) - book[code]
    if d.shape[1] * float(np.abs(d).max(initial=0)) ** 2 < 1 << 62:
        return (d * d).sum(axis=1)
    return (d.astype(object) ** 2).sum(axis=1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), width)


def _sums(x: np.ndarray, code: np.ndarray, total: np.ndarray) -> None:
    """Add rows, high and low components by entry to total (entries x (1 + 2 * width))."""
    order = np.argsort(code, kind="stable")
    entry, at = np.unique(code[order], return_index=True)
    if len(entry):
        v = x[order].astype(np.int64)
        cells = np.column_stack([np.ones(len(v), np.int64), v >> LOW, v & ((1 << LOW) - 1)])
        total[entry] += np.add.reduceat(cells, at, axis=0)


def _round(books: Codebooks, final: bool):
    """One pass: rows (vec_id, label, vector and, after the first, code, low, stamp) to their nearest entries."""
    counts = [len(g) for g in books.groups]
    edge = np.concatenate([[0], np.cumsum(counts)])
    width = books.first[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(h[-1]), 1 + 2 * h[-1].shape[1]), np.int64) for h in books.history]
        schema = None
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, CHUNK):
                batch = whole_batch.slice(at, CHUNK)
                n = batch.num_rows
                x = _matrix(batch.column("vector"), width)
                old = "code" in batch.schema.names
                fixed = lambda c, kind: np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(n, -1).copy()  # noqa: B023, E731
                last = fixed("code", np.uint8) if old else None
                low = fixed("low", np.float16) if old else np.zeros((n, edge[-1]), np.float16)
                stamp = fixed("stamp", np.uint8) if old else np.zeros((n, edge[-1]), np.uint8)
                code, error = np.zeros((n, len(counts)), np.uint8), np.zeros(n, object)
                for p, (a, b) in enumerate(zip(books.first[:-1], books.first[1:], strict=True)):
                    s = slice(edge[p], edge[p + 1])
                    code[:, p] = nearest(x[:, a:b], books.history[p], books.groups[p], last[:, p] if old else None, low[:, s], stamp[:, s])
                    if final:
                        error = error + squared(x[:, a:b], books.history[p][-1], code[:, p])
                    else:
                        _sums(x[:, a:b], code[:, p], totals[p])
                parts = [batch.column("vec_id"), batch.column("label"), _bytes(code)]
                if final:
                    parts.append(pa.array([min(int(e), (1 << 63) - 1) for e in error], pa.int64()))
                    yield pa.RecordBatch.from_arrays(parts, names=["vec_id", "label", "code", "error"])
                    continue
                parts += [batch.column("vector"), _bytes(low), _bytes(stamp)]
                nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
                names = ["vec_id", "label", "code", "vector", "low", "stamp", "part", "entry", "rows", "highs", "lows"]
                out = pa.RecordBatch.from_arrays(parts + nothing, names=names)
                schema = out.schema
                yield out
        if schema is not None and not final:
            for p, t in enumerate(totals):
                some = np.flatnonzero(t[:, 0])
                w = (t.shape[1] - 1) // 2
                lists = lambda v: pa.array(v.tolist(), pa.list_(pa.int64()))
                cells = [pa.array(np.full(len(some), p, np.int32)), pa.array(some.astype(np.int32)), pa.array(t[some, 0]),
                         lists(t[some, 1 : 1 + w]), lists(t[some, 1 + w :])]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(some), f.type) for f in list(schema)[:6]] + cells, schema=schema)

    return run


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def start(kept: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """Codebooks of the smallest vec_ids (vec_id, vector), None if there is none."""
    ids = [r.vec_id for r in kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries).collect()]
    if not ids:
        return None
    rows = kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()
    width = len(rows[0].vector)
    table = whole(np.array([r.vector for r in rows if len(r.vector) == width], np.float64).reshape(-1, width)).astype(np.int64)
    each, more = divmod(width, parts)
    first = np.concatenate([[0], np.cumsum([each + (p < more) for p in range(parts)])]).tolist()
    history = [[table[:, a:b]] for a, b in zip(first[:-1], first[1:], strict=True)]
    return Codebooks(first, history, [clustered(h[0], GROUPS) for h in history])


def moved(books: Codebooks, state: DataFrame) -> None:
    """Append the codebooks of the next round: whole means of the rows of each entry; entries without rows stay."""
    cells = state.where("part is not null").select("part", "entry", "rows", F.posexplode_outer(F.arrays_zip("highs", "lows")).alias("at", "x"))
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = cells.groupBy("part", "entry", "at").agg(exact("rows").alias("n"), exact("x.highs").alias("high"), exact("x.lows").alias("low"))
    nxt = [h[-1].copy() for h in books.history]
    for r in sums.where("at is not null").collect():  # entries x components
        nxt[r.part][r.entry, r.at] = ((int(r.high) << LOW) + int(r.low)) // int(r.n)
    for h, c in zip(books.history, nxt, strict=True):
        h.append(c)


def train(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code (a byte a part), error of every sound row of `embeddings` (vec_id, embedding, label), and the codebooks."""
    kind = embeddings.schema["embedding"].dataType.elementType.typeName()
    vector = F.col("embedding") if kind in ("float", "double") else F.col("embedding").cast("array<double>")
    kept = embeddings.select("vec_id", "label", vector.alias("vector")).where(sound("vector"))
    label, number = embeddings.schema["label"].dataType.simpleString(), embeddings.schema["vec_id"].dataType.simpleString()
    books = start(kept, parts, entries)
    if books is None:
        return kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None
    fits = F.size("vector") == books.first[-1]
    rows = kept.where(fits)
    shape = f"vec_id {number}, label {label}, code binary, vector {kept.schema['vector'].dataType.simpleString()}, low binary, stamp binary, {_SUMS}"
    before = None
    for _ in range(rounds):
        state = stored(rows.mapInArrow(_round(books, False), shape))
        moved(books, state)
        if before is not None:
            unstored(before)
        before, rows = state, state.where("part is null").select("vec_id", "label", "vector", "code", "low", "stamp")
    out = stored(rows.mapInArrow(_round(books, True), f"vec_id {number}, label {label}, code binary, error long"))
    if before is not None:
        unstored(before)
    others = kept.where(~fits).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return out.unionByName(others), books


def digest(embeddings: DataFrame) -> DataFrame:
    """The contract's columns."""
    rows, books = train(embeddings)
    sums = stored(rows.groupBy("label").agg(F.sum("error").alias("label_error")))
    return left_by_key(rows, sums, ["label"]).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books.sha256() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
