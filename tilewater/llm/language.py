"""Language ID by cross-parsing entropy.

Per language, the suffix automaton of a bounded sample of labelled text. A text is cut greedily into the longest phrases that occur in
the sample; the language that needs the fewest phrases, times the bits to name one, is the guess. Automata are dense tables over a
small alphabet (frequent letters have symbols of their own, others share hashed ones, anything else is one gap), so many blocks
of text advance together, one symbol a step. Texts are cut into blocks of BLOCK symbols, whole texts are read.

Whether a text is in a learnt language at all (`fitting`) is told by the same parse: bits a symbol, block by block in the language that fits it
best, against what text of that language needs that was held back from a model of the other half of the sample; and at least half of
its letters must be of a learnt alphabet, counted over all labelled rows without a limit, as scripts share hashed symbols.

Bounds: at most LANGUAGES labels (the most frequent), PIECES pieces of PIECE characters of each, and SYMBOLS symbols in all.

Defined results: `und` with score 0 if the text is null or has no letter, or nothing could be learnt; ties go to the smaller label;
rows are kept one to one; null labels teach nothing.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType, StructField, StructType

from tilewater.llm import tokens

LANGUAGES, PIECES, PIECE, SYMBOLS = 200, 64, 400, 120_000
BLOCK, LETTERS, ALPHABET = 256, 55, 64
GAP, PAD = 0, ALPHABET - 1
CHARS = 1 << 20
#: a text fits up to so many times the bits of held-out text, and SHORT symbols more; held-out pieces with longer phrases than COPY are copies
SLACK, SHORT, USUAL, COPY = 1.5, 24, 0.75, 24
#: least share of a text's letters that are of a learnt alphabet; share of a label's letters that its alphabet may leave out
LEAST_KNOWN, STRAY = 0.5, 1e-3
_tables: dict[bytes, np.ndarray] = {}


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    letters: str
    table: np.ndarray
    start: np.ndarray
    bits: np.ndarray


def symbol_table(letters: str) -> np.ndarray:
    """Symbol of each code point: GAP for what is no letter, own symbols for `letters`, hashed ones for other letters."""
    key = letters.encode("utf-8")
    if key not in _tables:
        table = np.zeros(0x110000, np.uint8)
        spare = PAD - 1 - len(letters)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                table[c] = 1 + len(letters) + (c * 2654435761 >> 7) % spare
        for i, ch in enumerate(letters):
            table[ord(ch)] = 1 + i
        _tables[key] = table
    return _tables[key]


def _points(text: str) -> np.ndarray:
    """Code points of a text in lower case."""
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    """Symbols of a text in lower case, runs of gaps taken as one."""
    s = table[_points(text)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
    return s[keep]


def automaton(s: np.ndarray) -> np.ndarray:
    """Transitions of the suffix automaton of s: a row for each state, -1 where there is none; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in s.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    out = np.full((len(nxt), ALPHABET), -1, np.int32)
    for i, edges in enumerate(nxt):
        for c, j in edges.items():
            out[i, c] = j
    return out


def parser(s: np.ndarray, offset: int) -> np.ndarray:
    """Table of greedy parsing: next state times ALPHABET, the lowest bit set where a phrase begins; state `offset` lies between phrases."""
    a = automaton(s)
    root = np.where(a[0] >= 0, a[0], 0)
    go = np.where(a >= 0, a, root)
    begins = a < 0
    begins[0] = True
    out = (go + offset) * ALPHABET + begins
    out[:, PAD] = (np.arange(len(a)) + offset) * ALPHABET
    return out.astype(np.int32)


def build(pieces: dict[str, list[str]]) -> Model:
    """Model of labelled pieces of text."""
    labels = tuple(sorted(pieces))
    frequent = Counter(ch for p in pieces.values() for t in p for ch in t.lower() if ch.isalpha())
    letters = "".join(ch for ch, _ in sorted(frequent.items(), key=lambda x: (-x[1], x[0]))[:LETTERS])
    table = symbol_table(letters)
    each = SYMBOLS // max(1, len(labels))
    parts, starts, bits, at = [], [], [], 0
    for label in labels:
        s = np.concatenate([symbols(t + " ", table) for t in pieces[label]])[:each]
        parts.append(parser(s, at))
        starts.append(at * ALPHABET)
        bits.append(math.log2(max(2, len(s))))
        at += len(parts[-1])
    return Model(labels, letters, np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32),
                 np.array(starts, np.int32), np.array(bits))


def phrases(blocks: np.ndarray, model: Model) -> np.ndarray:
    """Phrases of each block (a row of BLOCK symbols, padded) for each language: languages x blocks."""
    state = np.repeat(model.start[:, None], len(blocks), axis=1)
    count = np.zeros(state.shape, np.int32)
    for column in np.ascontiguousarray(blocks.T):
        if (column == PAD).all():
            break
        v = model.table.take(state + column)
        begun = v & 1
        count += begun
        state = v - begun
    return count


def limits(pieces: dict[str, list[str]]) -> np.ndarray:
    """Bits a symbol up to which a text fits each language (in the order of labels): SLACK times what most held-out pieces need.

    Every other piece is held back from the model that measures it. Copies of learnt text tell nothing; a language without other held-out
    text has the highest limit of the others, and none at all if no language has one.
    """
    half = build({k: p[::2] for k, p in pieces.items()})
    table, out = symbol_table(half.letters), []
    for i, label in enumerate(half.labels):
        rates = []
        for s in (symbols(t, table) for t in pieces[label][1::2]):
            if s.any():
                blocks = np.full((-(-len(s) // BLOCK), BLOCK), PAD, np.uint8)
                blocks.reshape(-1)[: len(s)] = s
                n = phrases(blocks, half)[i].sum()
                rates += [n * half.bits[i] / len(s)] if len(s) < COPY * n else []
        out.append(SLACK * np.quantile(rates, USUAL) if rates else -1.0)
    known = np.array(out)
    return np.where(known > 0, known, known.max() if (known > 0).any() else np.inf)


def guess(texts: list[str | None], model: Model, most: np.ndarray | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Label, score and fit of each text.

    The score is how much fewer bits the best language needs than the next (or than a phrase a symbol); a text fits if its blocks, each in
    its best language, need no more than `most` bits a symbol.
    """
    names, scores, fit = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    if not model.labels:
        return names, scores, fit
    table = symbol_table(model.letters)

    def flush(run: list[tuple[int, np.ndarray]]) -> None:
        sizes = np.array([-(-len(s) // BLOCK) for _, s in run])
        blocks = np.full((int(sizes.sum()), BLOCK), PAD, np.uint8)
        at = 0
        for k, (_, s) in zip(sizes, run, strict=True):
            blocks[at : at + k].reshape(-1)[: len(s)] = s
            at += k
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        begun = phrases(blocks, model)
        need = np.add.reduceat(begun, first, axis=1) * model.bits[:, None]
        order = np.argsort(need, axis=0, kind="stable")
        best = np.take_along_axis(need, order[:1], 0)[0]
        if len(model.labels) > 1:
            second = np.take_along_axis(need, order[1:2], 0)[0]
        else:
            second = np.array([len(s) for _, s in run]) * model.bits[0]
        for j, (i, _) in enumerate(run):
            names[i] = model.labels[order[0, j]]
            scores[i] = min(1.0, max(0.0, 1 - best[j] / max(second[j], 1e-9)))
        if most is not None:
            load = np.add.reduceat((begun * (model.bits / most)[:, None]).min(axis=0), first)
            for j, (i, s) in enumerate(run):
                fit[i] = load[j] <= len(s) + SHORT

    run, size = [], 0
    for i, t in enumerate(texts):
        s = symbols(t, table) if t else np.zeros(0, np.uint8)
        if not s.any():
            continue
        run.append((i, s))
        size += len(s)
        if size > CHARS:
            flush(run)
            run, size = [], 0
    if run:
        flush(run)
    return names, scores, fit


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Bounded pieces of text for each label of docs (doc_id, text, lang): rows by hash, a few times more than needed kept before ranking."""
    h = F.xxhash64("doc_id", "text")
    known = docs.where("lang is not null and text is not null").where(F.rlike("text", F.lit(r"\p{L}")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    rows = known.join(F.broadcast(counts), "lang")  # at most LANGUAGES rows
    rows = rows.where(F.pmod(h, F.lit(1 << 40)) < F.lit(float(1 << 40)) * (4 * PIECES) / F.col("count"))
    start = F.pmod(h, F.greatest(F.char_length("text") - PIECE + 1, F.lit(1))).cast("int") + 1
    pieces = rows.select("lang", h.alias("h"), F.substring(F.col("text"), start, F.lit(PIECE)).alias("piece"))
    ranked = pieces.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "piece"))).where(F.col("k") <= PIECES)
    out: dict[str, list[str]] = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.lang, r.k)):  # bounded: LANGUAGES x PIECES pieces
        out.setdefault(r.lang, []).append(r.piece)
    return out


def identify(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The `keep` columns of every row with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, _ = guess(batch.column("__text").to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*keep, "lang_pred", "score"])

    df = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    return df.mapInArrow(run, f"{schema}, lang_pred string, score double")


def alphabet(docs: DataFrame, labels: tuple[str, ...]) -> str:
    """Letters of the learnt languages, from all rows of docs (text, lang) with one of `labels`, without those rare ones that make up less than STRAY of a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, Counter] = {}
        for batch, column in (x for b in batches for x in tokens.portions(b, b.column(1))):
            for lang, text in zip(batch.column(0).to_pylist(), column.to_pylist(), strict=True):
                c, n = np.unique(_points(text), return_counts=True)
                sums.setdefault(lang, Counter()).update(dict(zip(c.tolist(), n.tolist(), strict=True)))
        rows = [(lang, c, n) for lang, found in sums.items() for c, n in found.items() if chr(c).isalpha()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
            names=["lang", "c", "n"])

    known = docs.where(F.col("lang").isin(*labels) & F.col("text").isNotNull()).select("lang", "text")
    counts = known.mapInArrow(run, "lang string, c int, n long").groupBy("lang", "c").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg((F.sum("n") * STRAY / F.count("*")).alias("least"))
    letters = counts.join(F.broadcast(totals), "lang").where("n >= least").select("c").distinct()
    return "".join(sorted(chr(r.c) for r in letters.collect()))  # bounded: letters of Unicode


def fitting(docs: DataFrame, model: Model, most: np.ndarray, letters: str) -> DataFrame:
    """`row` (a struct with all columns) of rows of docs whose text fits a learnt language, with lang_pred. A text goes to Python once, in its row."""
    known = np.zeros(0x110000, bool)
    known[[ord(c) for c in letters]] = True
    shared = docs.sparkSession.sparkContext.broadcast((model, most, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, most, known = shared.value
        is_letter = symbol_table(model.letters) != GAP
        for batch, column in (x for b in batches for x in tokens.portions(b, b.column(0).field("text"))):
            texts = column.to_pylist()
            names, _, fit = guess(texts, model, most)
            for i, t in enumerate(texts):
                if fit[i]:
                    c = _points(t)
                    fit[i] = known[c].sum() >= LEAST_KNOWN * is_letter[c].sum()
            stay = pa.array(fit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(stay), pa.array(names, pa.string()).filter(stay)], names=["row", "lang_pred"])

    df = docs.select(F.struct(*docs.columns).alias("row"))
    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("lang_pred", StringType())]))


def held_out():
    """Rows that teach nothing."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    model = build(sample(docs.where(~held_out()).select("doc_id", "text", "lang")))
    return identify(docs.withColumn("held_out", held_out()).select("doc_id", "held_out", "text"), model, "doc_id", "held_out")
