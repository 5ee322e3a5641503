"""Suffix-array dedup: remove bytes covered by a SPAN-byte string that also starts in a document with a smaller id.

Suffixes are ordered only through SPAN bytes, most significant digits first, and a suffix leaves as soon as its group has no other
document. Only suffixes at anchors are sorted: an anchor is a place whose GRAM-byte gram has the smallest hash among all grams of some
SPAN-byte string around it, so equal strings have equal anchors at equal places inside and none is missed.

1. first digit: each block of documents sends the distinct gram hashes of its anchors to parts chosen by the hash; parts answer with
   one flag each: met in another block or not. Grams of one document leave here.
2. the rest: the bytes within reach of a surviving anchor go to its gram's part, once for each block and distinct reach; there the
   strings at each offset are sorted, equal groups are the repeated strings, and the answer is the outermost offsets whose string starts in
   a document with a smaller id. All these strings hold the anchor, so what they cover is one run of bytes.
   A gram met in over HOT blocks sends its strings one by one, dealt by their own hash, so no part gathers a common phrase.
3. each block marks what is covered and hashes the rest.

Blocks and parts have a bounded size; what blocks send is distinct within the block, so copies cost one entry a block.

Defined results: null texts are empty; strings never cross documents; equal ids are never smaller than one another; a row without an
id neither removes nor loses bytes; rows are kept one to one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewater.llm import tokens
from tilewater.llm.common import stored

SPAN, GRAM = 50, 24
REACH = SPAN - GRAM
WIDE = SPAN + REACH
#: bytes of text in a block (one longer text is a block of its own) and, on average, to a part
BLOCK, PART = 1 << 21, 1 << 23
HOT = 2048
NONE = 255
_ONES = np.uint64((1 << 64) - 1)


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every `width` values in a row, by doubling."""
    have, span = values, 1
    while span * 2 <= width:
        have, span = pick(have[: len(have) - span], have[span:]), span * 2
    rest = width - span
    return pick(have[: len(have) - rest], have[rest:]) if rest else have


def _crossing(ends: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each of n places, whether `width` bytes from there cross the end of a document."""
    step = np.zeros(n + 1, np.int32)
    low = np.clip(ends - width + 1, 0, n)
    np.add.at(step, low, 1)
    np.add.at(step, np.clip(ends, 0, n), -1)
    return np.cumsum(step[:n]) > 0


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors in documents that lie end to end, and the hashes of their grams; long data are done in slices."""
    places, hashes = [], []
    for a in range(0, len(data), BLOCK):
        low, high = max(0, a - REACH), min(len(data), a + BLOCK + REACH + SPAN)
        if high - low < SPAN:
            break
        part, stops = data[low:high], ends[(ends > low) & (ends < high)] - low
        n = len(part) - GRAM + 1
        up, down = tokens._power(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(tokens._letters(False)[part] * up[: len(part)], out=total[1:])
        g = tokens.mix((total[GRAM:] - total[:-GRAM]) * down[:n])
        g[_crossing(stops, n, GRAM)] = _ONES
        least = slide(g, REACH + 1, np.minimum)
        least[_crossing(stops, len(least), SPAN)] = 0
        edge = np.zeros(REACH, np.uint64)
        best = slide(np.concatenate([edge, least, edge]), REACH + 1, np.maximum)
        at = np.flatnonzero(best == g)
        at = at[(at + low >= a) & (at + low < a + BLOCK)]
        places.append(at + low)
        hashes.append(g[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


class Block:
    """Documents of a block, opened: bytes, ends, ids, the anchors with their reach and document."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8).astype(bool)
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8)
        self.begins = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        at, gram = anchors(self.data, self.ends)
        doc = np.searchsorted(self.ends, at, side="right")
        use = self.known[doc]
        self.at, self.gram, self.doc = at[use], gram[use], doc[use]
        self.left = np.minimum(REACH, self.at - self.begins[self.doc]).astype(np.uint8)
        self.right = np.minimum(REACH, self.ends[self.doc] - self.at - GRAM).astype(np.uint8)

    def keys(self) -> np.ndarray:
        return np.unique(self.gram)

    def reach_hash(self, which: np.ndarray) -> np.ndarray:
        low, high = self.at[which] - self.left[which], self.at[which] + GRAM + self.right[which]
        return tokens.range_hashes(tokens._letters(False)[self.data], low, high) + self.left[which]

    def entries(self, flags: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Surviving anchors, the entry of each, the first anchor of each entry (smallest id), and which anchors' grams are hot."""
        where = np.searchsorted(keys, self.gram)
        flag = flags[where]
        order = np.argsort(where, kind="stable")
        ids = self.ids[self.doc]
        starts = np.searchsorted(where[order], np.arange(len(keys)))
        if len(keys):
            several = np.minimum.reduceat(ids[order], starts) != np.maximum.reduceat(ids[order], starts)
            flag = np.maximum(flag, several[where].astype(np.uint8))
        hot = np.flatnonzero(flag == 2)
        live = np.flatnonzero(flag == 1)
        reach = self.reach_hash(live) if len(live) else np.zeros(0, np.uint64)
        order = np.lexsort((self.at[live], ids[live], reach, self.gram[live]))
        new = np.ones(len(live), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (self.gram[live][a] != self.gram[live][b]) | (reach[a] != reach[b])
        entry = np.empty(len(live), np.int64)
        entry[order] = np.cumsum(new) - 1
        return live, entry, live[order[new]], hot

    def reaches(self, which: np.ndarray) -> np.ndarray:
        """WIDE bytes around anchors, zero beyond their documents."""
        index = self.at[which][:, None] + np.arange(-REACH, GRAM + REACH)[None, :]
        ok = (np.arange(WIDE) >= REACH - self.left[which][:, None]) & (np.arange(WIDE) < REACH + GRAM + self.right[which][:, None])
        return np.where(ok, self.data[np.clip(index, 0, len(self.data) - 1)], 0).astype(np.uint8)

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and document of every SPAN-byte string that holds one of the anchors."""
        start = (self.at[which][:, None] - np.arange(REACH + 1)[None, :]).ravel()
        doc = np.repeat(self.doc[which], REACH + 1)
        ok = (start >= self.begins[doc]) & (start + SPAN <= self.ends[doc])
        start, doc = start[ok], doc[ok]
        start, first = np.unique(start, return_index=True)
        return tokens.range_hashes(tokens._letters(False)[self.data], start, start + SPAN), start, doc[first]


def blocked(docs: DataFrame) -> DataFrame:
    """Rows as blocks: block, ids, known, ends, body; a block is one row, so later steps see it whole."""

    def close(number: int, rows: list) -> pa.RecordBatch:
        ids = np.array([0 if i is None else i for i, _ in rows], np.int64)
        known = np.array([i is not None for i, _ in rows], np.uint8)
        ends = np.cumsum([len(t) for _, t in rows]).astype(np.int64)
        body = zstandard.ZstdCompressor(level=3).compress(b"".join(t for _, t in rows))
        return pa.RecordBatch.from_pydict({"block": [number], "ids": [ids.tobytes()], "known": [known.tobytes()], "ends": [ends.tobytes()], "body": [body], "size": [int(ends[-1])]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if rows and size + len(t) > BLOCK:
                    yield close(number, rows)
                    number, rows, size = number + 1, [], 0
                rows.append((i, t))
                size += len(t) + 64
        if rows:
            yield close(number, rows)

    return stored(docs.select("doc_id", "text").mapInArrow(run, "block long, ids binary, known binary, ends binary, body binary, size long"))


def _part_rows(keys: np.ndarray, parts: int):
    """Keys dealt to parts: their order after a stable sort by part, and (part, from, to) of the parts that have any."""
    part = (keys % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    some, first = np.unique(part[order], return_index=True)
    return order, list(zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(part)], strict=False))


def _grouped(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each row, whether its key has a row with a smaller document."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    least = np.minimum.reduceat(docs[order], np.flatnonzero(new)) if len(k) else docs
    out = np.empty(len(k), bool)
    out[order] = least[np.cumsum(new) - 1] < docs[order]
    return out


def first_digit(blocks: DataFrame, parts: int) -> DataFrame:
    """block, part, kind 0, a: for the block's distinct grams of the part, 1 if another block has it, 2 if over HOT have."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = Block(row).keys()
                order, runs = _part_rows(keys, parts)
                keys = keys[order]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([p for p, _, _ in runs], pa.int32()), "block": pa.array([row["block"]] * len(runs), pa.int64()),
                    "a": pa.array([pack(np.diff(keys[i:j], prepend=np.uint64(0))) for _, i, j in runs], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        lists = [np.cumsum(unpack(b, np.uint64), dtype=np.uint64) for b in table["a"].to_pylist()]
        keys = np.concatenate(lists)
        _, where, count = np.unique(keys, return_inverse=True, return_counts=True)
        flags = ((count > 1).astype(np.uint8) + (count > HOT).astype(np.uint8))[where]
        cuts = np.cumsum([0, *map(len, lists)])
        return pa.table({"block": table["block"], "part": table["part"], "kind": pa.array(np.zeros(len(lists), np.int32)),
                         "a": pa.array([pack(flags[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())})

    sent = blocks.mapInArrow(send, "part int, block long, a binary")
    return sent.groupBy("part").applyInArrow(answer, "block long, part int, kind int, a binary")


def _flags(answers: list[dict], keys: np.ndarray, parts: int) -> np.ndarray:
    order, runs = _part_rows(keys, parts)
    got = {r["part"]: r["a"] for r in answers if r["kind"] == 0}
    out = np.zeros(len(keys), np.uint8)
    for p, i, j in runs:
        out[order[i:j]] = unpack(got[p], np.uint8)
    return out


def second_pass(blocks: DataFrame, flags: DataFrame, parts: int) -> DataFrame:
    """block, part, kind 1 or 2, a: answers to entries (largest and smallest offset, NONE if none) and to single strings (0 or 1)."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"part": [], "block": [], "kind": [], "a": [], "b": []}
        for row in left.to_pylist():
            block = Block(row)
            keys = block.keys()
            _, _, first, hot = block.entries(_flags(right.to_pylist(), keys, parts), keys)
            order, runs = _part_rows(block.gram[first], parts)
            first = first[order]
            for p, i, j in runs:
                some = first[i:j]
                sides = np.column_stack([block.reaches(some), block.left[some], block.right[some]])
                _append(out, p, block.block, 1, pack(sides), pack(block.ids[block.doc[some]]))
            h, _, doc = block.strings(hot)
            order, runs = _part_rows(h, parts)
            for p, i, j in runs:
                _append(out, p, block.block, 2, pack(h[order[i:j]]), pack(block.ids[doc[order[i:j]]]))
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), _SENT, strict=True)})

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by([("kind", "ascending"), ("block", "ascending")])
        rows = table.to_pylist()
        out = {"block": [r["block"] for r in rows], "part": [r["part"] for r in rows], "kind": [r["kind"] for r in rows], "a": []}
        wide = [unpack(r["a"], np.uint8).reshape(-1, WIDE + 2) for r in rows if r["kind"] == 1]
        if wide:
            cuts = np.cumsum([0, *map(len, wide)])
            all_rows, docs = np.concatenate(wide), np.concatenate([unpack(r["b"], np.int64) for r in rows if r["kind"] == 1])
            found = np.full((len(all_rows), 2), NONE, np.uint8)
            up, _ = tokens._power(WIDE + 1)
            total = np.zeros((len(all_rows), WIDE + 1), np.uint64)
            np.cumsum(tokens._letters(False)[all_rows[:, :WIDE]] * up[:WIDE], axis=1, out=total[:, 1:])
            for o in range(REACH + 1):
                ok = np.flatnonzero((all_rows[:, WIDE] >= o) & (all_rows[:, WIDE + 1] >= REACH - o))
                at = REACH - o
                hit = ok[_grouped(total[ok, at + SPAN] - total[ok, at], docs[ok])]
                found[hit, 0] = o
                found[hit, 1] = np.minimum(found[hit, 1], o)
            out["a"] += [pack(found[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        single = [unpack(r["a"], np.uint64) for r in rows if r["kind"] == 2]
        if single:
            cuts = np.cumsum([0, *map(len, single)])
            hit = _grouped(np.concatenate(single), np.concatenate([unpack(r["b"], np.int64) for r in rows if r["kind"] == 2])).astype(np.uint8)
            out["a"] += [pack(hit[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), _ANSWERED, strict=True)})

    sent = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(send, "part int, block long, kind int, a binary, b binary")
    return sent.groupBy("part").applyInArrow(answer, "block long, part int, kind int, a binary")


_SENT = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
_ANSWERED = (pa.int64(), pa.int32(), pa.int32(), pa.binary())


def _append(out: dict, *values) -> None:
    for column, v in zip(out.values(), values, strict=True):
        column.append(v)


def covered(block: Block, answers: list[dict], parts: int) -> np.ndarray:
    """Which bytes of a block go."""
    keys = block.keys()
    live, entry, first, hot = block.entries(_flags(answers, keys, parts), keys)
    step = np.zeros(len(block.data) + 1, np.int64)
    got = {(r["kind"], r["part"]): r["a"] for r in answers}
    found = np.full((len(first), 2), NONE, np.uint8)
    order, runs = _part_rows(block.gram[first], parts)
    for p, i, j in runs:
        found[order[i:j]] = unpack(got[1, p], np.uint8).reshape(-1, 2)
    ids = block.ids[block.doc]
    later = ids[live] > ids[first[entry]] if len(live) else np.zeros(0, bool)
    high = np.where(later, block.left[live], found[entry, 0]).astype(np.int64)
    low = np.where(later, REACH - block.right[live], found[entry, 1]).astype(np.int64)
    hit = later | (found[entry, 0] != NONE)
    np.add.at(step, block.at[live][hit] - high[hit], 1)
    np.add.at(step, block.at[live][hit] - low[hit] + SPAN, -1)
    h, start, doc = block.strings(hot)
    gone = np.zeros(len(h), bool)
    order, runs = _part_rows(h, parts)
    for p, i, j in runs:
        gone[order[i:j]] = unpack(got[2, p], np.uint8) > 0
    np.add.at(step, start[gone], 1)
    np.add.at(step, start[gone] + SPAN, -1)
    return np.cumsum(step[:-1]) > 0


def deduplicate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with `with_text` also `kept`, the bytes that stay."""
    blocks = blocked(docs)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    parts = max(1, -(-int(size) // PART))
    flags = stored(first_digit(blocks, parts))
    answers = stored(second_pass(blocks, flags, parts))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields += [("kept", pa.binary())] if with_text else []

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {k: [] for k, _ in fields}
        for row in left.to_pylist():
            block = Block(row)
            gone = covered(block, right.to_pylist(), parts)
            begun = gone.copy()
            begun[1:] &= ~gone[:-1]
            begun[block.begins[block.begins < len(gone)]] = gone[block.begins[block.begins < len(gone)]]
            removed, spans = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begun)])
            for k, (a, b) in enumerate(zip(block.begins, block.ends, strict=True)):
                rest = block.data[a:b][~gone[a:b]].tobytes()
                _append(out, int(block.ids[k]) if block.known[k] else None, int(b - a), int(removed[b] - removed[a]), int(spans[b] - spans[a]),
                        hashlib.sha256(rest).hexdigest(), *([rest] if with_text else []))
        return pa.table({k: pa.array(out[k], t) for k, t in fields})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    both = flags.unionByName(answers)
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(finish, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return deduplicate(docs)
