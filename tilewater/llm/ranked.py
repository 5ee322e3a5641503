"""Ranked lexical search: every document against every item of a stated query set, exact.

A document's terms that any item of the block asks for are kept with their counts (one row a document). For each item, documents of a chunk
are grouped by the mask of the item's terms they hold, made from the terms' presence bitmaps; a mask's score is bounded by its terms' largest
contributions in the chunk. Masks are evaluated from the highest bound on, until the next bound lies below the worst score kept (a bound that
equals it is still evaluated: an equal score may have a smaller id). Tasks keep the best of what they saw, a grouped limit joins them.

Items are taken in blocks of at most `BLOCK_TERMS` terms (an item with more is a block of its own), so what tasks are sent is bounded; each
block is one pass over the documents. Terms are known by 64-bit hashes.

Defined results: null, empty and termless texts are no documents of the collection and match nothing; rows that share an id are documents of
their own, rows that share an item_id are one item with the terms of all; null ids come last among equal scores; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewater.llm import tokens
from tilewater.llm.common import ALNUM_GAP, ascii_lower, stored

BLOCK_TERMS = 100_000
#: cells of a chunk's table of contributions (terms x documents); evaluated masks hold at least so many documents a step
CELLS, STEP = 1 << 21, 256
NO_ID = np.iinfo(np.int64).max

_HITS = "doc_id long, n long, terms array<int>, counts array<int>"


@dataclass
class Block:
    """Items of one pass: their ids, the terms of each as places in `hashes` (sorted)."""

    ids: list
    terms: list[np.ndarray]
    hashes: np.ndarray


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: distinct terms of every item (rows with an equal id together)."""
    term = F.explode(F.array_distinct(F.array_remove(F.split(ascii_lower(F.coalesce("text", F.lit(""))), ALNUM_GAP), "")))
    return items.select("item_id", term.alias("term")).distinct()


def blocks(items: DataFrame) -> Iterator[Block]:
    """The items with a term, dealt to blocks by a hash of their id, each block within its bound unless it is one item."""
    pairs = stored(item_terms(items))
    total = pairs.count()
    count = max(1, math.ceil(2 * total / BLOCK_TERMS)) if total > BLOCK_TERMS else min(1, total)
    for k in range(count):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).orderBy("item_id", "term")
        ids, terms, size = [], [], 0
        for r in mine.toLocalIterator():  # at most one block at a time on the driver
            if not ids or r.item_id != ids[-1]:
                if size > BLOCK_TERMS:
                    yield _block(ids, terms)
                    ids, terms, size = [], [], 0
                ids.append(r.item_id)
                terms.append([])
            terms[-1].append(r.term.encode("utf-8", "surrogatepass"))
            size += 1
        if ids:
            yield _block(ids, terms)


def _block(ids: list, terms: list[list[bytes]]) -> Block:
    hashes = tokens.word_hashes([t for own in terms for t in own], tokens.NOT_ALNUM)[0]
    known, place = np.unique(hashes, return_inverse=True)
    return Block(ids, np.split(place.astype(np.int32), np.cumsum([len(t) for t in terms])[:-1]), known)


def hits(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), places of the `known` hashes it holds and how often; rows without a term are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tokens.chunks(batch.column("text").to_pylist()):
                hashes, first, *_ = tokens.word_hashes(texts, tokens.NOT_ALNUM)
                place = np.searchsorted(known, hashes)
                place[place == len(known)] = 0
                found = np.flatnonzero(known[place] == hashes)
                doc = np.searchsorted(first, found, side="right") - 1
                pair, counts = np.unique(doc * len(known) + place[found], return_counts=True)
                offsets = np.searchsorted(pair, np.arange(len(texts) + 1) * len(known)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(v.astype(np.int32))) for v in (pair % len(known), counts)]
                n = np.diff(first)
                out = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").mapInArrow(run, _HITS)


def weights(found: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """Weight of each known term from the number of documents that hold it."""
    held = {r.term: r["count"] for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(t, 0) + 1))) for t in range(size)], np.int64)


def norms(n: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """Length factor m of documents with n terms."""
    if 50 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 50 + 50 * n * n_docs // length
    return np.array([50 + 50 * int(x) * n_docs // length for x in n], np.int64)


def _masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First column of each distinct mask and each column's mask number, from presence (terms x documents)."""
    bits = np.packbits(present, axis=0)
    pad = np.zeros((-len(bits) % 8, bits.shape[1]), np.uint8)
    keys = np.ascontiguousarray(np.concatenate([bits, pad]).T).view(np.uint64)
    keys = keys[:, 0] if keys.shape[1] == 1 else keys.view([("", np.uint64)] * keys.shape[1])[:, 0]
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    return first, group.ravel()


class Best:
    """The k best (score, id) seen: highest scores, equal ones by smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a score must reach to matter."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = scores >= self.least
        scores, ids = np.concatenate([self.scores, scores[some]]), np.concatenate([self.ids, ids[some]])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def evaluate(best: Best, gains: np.ndarray, present: np.ndarray, ids: np.ndarray) -> int:
    """Add an item's best of a chunk (gains, present: terms x documents), mask by mask; returns the number of documents scored."""
    first, group = _masks(present)
    bound = gains.max(axis=1, initial=0) @ present[:, first].astype(np.int64)
    order = np.argsort(-bound, kind="stable")
    members = np.argsort(np.argsort(order)[group], kind="stable")  # documents by mask, masks by bound
    upto = np.cumsum(np.bincount(group, minlength=len(first))[order])
    done = 0
    while done < len(members):
        going = np.searchsorted(-bound[order], -best.least, side="right")  # masks whose bound still matters
        last = upto[going - 1] if going else 0
        if last <= done:
            break
        nxt = min(last, upto[min(np.searchsorted(upto, done + max(STEP, done)), len(upto) - 1)])
        docs = members[done:nxt]
        best.add(gains[:, docs].sum(axis=0), ids[docs])
        done = nxt
    return done


def _tops(block: Block, weight: np.ndarray, n_docs: int, length: int, k: int):
    width = max(32, CELLS // max(1, len(block.hashes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in block.ids]
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            m = norms(batch.column("n").to_numpy(zero_copy_only=False), n_docs, length)
            lists = [batch.column(c) for c in ("terms", "counts")]
            sizes = np.diff(lists[0].offsets.to_numpy())
            term, tf = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
            for low in range(0, len(sizes), width):
                high = min(low + width, len(sizes))
                a, b = np.searchsorted(doc, (low, high))
                gains = np.zeros((len(block.hashes), high - low), np.int64)
                present = np.zeros(gains.shape, bool)
                gains[term[a:b], doc[a:b] - low] = gain[a:b]
                present[term[a:b], doc[a:b] - low] = True
                for own, top in zip(block.terms, best, strict=True):
                    evaluate(top, gains[own], present[own], ids[low:high])
        sizes = [len(t.ids) for t in best]
        ids = np.concatenate([t.ids for t in best])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(best), dtype=np.int32), sizes)), pa.array(ids, mask=ids == NO_ID),
             pa.array(np.concatenate([t.scores for t in best]))], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents (doc_id, text) of each item (item_id, text), scores above 0."""
    spark = docs.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in blocks(items):
        found = stored(hits(docs, block.hashes))
        n_docs, length = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            return out
        weight = weights(found, n_docs, len(block.hashes))
        tops = found.where(F.size("terms") > 0).mapInArrow(_tops(block, weight, n_docs, length, k), "item int, doc_id long, score long")
        order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        tops = tops.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        out = out.unionByName(stored(tops.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
    return out
