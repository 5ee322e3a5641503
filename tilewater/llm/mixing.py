"""Mixing sources to target weights.

The words of each source, documents in a fixed order, are packed into blocks of BLOCK words. A source takes as many slots as its target has
blocks, and its last slot is cut short, so that the words taken are its target to the word. Slot s of a source stands for block
permutation(s mod blocks), a keyed pseudorandom permutation of the source's block numbers, and slots meet blocks in one join on (source, block).

Output shards of SHARD_SLOTS slots draw multinomial source counts from what is left of each source's slots. The range of shards is halved
again and again: the left half draws its counts, the right half keeps the rest, with a generator seeded by the range. So a task finds the counts of its
own shards in a logarithmic number of draws, without any other, and the driver holds one row a source and nothing of the shards.

Defined results: null texts and texts without words have size 0 and are taken 0 times; a null source is a source, the last one; rows
are kept one to one; repeated rows are separate documents of equal size; reruns give equal rows for equal input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tilewater.llm.common import BLANK_WORD, KEY, keyed, left_by_key
from tilewater.session import cut

BLOCK, SEED = 256, 20
WEIGHTS, LIMIT = (5, 2, 1), 3
SHARD_SLOTS = 4096
#: shards whose counts are in memory at once
SHARDS_AT_ONCE = 64
#: documents to one stretch of the running sum
STRETCH = 20_000
#: keys of the block permutations start here, those of places in shards at 0
BLOCK_KEY = 1 << 20
BLANK_GAP = r"[\x20\x09-\x0D]+"


def split_words(text):
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK_GAP), "")


def targets(sizes: list[int], weights=WEIGHTS, limit: int = LIMIT) -> list[float]:
    """Share of the whole by weight, none above `limit` times its size; what is cut off goes to the others by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(w[i] for i in free)
        over = {i for i in free if w[i] * unit > limit * sizes[i]}
        for i in over or free:
            out[i] = float(limit * sizes[i]) if over else w[i] * unit
        if not over:
            break
        free -= over
        left -= sum(out[i] for i in over)
    return out


def _some(rng: np.random.Generator, left: np.ndarray, want: int) -> np.ndarray:
    """`want` slots by multinomial draws in proportion to what is left, none beyond it."""
    got = np.zeros(len(left), np.int64)
    while want:
        room = left - got
        more = np.minimum(rng.multinomial(want, room / room.sum()), room)
        got += more
        want -= int(more.sum())
    return got


def draw(slots: list[int], shard_slots: int = SHARD_SLOTS, seed: int = SEED, low: int = 0, high: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """shard, source, first slot of the source, count, place in the shard for the shards from `low` to before `high` (all of them).

    The counts of all shards together use up every source's slots; those of a shard do not depend on `low` and `high`.
    """
    total = sum(slots)
    shards = -(-total // shard_slots)
    high = shards if high is None else high
    out: list[tuple[int, int, int, int, int]] = []

    def halve(a: int, b: int, ks: np.ndarray, left: np.ndarray, used: np.ndarray) -> None:
        if a >= high or b <= low:
            return
        some = left > 0
        ks, left, used = ks[some], left[some], used[some]
        if b - a == 1:
            places = np.cumsum(left) - left
            out.extend((a, int(k), int(u), int(n), int(p)) for k, u, n, p in zip(ks, used, left, places, strict=True))
            return
        mid = (a + b) // 2
        mine = _some(np.random.default_rng([seed, a, b]), left, min(mid * shard_slots, total) - a * shard_slots)
        halve(a, mid, ks, mine, used)
        halve(mid, b, ks, left - mine, used + mine)

    if shards:
        halve(0, shards, np.arange(len(slots)), np.array(slots, np.int64), np.zeros(len(slots), np.int64))
    return out


def drawn(spark: SparkSession, slots: list[int], shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """`draw` for all shards as rows, each task for its own."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["id"].to_numpy()
            for i in range(0, len(ids), SHARDS_AT_ONCE):
                part = ids[i : i + SHARDS_AT_ONCE]  # consecutive: they come from a range
                yield pd.DataFrame(draw(slots, shard_slots, SEED, int(part[0]), int(part[-1]) + 1), columns=["shard", "k", "first", "count", "place"])

    return spark.range(-(-sum(slots) // shard_slots)).mapInPandas(run, "shard long, k int, first long, count long, place long")


def quota(size: int, target: float, k: int, block: int = BLOCK) -> tuple[int, int, int]:
    """blocks of the source, slots it takes, and words of the last slot, so that all slots hold the target (to the word, at most LIMIT times the size)."""
    if not size:
        return 0, 0, 0
    words, blocks = min(int(target + 0.5), LIMIT * size), -(-size // block)
    short = size - (blocks - 1) * block  # words of the last block
    one = lambda x: np.array([x], np.int64)
    turn = int(permuted(one(blocks - 1), one(blocks), one(k + BLOCK_KEY), back=True)[0])  # the slot of an epoch in which it stands
    epochs, rest = divmod(words, size)
    if not rest:
        return blocks, epochs * blocks, short if turn == blocks - 1 else block
    n = -(-rest // block)
    if n > turn:
        n = -(-(rest + block - short) // block)
    before = (n - 1) * block - (block - short if n - 1 > turn else 0)
    return blocks, epochs * blocks + n, rest - before


def permuted(value: np.ndarray, size: np.ndarray, key: np.ndarray, seed: int = SEED, back: bool = False) -> np.ndarray:
    """value's place under a keyed permutation of range(size), or `back`: Feistel rounds, walked on until the place is inside."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(2, size)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)

    def mixed(x: np.ndarray, r: int, k: np.ndarray) -> np.ndarray:
        f = (x + np.uint64(r * 0x9E3779B9 + seed)) * np.uint64(0xFF51AFD7ED558CCD) + k * np.uint64(0xC4CEB9FE1A85EC53)
        f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return f ^ (f >> np.uint64(31))

    out, todo = value.astype(np.uint64), np.ones(len(value), bool)
    while todo.any():
        h, m, k, x = half[todo], low[todo], key[todo].astype(np.uint64), out[todo]
        a, b = x >> h, x & m
        for r in range(4):
            if back:
                a, b = (b ^ mixed(a, 3 - r, k)) & m, a
            else:
                a, b = b, (a ^ mixed(b, r, k)) & m
        out[todo] = (a << h) | b
        todo[todo] = out[todo] >= size[todo].astype(np.uint64)
    return out.astype(np.int64)


@F.pandas_udf(T.LongType())
def _permuted(value: pd.Series, size: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series(permuted(value.to_numpy(), size.to_numpy(), key.to_numpy()))


def measured(docs: DataFrame) -> tuple[DataFrame, list, list[float]]:
    """Documents (key, k: number of the source, size), rows of the sources in their order, and the sources' targets."""
    spark = docs.sparkSession
    sizes = keyed(docs, "source").select(*KEY, "source", F.size(split_words(F.col("text"))).cast("long").alias("size"))
    sizes = cut(sizes)
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    order = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    numbered = spark.createDataFrame([(r.source, i) for i, r in enumerate(order)], "source string, k int")
    numbered = numbered.withColumnRenamed("source", "s")
    docs_k = sizes.join(numbered, F.col("source").eqNullSafe(F.col("s"))).select(*KEY, "k", "size")
    return docs_k, order, targets([r["size"] for r in order])


def placed(docs_k: DataFrame, rows: int) -> DataFrame:
    """Documents with words and `begin`, the number of their source's words before them: sums of stretches, then inside each."""
    stretch = F.pmod(F.xxhash64(*KEY), F.lit(max(1, -(-rows // STRETCH)))).alias("stretch")
    some = docs_k.where("size > 0").select("*", stretch)
    sums = some.groupBy("k", "stretch").agg(F.sum("size").alias("all"))
    before = W.partitionBy("k").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("k", "stretch", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("k", "stretch").orderBy(*KEY).rowsBetween(W.unboundedPreceding, -1)
    run = some.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return run.join(sums, ["k", "stretch"]).select(*KEY, "k", "size", (F.col("base") + F.col("inner")).alias("begin"))


def mix(docs_k: DataFrame, order: list, goal: list[float], block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """shard, place, k, block, epoch, doc_id, text_hash, start, n, at: every piece of a document in every slot that takes it."""
    spark = docs_k.sparkSession
    quotas = [quota(r["size"], t, k, block) for k, (r, t) in enumerate(zip(order, goal, strict=True))]
    slots = [q[1] for q in quotas]
    plan = drawn(spark, slots, shard_slots)
    many = spark.createDataFrame([(k, b, n - 1, w) for k, (b, n, w) in enumerate(quotas)], "k int, blocks long, last long, last_words long")
    filled = F.least(F.lit(shard_slots).cast("long"), F.lit(sum(slots)) - F.col("shard") * shard_slots)
    each = plan.join(many, "k").select(
        "shard", "k", "blocks", "first", "place", filled.alias("filled"), "last", "last_words",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("i"))
    s = F.col("first") + F.col("i")
    slot = each.select(
        "shard", "k", _permuted(F.col("place") + F.col("i"), F.col("filled"), F.col("shard")).alias("place"),
        _permuted(s % F.col("blocks"), F.col("blocks"), F.col("k") + F.lit(BLOCK_KEY)).alias("block"),
        F.floor(s / F.col("blocks")).cast("int").alias("epoch"), F.when(s == F.col("last"), F.col("last_words")).otherwise(block).alias("room"))
    end = F.col("begin") + F.col("size")
    pieces = placed(docs_k, sum(r["rows"] for r in order)).select(
        *KEY, "k", "begin", end.alias("end"), F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((end - 1) / block))).alias("block"))
    low, high = F.greatest("begin", F.col("block") * block), F.least("end", (F.col("block") + 1) * block)
    pieces = pieces.select(*KEY, "k", "block", (low - F.col("begin")).alias("start"), (high - low).alias("n"), (low - F.col("block") * block).alias("at"))
    return slot.join(pieces, ["k", "block"]).where("at < room").withColumn("n", F.least("n", F.col("room") - F.col("at"))).drop("room")


def texts(docs: DataFrame, mixed: DataFrame, names: list) -> DataFrame:
    """The mixture itself: shard, place, source, epoch, doc_ids, n_words, text of every slot; a document's words are cut where it lies."""
    spark = docs.sparkSession
    wanted = mixed.groupBy(*KEY).agg(F.collect_list(F.struct("shard", "place", "k", "epoch", "start", "n", "at")).alias("pieces"))
    once = keyed(docs).dropDuplicates(list(KEY))
    cutting = left_by_key(once, wanted).where("pieces is not null").select("doc_id", split_words(F.col("text")).alias("w"), "pieces")
    part = F.transform("pieces", lambda p: F.struct(
        p["shard"].alias("shard"), p["place"].alias("place"), p["k"].alias("k"), p["epoch"].alias("epoch"), p["at"].alias("at"), p["n"].alias("n"),
        F.array_join(F.slice("w", p["start"].cast("int") + 1, p["n"].cast("int")), " ").alias("text")))
    rows = cutting.select("doc_id", F.explode(part).alias("p")).select("doc_id", "p.*")
    filled = rows.groupBy("shard", "place", "k", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("at", "doc_id", "text"))).alias("x"), F.sum("n").alias("n_words"))
    named = spark.createDataFrame([(k, r.source) for k, r in enumerate(names)], "k int, source string")
    return filled.join(named, "k").select(
        "shard", "place", "source", "epoch", F.col("x.doc_id").alias("doc_ids"), "n_words", F.array_join("x.text", " ").alias("text"))


def mixture(docs: DataFrame) -> DataFrame:
    """The mixture of all of `docs` as blocks of text; no rows if there are no words."""
    docs_k, order, goal = measured(docs)
    return texts(docs, mix(docs_k, order, goal), order)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: per document its size, its source's size and target, and the words the mixture takes from it."""
    docs_k, order, goal = measured(docs)
    facts = docs.sparkSession.createDataFrame(
        [(k, r["size"], t) for k, (r, t) in enumerate(zip(order, goal, strict=True))], "k int, source_size long, target double")
    copies = docs_k.groupBy(*KEY).agg(F.count("*").alias("copies"))
    taken = mix(docs_k, order, goal).groupBy(*KEY).agg(F.sum("n").alias("all"))
    out = left_by_key(left_by_key(docs_k.join(facts, "k"), taken), copies)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce((F.col("all") / F.col("copies")).cast("long"), F.lit(0)).alias("taken"))


__all__ = ["BLANK_WORD", "digest", "draw", "drawn", "measured", "mix", "mixture", "permuted", "quota", "targets", "texts"]
