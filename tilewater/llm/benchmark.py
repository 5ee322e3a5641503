"""Benchmark decontamination by winnowing.

Every run of `SPAN` words has `SPAN - GRAM + 1` k-grams; keeping the smallest k-gram hash of each such run on both sides
guarantees that a shared run of `SPAN` words leaves a shared fingerprint. Fingerprints meet in one equi-join; the documents hit
are then compared window by window, which both extends the hits and removes chance meetings of hashes.

Defined results: null or empty texts have no words and no hits; items without words never match; items shorter than `SPAN` are one
window and are looked up by their whole length; repeated items count once per id; rows are kept one to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tilewater.llm.common import ascii_lower, joined, keyed, left_by_key, words

SPAN, GRAM = 10, 5
#: benchmark fingerprints up to this many rows (16 MB) are broadcast; beyond it they are shuffled
BROADCAST_ROWS = 1_000_000


def _runs(values: Column, n: int, make, kind: str = "bigint") -> Column:
    """`make(i)` for the start i of every run of n values; empty if there are fewer."""
    return F.when(F.size(values) >= n, F.transform(F.sequence(F.lit(0), F.size(values) - n), make)).otherwise(
        F.array().cast(f"array<{kind}>"))


def _grams(hashes: str, n: int) -> Column:
    """Hash of each run of n words, from the column of the words' hashes."""
    return _runs(F.col(hashes), n, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(n)]))


def _hashed(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.transform(words(ascii_lower(F.col("text"))), lambda x: F.xxhash64(x)).alias("h"))


def fingerprints(df: DataFrame, *keys: str) -> DataFrame:
    """Winnowed fingerprints of `text`: one row for each key and distinct smallest hash."""
    width = SPAN - GRAM + 1
    grams = _hashed(df, *keys).select(*keys, _grams("h", GRAM).alias("g"))
    least = _runs(F.col("g"), width, lambda i: F.least(*[F.get("g", i + j) for j in range(width)]))
    return grams.select(*keys, least.alias("m")).select(*keys, F.explode(F.array_distinct("m")).alias("fp"))


def short_prints(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Hash of every run of n words, for items that are shorter than SPAN."""
    return _hashed(df, *keys).select(*keys, F.explode(F.array_distinct(_grams("h", n))).alias("fp"))


def windows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Every run of n words as text with the place of its first word."""
    w = df.select(*keys, words(ascii_lower(F.col("text"))).alias("w"))
    runs = _runs(F.col("w"), n, lambda i: F.array_join(F.slice("w", i + 1, n), " "), "string")
    return w.select(*keys, F.posexplode(runs).alias("at", "run")).withColumn("n", F.lit(n))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, at, n: every place where a window of an item occurs in a document."""
    docs = keyed(docs)
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    sized = items.withColumn("n", F.size(words(F.col("text")))).where("n > 0")
    lengths = [r.n for r in sized.select(F.least("n", F.lit(SPAN)).alias("n")).distinct().collect()]
    found = None
    for n in sorted(lengths):
        these = sized.where(F.col("n") >= SPAN if n == SPAN else F.col("n") == n).drop("n")
        prints = (lambda df, *k, n=n: fingerprints(df, *k) if n == SPAN else short_prints(df, n, *k))
        near = joined(prints(docs, "doc_id", "text_hash"), prints(these, "item_id").select("fp").distinct(), "fp", BROADCAST_ROWS)
        near = near.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
        texts = docs.join(near, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_semi")
        sought = windows(these, n, "item_id").select("run", "item_id").distinct()
        got = joined(windows(texts, n, "doc_id", "text_hash"), sought, "run", BROADCAST_ROWS // 10).drop("run")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return docs.where("false").select("doc_id", "text_hash", F.lit(0).alias("item_id"), F.lit(0).alias("at"), F.lit(0).alias("n"))
    return found


def summarise(places: DataFrame) -> DataFrame:
    """Per document: words covered by any hit, and the items hit. Overlapping places are merged by a running end."""
    spans = places.groupBy("doc_id", "text_hash", "at").agg(F.max("n").alias("n"))
    before = W.partitionBy("doc_id", "text_hash").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    ends = spans.withColumn("reached", F.coalesce(F.max(F.col("at") + F.col("n")).over(before), F.lit(0)))
    fresh = F.greatest(F.col("at") + F.col("n") - F.greatest("at", "reached"), F.lit(0))
    covered = ends.groupBy("doc_id", "text_hash").agg(F.sum(fresh).alias("n_hit"))
    named = places.select("doc_id", "text_hash", F.col("item_id").cast("string").alias("item")).distinct()
    items = named.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return left_by_key(covered, items)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each row of `docs` (doc_id, n_words) with n_hit, items (sorted ids as strings) and contaminated."""
    counted = keyed(docs).select("doc_id", "text_hash", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = left_by_key(counted, summarise(hits(docs, benchmark)))
    return out.select(
        "doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_hit", F.lit(0)).__gt__(0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` in which no benchmark window occurs, with all their columns."""
    hit = hits(docs, benchmark).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__t"))
    return docs.join(hit, same, "left_anti")
