"""Expressions and helpers shared by the corpus operators.

A row is known by its `doc_id` and the hash of its text together, so null ids, repeated rows and rows that share an id
but not a text each keep a result of their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewater.session import ensure_checkpoint_dir

#: fixed values: the word patterns of the contracts (letters, digits and everything beyond ASCII; anything but blanks)
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLANK_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

KEY = ("doc_id", "text_hash")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Texts without other letters take the faster way."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters, case kept; none for null. Cutting at gaps is twice as fast as matching."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), ALNUM_GAP), "")


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text_hash and text (null: empty) with the columns asked for; others are left behind, so names cannot clash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"), *more)


def left_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEY, safe: bool = True) -> DataFrame:
    """Left join on keys, null-safe unless told that they hold no null; `right` brings its other columns."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) if safe else F.col(k) == F.col(f"__{k}") for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(renamed, cond, "left").drop(*[f"__{k}" for k in keys])


def joined(df: DataFrame, small: DataFrame, on: str, rows: int, how: str = "inner") -> DataFrame:
    """Join with a side that is broadcast when it is counted to have at most `rows` rows, else left to the planner."""
    if small.limit(rows + 1).count() <= rows:
        small = F.broadcast(small)
    return df.join(small, on, how)


def array_lit(values: Sequence, kind: str) -> Column:
    """Array literal of a bounded Python sequence."""
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def stored(df: DataFrame) -> DataFrame:
    """`df` written once as a compressed table in the shared folder of `spark.checkpoint.dir` and read again, without its lineage."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstored(df: DataFrame) -> None:
    """Remove the table of a frame that `stored` returned, once nothing reads it any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
