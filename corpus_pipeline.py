"""Training-corpus pipeline: each stage reads what the one before it kept and returns the columns of documents; the last makes the mixture.

1. language ID: documents without a letter go, and those that need far more bits in every learnt language than held-out text of it, or are
   mostly in letters that no learnt language uses; the guess is written to `lang`.
2. near-dedup: one document of each group of near-duplicates stays (five-word shingles, similarity 0.8 or more).
3. decontamination: documents that hold a benchmark window go.
4. personal data: spans are replaced by their kind.
5. mixing: blocks of words, sources at their target weights, a row each with the ids of the documents it was cut from.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewater.llm import benchmark, language, mixing, near, private
from tilewater.llm.common import table
from tilewater.session import ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of `docs` in a learnt language, mixed ones too; learnt from their own labels, guessed from the text alone."""
    names = docs.columns
    pieces = language.sample(docs.select("doc_id", "text", "lang"))
    model = language.build(pieces)
    if not model.labels:
        return docs.limit(0)
    letters = language.alphabet(docs, model.labels)
    kept = language.fitting(docs, model, language.limits(pieces), letters)
    return kept.select(*[(F.col("lang_pred") if c == "lang" else F.col("row")[c]).alias(c) for c in names])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates."""
    return near.unique(docs, size=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window."""
    return benchmark.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data and secrets replaced by their kind in brackets."""
    return private.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the mixture: shard, place, source, epoch, doc_ids, n_words, text."""
    return mixing.mixture(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixing", mixture),
]

#: language ID and the permutations of the mixture cannot be said in SQL; tests compare with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
