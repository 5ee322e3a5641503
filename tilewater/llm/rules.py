"""Quality rules with adaptive thresholds, in DataFrame functions.

Each text gets a few whole numbers (word length, symbols, repeated lines, repeated words). Of the documents that pass the base rules, every
language and source keeps a mergeable quantile sketch of each number: counts by bucket, buckets being exact up to 2 * `STEPS` and 1 / `STEPS`
wide beyond it, so sketches are added up by one `groupBy` with map-side combine whatever the order. Limits lie `REACH` spreads outside the
quartiles; a source with fewer than `LEAST` documents takes those of its language, and that those of all. The limits are
joined back by language and source.

Defined results: null and empty texts have no words and fail the base; a null language or source is a group like any other; rows are kept one to
one, whatever their ids; an empty table gives no rows. Words, lines and windows are taken from whole texts; windows are compared by
64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewater.llm.common import array_lit, stored

#: fixed values: what stands between words, the symbols counted, the base rules
BLANK_GAP, NOT_BLANK = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
NO_SYMBOLS = r"[^#*$%&|<>]+"
LEAST_WORDS, MOST_REPEATED = 50, 50

#: relative width of a bucket is 1 / STEPS; documents a group needs for limits of its own; spreads between quartile and limit
STEPS, LEAST, REACH = 64, 200, 3
#: metric -> least spread in its own unit (thousandths of a code point, millionths, thousandths); whether low values fail too
METRICS = {"word_length": (500, True), "symbol_share": (5_000, False), "line_share": (100, False), "repeat_share": (100, False)}


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK_GAP), "")


def measured(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """`keep` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of every row of `docs` (text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("__text"))
    names = [c for c in df.columns if c != "__text"]
    t = F.col("__text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(NOT_BLANK)))
    df = df.select(*names, _split(t).alias("__v"), lines.alias("__l"),
                   F.char_length(F.regexp_replace(t, NO_SYMBOLS, "")).cast("long").alias("n_symbols"))
    names += ["n_symbols"]
    df = df.select(*names, F.transform("__v", lambda x: F.xxhash64(x)).alias("__w"), "__l",
                   F.char_length(F.array_join("__v", "")).cast("long").alias("word_chars"))
    names += ["word_chars"]
    windows = F.when(F.size("__w") >= 3, F.transform(
        F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))))
    df = df.select(
        *names, F.size("__w").cast("long").alias("n_words"), F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), windows.alias("__g"))
    names += ["n_words", "n_lines", "n_dup_lines"]
    # equal windows stand side by side once sorted; the places of those that have an equal neighbour are sorted again
    some = F.size(F.array_distinct("__g")) < F.size("__g")
    ranked = F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    df = df.select(*names, F.when(some, ranked).alias("__s"))
    same = lambda x, i: F.coalesce(F.get("__s", i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("__s", i + 1)["h"] == x["h"], F.lit(False))
    df = df.select(*names, F.sort_array(F.transform(F.filter("__s", same), lambda x: x["p"])).alias("__p"))
    step = lambda acc, x: F.struct((acc["n"] + F.least(x - acc["at"], F.lit(3))).alias("n"), x.alias("at"))
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at"))  # a word that several windows hold counts once
    repeated = F.aggregate("__p", start, step, lambda acc: acc["n"])
    return df.select(*names, F.coalesce(repeated, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def shares() -> dict[str, Column]:
    """The whole numbers that limits are set for, from the columns of `measured`."""
    part = lambda unit, a, b: F.expr(f"coalesce({unit} * {a} div nullif({b}, 0), 0)")
    return {
        "word_length": part(1_000, "word_chars", "n_words"), "symbol_share": part(1_000_000, "n_symbols", "word_chars"),
        "line_share": part(1_000, "n_dup_lines", "n_lines"), "repeat_share": part(1_000, "n_repeat_words", "n_words"),
    }


def bucket(v: Column) -> Column:
    """Lower edge of the bucket of a whole number from 0."""
    low = F.greatest(F.length(F.bin(v)) - F.length(F.bin(F.lit(STEPS))), F.lit(0))
    width = F.pow(F.lit(2.0), low).cast("long")
    return v - v % width


def sketches(rows: DataFrame, groups: Sequence[str], names: Sequence[str]) -> DataFrame:
    """groups, metric, bucket, count of the whole-number columns `names`."""
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(F.col(k)).alias("bucket")) for k in names])).alias("x")
    return rows.select(*groups, one).select(*groups, "x.metric", "x.bucket").groupBy(*groups, "metric", "bucket").agg(F.count("*").alias("count"))


def merged(sketch: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups, added up from those of finer ones."""
    return sketch.groupBy(*groups, "metric", "bucket").agg(F.sum("count").alias("count"))


def quartiles(sketch: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, metric, n, q1, q3: lower edges of the buckets in which a quarter and three quarters of the counts are reached."""
    by = [*groups, "metric"]
    run = sketch.withColumn("upto", F.sum("count").over(W.partitionBy(*by).orderBy("bucket"))).withColumn("n", F.sum("count").over(W.partitionBy(*by)))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("n"), F.col("bucket")))
    return run.groupBy(*by).agg(F.max("n").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def fences(found: DataFrame, groups: Sequence[str], metrics: dict[str, tuple[int, bool]]) -> DataFrame:
    """groups, n, limits: array of metric, low and high (null: none on that side)."""
    table = F.map_from_arrays(array_lit(list(metrics), "string"), array_lit([s for s, _ in metrics.values()], "bigint"))
    both = F.col("metric").isin([k for k, (_, two) in metrics.items() if two])
    spread = F.greatest(F.col("q3") - F.col("q1"), F.element_at(table, F.col("metric")))
    limit = F.struct("metric", F.when(both, F.col("q1") - REACH * spread).alias("low"), (F.col("q3") + REACH * spread).alias("high"))
    return found.groupBy(*groups).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(limit)).alias("limits"))


def _same(names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in names:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return cond


def limits(rows: DataFrame, groups: Sequence[str] = ("lang", "source"), metrics: dict[str, tuple[int, bool]] = METRICS) -> DataFrame:
    """groups, limits of every group in `rows`: its own from LEAST rows on, else those of fewer leading columns, at last those of all."""
    fine = stored(sketches(rows, groups, list(metrics)))
    out = fences(quartiles(fine, groups), groups, metrics).withColumnsRenamed({"n": "n_", "limits": "own"})
    chosen = F.when(F.col("n_") >= LEAST, F.col("own"))
    for k in range(len(groups) - 1, 0, -1):
        some = groups[:k]
        level = fences(quartiles(merged(fine, some), some), some, metrics)
        level = level.select(*[F.col(c).alias(f"{c}_") for c in some], F.when(F.col("n") >= LEAST, F.col("limits")).alias(f"by_{k}"))
        out = out.join(level, _same(some), "left").drop(*[f"{c}_" for c in some])
        chosen = F.coalesce(chosen, F.col(f"by_{k}"))
    whole = fences(quartiles(merged(fine, ()), ()), (), metrics).select(F.col("limits").alias("whole"))
    out = out.crossJoin(F.broadcast(whole))  # one row: of a global aggregate
    return out.select(*groups, F.coalesce(chosen, F.col("whole")).alias("limits"))


def judged(docs: DataFrame, *keep: str) -> DataFrame:
    """`keep` with the counts of `measured`, base_failed, reasons (names of the metrics beyond their limits) and kept."""
    names = [f"keep_{i}" for i in range(len(keep))]
    own = [F.col(c).alias(k) for c, k in zip(keep, names, strict=True)]
    rows = measured(docs, *own, "lang", "source").withColumns(shares()).withColumn("base_failed", base_failed())
    rows = stored(rows)
    table = stored(limits(rows.where(~F.col("base_failed")))).select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), "limits")
    value = F.create_map(*[x for k in METRICS for x in (F.lit(k), F.col(k))])
    out = rows.join(table, _same(("lang", "source")), "left").withColumn("values", value)
    beyond = lambda x: (F.col("values")[x["metric"]] > x["high"]) | F.coalesce(F.col("values")[x["metric"]] < x["low"], F.lit(False))
    reasons = F.coalesce(F.transform(F.filter("limits", beyond), lambda x: x["metric"]), F.array().cast("array<string>"))
    return out.withColumn("reasons", reasons).select(
        *[F.col(k).alias(c) for c, k in zip(keep, names, strict=True)], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "reasons", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return judged(docs, "doc_id").drop("reasons")
