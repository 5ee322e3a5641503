"""Exact quantiles under the five rules in use, by rank over value counts.

Values are counted first (map-side combined), then ranked with a running total over distinct values. Whole
groups are never collected. For integer codes the histogram is bounded (`bounded=True`, at most 65,536 distinct values
per group), so an ordinary window over it is enough; otherwise the running total is range-partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewater.operators.joins import with_row
from tilewater.operators.ordered import Ordered

METHODS = ("linear", "nearest", "floor", "index", "exclusive")


def _ranks(n: Column, q: float, method: str) -> tuple[Column, Column, Column]:
    """Zero-based (low rank, high rank, weight of the high one) for quantile `q` of `n` sorted values."""
    if method == "linear":
        pos = (n - 1) * F.lit(q)
        lo = F.floor(pos)
        return lo, F.least(lo + 1, n - 1), pos - lo
    if method == "nearest":
        r = F.greatest(F.lit(0), F.least(F.ceil(n * F.lit(q)) - 1, n - 1))
        return r, r, F.lit(0.0)
    if method == "floor":
        r = F.least(n - 1, F.floor((n - 1) * F.lit(q)))
        return r, r, F.lit(0.0)
    if method == "index":
        r = F.least(n - 1, F.floor(n * F.lit(q)))
        return r, r, F.lit(0.0)
    if method == "exclusive":
        pos = (n + 1) * F.lit(q)
        j = F.greatest(F.lit(1), F.least(F.floor(pos), n - 1))
        return j - 1, F.least(j, n - 1), F.when(n > 1, pos - j).otherwise(0.0)
    raise ValueError(f"unknown quantile rule {method}")


def value_counts(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], keys: list[str] | None = None,
              method: str = "linear", bounded: bool = False) -> DataFrame:
    """One row per key with a double column per entry of `wanted` (name -> quantile in 0..1)."""
    keys = list(keys or [])
    counts = value_counts(df, value, keys)
    if bounded:
        w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_v")
        ranked = counts.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        ranked = Ordered(counts, keys, ["_v"]).running_total("_c", "_cum").result()
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = ranked.join(totals, keys) if keys else with_row(ranked, totals)
    lo_edge, hi_edge, n = F.col("_cum") - F.col("_c"), F.col("_cum"), F.col("_n")
    picks, outs = [], []
    for i, (name, q) in enumerate(wanted.items()):
        lo, hi, w_hi = _ranks(n, q, method)
        v = F.col("_v").cast("double")
        picks += [
            F.max(F.when((lo >= lo_edge) & (lo < hi_edge), v)).alias(f"_lo{i}"),
            F.max(F.when((hi >= lo_edge) & (hi < hi_edge), v)).alias(f"_hi{i}"),
            F.max(w_hi).alias(f"_w{i}"),
        ]
        a, b, w = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_w{i}")
        outs.append((a + (b - a) * w).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *outs)
