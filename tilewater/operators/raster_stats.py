"""Per-tile and per-raster aggregates. Everything is a partial + final hash aggregate; no group is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.functions import values as V
from tilewater.operators.joins import with_row

C = F.col


def gray_scale_minmax(cells: DataFrame, tile: list[str], max_holes: int = 0) -> DataFrame:
    """Stretch each tile to 0..255; tiles with more than `max_holes` NODATA cells, or flat ones, become 0."""
    stats = cells.groupBy(*tile).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"),
                                     F.count_if(C("v").isNull()).alias("_holes"))
    flat = (C("_holes") > max_holes) | (C("_hi") <= C("_lo"))
    stretched = ((F.coalesce("v", "_lo") - C("_lo")) / (C("_hi") - C("_lo")) * 255).cast("int")
    return cells.join(stats, tile).withColumn("gray", F.when(flat, 0).otherwise(stretched)).drop("_lo", "_hi", "_holes")


def tile_stats_u16(cells: DataFrame, tile: list[str]) -> DataFrame:
    """Raw code range and NODATA share; the maximum is 65535 when NODATA is present."""
    code = F.coalesce("v", F.lit(V.NODATA_U16))
    return cells.groupBy(*tile).agg(
        F.min(code).alias("min_code"), F.max(code).alias("max_code"),
        (F.count_if(C("v").isNull()) * 100.0 / F.count("*")).alias("nodata_pct"))


def dem_quality(cells: DataFrame, file: list[str], expected: int | None = None) -> DataFrame:
    """Range, NODATA share and zero share per file, with the cell-count check."""
    raw = F.coalesce("v", F.lit(V.NODATA_I16))
    out = [F.min(raw).alias("min"), F.max(raw).alias("max"),
           (F.count_if(raw == V.NODATA_I16) / F.count("*") * 100.0).alias("nodata_pct"),
           (F.count_if(raw == 0) / F.count("*") * 100.0).alias("zero_pct")]
    if expected is not None:
        out.append((F.count("*") == expected).alias("size_ok"))
    return cells.groupBy(*file).agg(*out)


def raster_stats(cells: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Range, mean and population deviation of the valid cells."""
    return cells.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
                                    F.stddev_pop(value).alias("stddev"))


def tile_relief_stats(cells: DataFrame, tile: list[str], metres: Column) -> DataFrame:
    """Elevation range per tile with the 0..120 m fallback for empty or flat tiles."""
    ok = F.when(metres >= -1000, metres)
    s = cells.groupBy(*tile).agg(F.min(ok).alias("_lo"), F.max(ok).alias("_hi"))
    usable = C("_hi") > C("_lo")
    return s.select(*tile, F.when(usable, C("_lo")).otherwise(0.0).alias("min_m"),
                    F.when(usable, C("_hi")).otherwise(120.0).alias("max_m"))


def wet_ratio(cells: DataFrame, tile: list[str], hand: Column, level: Column) -> DataFrame:
    wet = F.count_if(hand < level)
    return cells.groupBy(*tile).agg((wet > 0).alias("water_visible"), (wet / F.count("*")).alias("wet_ratio"))


def code_histogram(cells: DataFrame, keys: list[str] | None = None, value: str = "v") -> DataFrame:
    """Cells per code; partial counts per task, at most 65,535 codes per key in the shuffle."""
    return cells.where(C(value).isNotNull()).groupBy(*(keys or []), C(value).alias("code")).agg(F.count("*").alias("cells"))


def histogram_summary(hist: DataFrame, total_cells: DataFrame) -> DataFrame:
    """Fractions, nearest-rank percentiles and low-threshold counts from a code histogram.

    `total_cells` is one row with `total_cells`. The histogram is bounded by the code range.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy("code")  # at most 65,535 rows
    n = F.sum("cells").over(Window.partitionBy(F.lit(0)))
    ranked = hist.withColumn("_n", n).withColumn("_cum", F.sum("cells").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def nearest(q: float) -> Column:
        rank = F.greatest(F.lit(0), F.least(F.ceil(C("_n") * q) - 1, C("_n") - 1))
        return (F.min(F.when(C("_cum") > rank, C("code"))) / 10.0)

    aggs = [F.coalesce(F.sum("cells"), F.lit(0)).alias("valid_cells"), (F.min("code") / 10.0).alias("min_m"),
            nearest(0.50).alias("p50_m"), nearest(0.95).alias("p95_m"), nearest(0.99).alias("p99_m"),
            (F.max("code") / 10.0).alias("max_m")]
    for ft in V.REPORT_FEET:
        code = V.threshold_code(F.lit(float(ft)), "round")
        aggs.append(F.coalesce(F.sum(F.when(C("code") <= code, C("cells"))), F.lit(0)).alias(f"below_{ft}ft"))
    s = with_row(ranked.agg(*aggs), total_cells)
    frac = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return s.select(
        "total_cells", "valid_cells", (C("total_cells") - C("valid_cells")).alias("nodata_cells"),
        frac(C("valid_cells"), C("total_cells")).alias("valid_fraction"),
        frac(C("total_cells") - C("valid_cells"), C("total_cells")).alias("nodata_fraction"),
        "min_m", "p50_m", "p95_m", "p99_m", "max_m",
        *[C(f"below_{ft}ft") for ft in V.REPORT_FEET],
        *[frac(C(f"below_{ft}ft"), C("valid_cells")).alias(f"below_{ft}ft_fraction") for ft in V.REPORT_FEET])


def with_thresholds(df: DataFrame, feet) -> DataFrame:
    """Fan a (small, aggregated) table out to one row per threshold in feet."""
    return df.withColumn("threshold_ft", F.explode(F.array(*[F.lit(float(f)) for f in feet])))


def threshold_counts(cells: DataFrame, value: str, feet, masks: dict[str, Column] | None = None) -> DataFrame:
    """One scan, one row out: how many valid cells sit at or under each threshold, alone and within each mask.

    Columns: valid, low_<i>, and for each mask name: <name>, low_<i>_<name>. Thresholds are expanded to columns instead
    of joined in, so the cell table is read once and nothing but one row per task is shuffled.
    """
    valid = C(value).isNotNull()
    aggs = [F.count_if(valid).alias("valid")]
    masks = masks or {}
    aggs += [F.count_if(valid & m).alias(n) for n, m in masks.items()]
    for i, ft in enumerate(feet):
        low = valid & (C(value) <= float(ft) * V.FEET_TO_M * 10.0)
        aggs.append(F.count_if(low).alias(f"low_{i}"))
        aggs += [F.count_if(low & m).alias(f"low_{i}_{n}") for n, m in masks.items()]
    return cells.agg(*aggs)


def threshold_coverage(cells: DataFrame, value: str, feet) -> DataFrame:
    """Cells and share at or below each threshold."""
    c = threshold_counts(cells, value, feet)
    rows = F.array(*[F.struct(F.lit(float(ft)).alias("threshold_ft"), C(f"low_{i}").alias("cells")) for i, ft in enumerate(feet)])
    return c.select("valid", F.explode(rows).alias("r")).select(
        "r.threshold_ft", C("valid").alias("valid_cells"), "r.cells",
        F.when(C("valid") > 0, C("r.cells") * 100.0 / C("valid")).alias("coverage_pct"))
