"""Metrics on decoded pixel rows (frame, row, col, r, g, b, a)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col


def pixel_change(before: DataFrame, after: DataFrame, keys: list[str], threshold: int = 18) -> DataFrame:
    """Mean absolute channel change and share of pixels with any channel changed by at least `threshold`."""
    pick = lambda df, tag: df.select(*keys, "row", "col", *[C(c).alias(c + tag) for c in "rgb"])
    j = pick(before, "0").join(pick(after, "1"), [*keys, "row", "col"])
    d = [F.abs(C(c + "1") - C(c + "0")) for c in "rgb"]
    return j.groupBy(*keys).agg(
        ((F.avg(d[0]) + F.avg(d[1]) + F.avg(d[2])) / 3.0).alias("mean_abs_delta"),
        (F.count_if(F.greatest(*d) >= threshold) / F.count("*")).alias("changed_ratio"))


def pixel_richness(pixels: DataFrame, keys: list[str], blue_over_red: int = 22, blue_under_green: int = 12, dark: int = 16) -> DataFrame:
    """Distinct colours, share of bluish and of very dark pixels. Colours are counted first, then summed per frame."""
    per_color = pixels.groupBy(*keys, "r", "g", "b").agg(F.count("*").alias("n"))
    blue = (C("b") > C("r") + blue_over_red) & (C("b") >= C("g") - blue_under_green)
    black = (C("r") < dark) & (C("g") < dark) & (C("b") < dark)
    share = lambda cond: F.sum(F.when(cond, C("n")).otherwise(0)) / F.sum("n")
    return per_color.groupBy(*keys).agg(F.count("*").alias("colors"), share(blue).alias("blue_ratio"), share(black).alias("dark_ratio"))


def blank_ratio(pixels: DataFrame, keys: list[str], background: tuple[int, int, int], tolerance: int = 10, stride: int = 4) -> DataFrame:
    """Share of sampled pixels that are clear or background-coloured."""
    near = [F.abs(C(c) - v) <= tolerance for c, v in zip("rgb", background)]
    blank = (C("a") == 0) | (near[0] & near[1] & near[2])
    grid = pixels.where((C("row") % stride == 0) & (C("col") % stride == 0))
    return grid.groupBy(*keys).agg((F.count_if(blank) / F.count("*")).alias("blank_ratio"))


def depth_grid_summary(cells: DataFrame, keys: list[str], depth: Column, speed: Column) -> DataFrame:
    """Water mass, wet cells, extremes, bad-value counts and centre of mass of a depth grid."""
    bad = depth.isNull() | F.isnan(depth)
    d = F.when(~bad, F.greatest(F.lit(0.0), depth))
    mass = F.sum(d)
    center = lambda c: F.when(mass > 0, F.sum(C(c) * d) / mass)
    return cells.groupBy(*keys).agg(
        F.coalesce(mass, F.lit(0.0)).alias("mass"), F.count_if(d > 1e-4).alias("wet_cells"),
        F.coalesce(F.max(d), F.lit(0.0)).alias("max_depth"), F.coalesce(F.max(F.when(~bad, speed)), F.lit(0.0)).alias("max_speed"),
        F.count_if(bad).alias("bad_cells"), F.count_if(~bad & (depth < -1e-6)).alias("negative_cells"),
        center("col").alias("center_x"), center("row").alias("center_y"))
