"""Rasters on grids that are told apart: equality of grids before cells are paired, and resampling of one grid onto another.

A grid places the corner of cell (row, col) at x = a * col + b * row + c and y = d * col + e * row + f, so it may be turned or sheared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.operators.joins import raster_pair
from tilewater.operators.resample import bilinear_sample

C = F.col
COEFFICIENTS = ("a", "b", "c", "d", "e", "f")
Grid = tuple[float, float, float, float, float, float]
Projection = Callable[[Column, Column], tuple[Column, Column]]


def grid_errors(left: DataFrame, right: DataFrame, raster: str, tolerance: float = 1e-6) -> DataFrame:
    """Per raster what keeps its two grids apart (`grid_error`), NULL where they are one: `shape`, `transform`, `crs`, comma-joined, or the
    side that lacks it (`not in left`, `not in right`).

    Both tables: raster (once each, not NULL), height, width, a to f, crs. Transforms are one when no cell is placed more than `tolerance` cells
    apart. Two NULLs are equal, a NULL and a value are not.
    """
    fields = ["height", "width", *COEFFICIENTS, "crs"]
    side = lambda df, tag: df.select(C(raster), *[C(n).alias(f"_{tag}_{n}") for n in fields], F.lit(True).alias(f"_{tag}"))
    j = side(left, "l").join(side(right, "r"), raster, "full")
    same = lambda n: C(f"_l_{n}").eqNullSafe(C(f"_r_{n}"))
    cell = F.greatest(*[F.abs(f"_l_{n}") for n in "abde"])
    reach = {"a": C("_l_width"), "d": C("_l_width"), "b": C("_l_height"), "e": C("_l_height")}
    near = F.lit(True)
    for n in COEFFICIENTS:
        apart = F.abs(C(f"_l_{n}") - C(f"_r_{n}")) * reach.get(n, F.lit(1))
        near = near & (same(n) | F.coalesce(apart <= tolerance * cell, F.lit(False)))
    differ = F.concat_ws(",", F.when(~(same("height") & same("width")), "shape"), F.when(~near, "transform"), F.when(~same("crs"), "crs"))
    return j.select(raster, F.when(C("_l").isNull(), "not in left").when(C("_r").isNull(), "not in right").otherwise(F.nullif(differ, F.lit(""))).alias("grid_error"))


def checked_pair(left: DataFrame, right: DataFrame, left_grids: DataFrame, right_grids: DataFrame, raster: str, value: str = "v") -> DataFrame:
    """`raster_pair` of many rasters (raster, row, col, value), but only where both grids are one; columns raster, row, col, a, b, grid_error.

    A raster whose grids differ gives a single row with its `grid_error` and no cell, so it cannot be scored by accident; so does one that has cells but
    no grid on either side (`no grid`).
    """
    errors = grid_errors(left_grids, right_grids, raster)
    named = left.select(raster).union(right.select(raster)).distinct()
    verdict = named.join(errors.withColumn("_grid", F.lit(True)), raster, "full") \
        .select(raster, F.when(C("_grid").isNull(), "no grid").otherwise(C("grid_error")).alias("grid_error"))
    fine, bad = verdict.where("grid_error IS NULL").select(raster), verdict.where("grid_error IS NOT NULL")
    paired = raster_pair(left.join(fine, raster, "left_semi"), right.join(fine, raster, "left_semi"), [raster, "row", "col"], value)
    return paired.withColumn("grid_error", F.lit(None).cast("string")).unionByName(bad, allowMissingColumns=True)


def center(grid: Grid, row: Column, col: Column) -> tuple[Column, Column]:
    """Map position of a cell's centre."""
    a, b, c, d, e, f = map(float, grid)
    x, y = col + 0.5, row + 0.5
    return x * a + y * b + c, x * d + y * e + f


def position(grid: Grid, x: Column, y: Column) -> tuple[Column, Column]:
    """(row, col) of a map position as fractions; cell (r, c) spans [r, r + 1) x [c, c + 1)."""
    a, b, c, d, e, f = map(float, grid)
    area = a * e - b * d
    if area == 0:
        raise ValueError("the grid has no area")
    return ((y - f) * a - (x - c) * d) / area, ((x - c) * e - (y - f) * b) / area


def resample_onto(target: DataFrame, target_grid: Grid, source: DataFrame, source_grid: Grid, project: Projection | None = None,
                  bilinear: bool = False) -> DataFrame:
    """Target cells (row, col and other columns) with `v`, the source value under their centre, NULL outside the source and on NODATA.

    `project` takes a position on the target's map to the source's. Nearest takes the cell that holds the centre; bilinear weighs the four cells whose
    centres lie around it and leaves out NODATA. Both are equi-joins on source cells, at any angle between the grids. (row, col) is unique in
    either table.
    """
    x, y = center(target_grid, C("row"), C("col"))
    row, col = position(source_grid, *(project(x, y) if project else (x, y)))
    if not bilinear:
        keyed = target.select("*", F.floor(row).cast("int").alias("_sr"), F.floor(col).cast("int").alias("_sc"))
        return keyed.join(source.select(C("row").alias("_sr"), C("col").alias("_sc"), "v"), ["_sr", "_sc"], "left").drop("_sr", "_sc")
    points = target.select(F.struct("row", "col").alias("_cell"), (col - 0.5).alias("_x"), (row - 0.5).alias("_y"))
    found = bilinear_sample(points, "_cell", "_x", "_y", source).select("_cell.row", "_cell.col", "v")
    return target.join(found, ["row", "col"])
