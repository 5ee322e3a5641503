"""Resampling on cell tables: nearest by floor, bilinear over four cells, nearest overviews, priority mosaics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.operators import drainage as D
from tilewater.session import written

C = F.col


def pair_nearest(source: DataFrame, target: DataFrame, step: float) -> DataFrame:
    """Source value (`v`) under the centre of every target cell; `step` is the target cell size in source cells."""
    at = lambda c: F.floor((C(c) + 0.5) * step).cast("int")
    keyed = target.withColumn("_sr", at("row")).withColumn("_sc", at("col"))
    src = source.select(C("row").alias("_sr"), C("col").alias("_sc"), "v")
    return keyed.join(src, ["_sr", "_sc"], "left").drop("_sr", "_sc")


def resample_nearest(pixels: DataFrame, source: DataFrame, x: Column, y: Column, left: float, top: float,
                     dx: float, dy: float, height: int, width: int) -> DataFrame:
    """Value of the source cell that holds each pixel centre; pixels outside the source or on NODATA drop out."""
    r, c = F.floor((F.lit(top) - y) / dy).cast("int"), F.floor((x - left) / dx).cast("int")
    keyed = pixels.withColumn("_sr", r).withColumn("_sc", c) \
        .where(C("_sr").between(0, height - 1) & C("_sc").between(0, width - 1))
    src = source.where(C("v").isNotNull()).select(C("row").alias("_sr"), C("col").alias("_sc"), "v")
    return keyed.join(src, ["_sr", "_sc"]).drop("_sr", "_sc")


def bilinear_sample(points: DataFrame, key: str, x: str, y: str, cells: DataFrame) -> DataFrame:
    """Weighted mean of the four cells around each point, valid cells only; NULL when none is valid."""
    x0, y0 = F.floor(C(x)).cast("int"), F.floor(C(y)).cast("int")
    tx, ty = C(x) - x0, C(y) - y0
    corner = lambda dy, dx, w: F.struct((y0 + dy).alias("row"), (x0 + dx).alias("col"), w.alias("w"))
    corners = F.array(corner(0, 0, (1.0 - tx) * (1.0 - ty)), corner(0, 1, tx * (1.0 - ty)),
                      corner(1, 0, (1.0 - tx) * ty), corner(1, 1, tx * ty))
    spread = points.select(key, F.explode(corners).alias("_k")).select(key, "_k.*")
    j = spread.join(cells.select("row", "col", "v"), ["row", "col"], "left")
    weight = F.sum(F.when(C("v").isNotNull(), C("w")))
    return j.groupBy(key).agg(F.when(weight > 0, F.sum(C("v") * C("w")) / weight).alias("v"))


def zero_dominant_mask(cells: DataFrame, patch: list[str], share: float = 0.90) -> DataFrame:
    """Zeros become NULL in patches where they make up at least `share` of the cells."""
    stats = cells.groupBy(*patch).agg((F.count_if(C("v") == 0) / F.count("*") >= share).alias("_ocean"))
    return cells.join(stats, patch).withColumn("v", F.when(~(C("_ocean") & (C("v") == 0)), C("v")).otherwise(None)).drop("_ocean")


def mosaic_priority(layers: DataFrame, cell: list[str], priority: str = "priority") -> DataFrame:
    """First valid value per cell in priority order. Partial aggregation keeps one candidate per cell and task."""
    valid = C("v").isNotNull()
    return layers.groupBy(*cell).agg(
        F.min_by(F.when(valid, C("v")), F.when(valid, C(priority))).alias("v"),
        F.min(F.when(valid, C(priority))).alias("from_priority"))


def overview_pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """Nearest overviews: level k keeps every 2^k-th row and column. One pass over the cells, no shuffle.

    A cell at (row, col) appears in every level up to the number of times 2 divides both indices.
    """
    level = F.explode(F.sequence(F.lit(1), F.lit(levels)))
    step = F.pow(F.lit(2), C("level")).cast("int")
    return cells.where("row % 2 = 0 AND col % 2 = 0").withColumn("level", level).withColumn("_s", step) \
        .where((C("row") % C("_s") == 0) & (C("col") % C("_s") == 0)) \
        .withColumn("row", F.floor(C("row") / C("_s")).cast("int")).withColumn("col", F.floor(C("col") / C("_s")).cast("int")).drop("_s")


def burn_streams(cells: DataFrame, streams: DataFrame, depth: float) -> DataFrame:
    """Lower the terrain on stream cells by `depth`."""
    marked = streams.select("row", "col").distinct().withColumn("_s", F.lit(True))
    return cells.join(marked, ["row", "col"], "left") \
        .withColumn("v", F.when(C("_s"), C("v") - depth).otherwise(C("v"))).drop("_s")


def relief_height(elevation: Column, low: Column, span: Column, exaggeration: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (elevation - low) / span))
    return (t - 0.42) * 0.58 * exaggeration


_VOID = float(np.finfo(np.float64).max)  # stands for NODATA inside blocks, where NaN is a cell that does not exist


def surface_gradient(cells: DataFrame, flat: float, block: int = 256) -> DataFrame:
    """Unit normal (nx, ny, nz) and downhill direction (fx, fy) from the four neighbours, for every cell (row, col, v).

    A side outside the grid takes the cell's own height; a NODATA side (NULL or NaN) adds nothing to the downhill direction and leaves no normal.
    Cells travel as blocks, which send only their border cells to each other.
    """
    height = C("v").cast("double")
    coded = cells.select("row", "col", F.when(height.isNull() | F.isnan(height), _VOID).otherwise(height).alias("v"))
    new = ["nx", "ny", "nz", "fx", "fy"]

    def slopes(b: dict) -> dict[str, bytes]:
        z = D._padded(b, "v", block, np.nan)
        known = np.where(z == _VOID, np.nan, z)
        part = lambda a, dr, dc: a[1 + dr:block + 1 + dr, 1 + dc:block + 1 + dc]
        side = lambda dr, dc: np.where(np.isnan(part(z, dr, dc)), part(known, 0, 0), part(known, dr, dc))
        dx, dy = side(0, -1) - side(0, 1), side(-1, 0) - side(1, 0)
        gx, gy = np.nan_to_num(dx), np.nan_to_num(dy)
        length, run = np.sqrt(dx ** 2 + flat ** 2 + dy ** 2), np.sqrt(gx ** 2 + gy ** 2)
        still = run < 0.0001
        down = lambda g, rest: np.where(still, rest, g / np.where(still, 1.0, run))
        return {n: a.astype("<f8").tobytes() for n, a in zip(new, (dx / length, flat / length, dy / length, down(gx, 0.72), down(gy, 0.36)))}

    b = D._with_ring(written(D.to_blocks(coded, block, {"v": "real"})), block, "v")
    return D.to_cells(D._add(b, slopes, new), block, {"v": "real", **{n: "real" for n in new}}, where="v").drop("v")


def banded_blocks(cells: DataFrame, band_rows: int, overlap: int) -> DataFrame:
    """Replicate cells into row bands with an overlap on both sides; `interior` marks the cells a band owns."""
    first = F.greatest(F.lit(0), F.floor((C("row") - overlap) / band_rows).cast("int"))
    last = F.floor((C("row") + overlap) / band_rows).cast("int")
    return cells.withColumn("band", F.explode(F.sequence(first, last))) \
        .withColumn("interior", F.floor(C("row") / band_rows).cast("int") == C("band"))
