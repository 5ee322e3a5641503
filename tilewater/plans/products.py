"""Whole jobs composed from the operators: tile pyramids, region renders, comparison with mapped polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewater.operators import geometry, joins, mosaic, resample, validation
from tilewater.operators.generators import bbox_tile_cover
from tilewater.sources import tiles as T

C = F.col


def build_pyramid(boxes: DataFrame, sources: DataFrame, zmin: int, zmax: int, path: str, layer: str, version: str, size: int = 256,
                  order: str | None = None) -> None:
    """Cover -> drop tiles the target holds -> mosaic -> encode -> write. Running it again writes only what is missing."""
    key = ["z", "x", "y"]
    wanted = bbox_tile_cover(boxes, zmin, zmax).select(*key).distinct()
    within = (C("layer") == layer) & (C("dataset_version") == version) & C("z").between(zmin, zmax)
    held = T.held_tiles(wanted.sparkSession, path, within)
    if held is not None:
        wanted = wanted.join(held.select(*key), key, "left_anti")
    packed = mosaic.mosaic_tiles(wanted, sources, size, order).select(*key, T.codes_of_heights(C("data")).alias("content"))
    named = packed.withColumns({"layer": F.lit(layer), "dataset_version": F.lit(version), "empty": F.lit(False)})
    T.sink_tiles(named, path, within=within)


def render_regions(pixels: DataFrame, regions: DataFrame, source_cells: DataFrame) -> DataFrame:
    """Tile pixels (z, x, y, row, col, lon, lat) sampled from overlapping region rasters, earlier regions first.

    `regions`: priority, id, west, south, east, north, dx, dy; `source_cells`: id, row, col, v.
    """
    hit = joins.point_regions(pixels, regions.select("*"))
    keyed = hit.withColumn("_sr", F.floor((C("north") - C("lat")) / C("dy")).cast("int")) \
        .withColumn("_sc", F.floor((C("lon") - C("west")) / C("dx")).cast("int"))
    src = source_cells.select("id", C("row").alias("_sr"), C("col").alias("_sc"), "v")
    layers = keyed.join(src, ["id", "_sr", "_sc"], "left").select("z", "x", "y", "row", "col", "priority", "v")
    return resample.mosaic_priority(layers, ["z", "x", "y", "row", "col"])


def compare_to_polygons(cells: DataFrame, rings: DataFrame, key: str, feet, all_touched: bool = True) -> DataFrame:
    """Rasterise reference polygons on the grid of `cells` (row, col, v) and score every threshold against them."""
    mask = geometry.covered_cells(rings, key, all_touched).withColumn("_m", F.lit(True))
    marked = cells.join(mask, ["row", "col"], "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
    counts = validation.confusion_counts(marked, "v", C("_m"), feet)
    return validation.random_baseline(validation.confusion_metrics(counts))
