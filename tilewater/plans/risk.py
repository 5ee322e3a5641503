"""Flagship plan: sample a tile set at points and classify flood risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewater.functions.values import flood_risk_class
from tilewater.operators.joins import sample_points
from tilewater.sources.tables import Tables


def risk_by_class(t: Tables) -> DataFrame:
    sampled = sample_points(t.points(), t.tile_rows(), zoom=9, tile_px=8)
    cls = flood_risk_class(F.col("v").cast("double"), F.col("water_level_m"), F.col("tile_found"))
    return sampled.groupBy(cls.alias("risk")).agg(
        F.count("*").alias("points"), F.round(F.avg("v"), 6).alias("mean_height"),
    )
