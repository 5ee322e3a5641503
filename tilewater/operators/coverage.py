"""Coverage audits: summaries, extents, set differences, interior holes, pyramid estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.operators.joins import with_row

C = F.col


def coverage_summary(statuses: DataFrame) -> DataFrame:
    """Counters over tile statuses (has_elevation, overlapping, note, roads). Bad tiles are listed by `coverage_findings`."""
    return statuses.agg(
        F.count("*").alias("total"), F.count_if("has_elevation").alias("have_elevation"),
        F.coalesce(F.count_if("has_elevation") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("coverage_pct"),
        F.count_if(C("overlapping") > 0).alias("with_overlap"), F.count_if(C("overlapping") == 0).alias("no_overlap"),
        F.count_if(C("note") == "overlap-no-extract").alias("overlap_no_extract"),
        F.count_if(C("note").startswith("error:")).alias("errors"),
        F.count_if(C("roads") & ~C("has_elevation")).alias("suspect_gaps"))


def coverage_findings(statuses: DataFrame) -> DataFrame:
    """One row per (tile, problem); kept as rows so that the list can be of any length."""
    problems = F.array_compact(F.array(
        F.when(C("note") == "overlap-no-extract", "overlap-no-extract"), F.when(C("note").startswith("error:"), "error"),
        F.when(C("roads") & ~C("has_elevation"), "suspect-gap")))
    return statuses.select("z", "x", "y", "overlapping", "note", F.explode(problems).alias("problem"))


def union_bbox(boxes: DataFrame) -> DataFrame:
    return boxes.agg(F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"),
                     F.max("north").alias("north"))


def zoom_extent(tiles: DataFrame) -> DataFrame:
    """Tile ranges per zoom and their outline in degrees."""
    g = tiles.groupBy("z").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"),
                               F.max("y").alias("max_y"), F.count("*").alias("tiles"))
    a, b = A.tile_bounds(C("min_x"), C("min_y"), C("z")), A.tile_bounds(C("max_x"), C("max_y"), C("z"))
    return g.withColumn("north", a["top"]).withColumn("west", a["left"]).withColumn("south", b["bottom"]).withColumn("east", b["right"])


def rounded_ranges(boxes: DataFrame) -> DataFrame:
    """Distinct whole-degree latitude and longitude ranges, halves to even."""
    r = lambda c: F.rint(C(c)).cast("int")
    both = F.array(F.struct(F.lit("lat").alias("axis"), r("south").alias("low"), r("north").alias("high")),
                   F.struct(F.lit("lon").alias("axis"), r("west").alias("low"), r("east").alias("high")))
    return boxes.select(F.explode(both).alias("r")).select("r.*").distinct()


def bounds_check(a: DataFrame, b: DataFrame, key: str, tolerance: float = 0.0001) -> DataFrame:
    """Sides whose bounds differ by more than the tolerance, as one comma-separated list per key."""
    sides = ("north", "south", "east", "west")
    j = a.select(key, *[C(s).alias(f"a_{s}") for s in sides]).join(b.select(key, *[C(s).alias(f"b_{s}") for s in sides]), key)
    bad = F.array_compact(F.array(*[F.when(F.abs(C(f"a_{s}") - C(f"b_{s}")) > tolerance, s) for s in sides]))
    return j.select(key, F.array_join(bad, ",").alias("errors"), (F.size(bad) == 0).alias("valid"))


def zoom_size_summary(tiles: DataFrame) -> DataFrame:
    """Files and bytes per zoom by size class; the >100K class overlaps the >=20K one."""
    b = C("bytes")
    return tiles.groupBy("z").agg(
        F.count("*").alias("files"), F.sum(b).alias("bytes"), F.count_if(b < 5 * 1024).alias("lt5k"),
        F.count_if((b >= 5 * 1024) & (b < 20 * 1024)).alias("bt5_20k"), F.count_if(b >= 20 * 1024).alias("gt20k"),
        F.count_if(b > 100 * 1024).alias("gt100k"))


def pyramid_estimate(boxes: DataFrame, key: str, zmin: int, zmax: int, tile_bytes: int = 131072) -> DataFrame:
    """Tiles and raw bytes per (box, zoom), per box and in total (ROLLUP)."""
    z = C("z")
    r = boxes.withColumn("z", F.explode(F.sequence(F.lit(zmin), F.lit(zmax))))
    span = lambda lo, hi: F.greatest(F.lit(0), hi - lo + 1).cast("bigint")
    wide = span(A.tile_x_floor(C("west"), z, clamp=False), A.tile_x_floor(C("east"), z, clamp=False))
    tall = span(A.tile_y_floor(C("north"), z, clamp=False), A.tile_y_floor(C("south"), z, clamp=False))
    counted = r.select(key, "z", (wide * tall).alias("_n"))
    return counted.rollup(key, "z").agg(F.sum("_n").alias("tiles"), F.sum(C("_n") * tile_bytes).alias("raw_bytes"))


def source_raster_estimate(area_km2: Column, cell_m: Column) -> Column:
    """struct<cells,raw_bytes,with_overviews> of a two-byte raster over an area; overviews add a third."""
    cells = F.rint(area_km2 * 1000000 / (cell_m * cell_m)).cast("bigint")
    return F.struct(cells.alias("cells"), (cells * 2).alias("raw_bytes"), F.rint(cells * 2 * F.lit(4.0 / 3.0)).cast("bigint").alias("with_overviews"))


def coverage_set_diff(expected: DataFrame, present: DataFrame, on: list[str]) -> DataFrame:
    """Rows on one side only, tagged `missing` (expected, absent) or `extra` (present, not expected)."""
    missing = expected.select(*on).subtract(present.select(*on)).withColumn("side", F.lit("missing"))
    extra = present.select(*on).subtract(expected.select(*on)).withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def interior_holes(present: DataFrame) -> DataFrame:
    """Absent degree tiles inside the envelope of the present ones; suspicious with at least two present neighbours.

    The envelope is at most 180 x 360 squares, whatever the table size.
    """
    tiles = present.select("lat", "lon").distinct()
    env = tiles.agg(F.min("lat").alias("a0"), F.max("lat").alias("a1"), F.min("lon").alias("o0"), F.max("lon").alias("o1")).where("a0 IS NOT NULL")
    square = env.select(F.explode(F.sequence("a0", "a1")).alias("lat"), "o0", "o1").select("lat", F.explode(F.sequence("o0", "o1")).alias("lon"))
    holes = square.join(tiles, ["lat", "lon"], "left_anti")
    d = F.sequence(F.lit(-1), F.lit(1))
    around = tiles.withColumn("_a", F.explode(d)).withColumn("_o", F.explode(d)).where("_a <> 0 OR _o <> 0") \
        .groupBy((C("lat") + C("_a")).alias("lat"), (C("lon") + C("_o")).alias("lon")).agg(F.count("*").alias("neighbors"))
    return holes.join(around, ["lat", "lon"], "left").withColumn("neighbors", F.coalesce("neighbors", F.lit(0))) \
        .withColumn("suspicious", C("neighbors") >= 2)
