"""Composed jobs on small fixtures."""

import tempfile

import numpy as np
from pyspark.sql import functions as F

from tilewater.plans import products as P
from tilewater.sources import tiles as T


def test_pyramid_is_incremental(spark):
    h = T.HALF_PIXEL_DEG
    row = lambda lat, lon, v: (lat, lon, lon - h, lat - h, lon + 1 + h, lat + 1 + h, 16, 16, bytearray(np.full((16, 16), v, dtype="<i2").tobytes()))
    src = spark.createDataFrame([row(33, -87, 100), row(33, -88, 200)],
                                "lat int, lon int, left double, bottom double, right double, top double, height int, width int, data binary")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/tiles"
    box = lambda east: spark.createDataFrame([(-87.9, 33.1, east, 33.9)], "west double, south double, east double, north double")
    P.build_pyramid(box(-87.5), src, 7, 8, path, "elevation", "v1", size=8)
    first = spark.read.parquet(path).count()
    P.build_pyramid(box(-86.1), src, 7, 8, path, "elevation", "v1", size=8)
    r = spark.read.parquet(path)
    assert 0 < first < r.count() and r.count() == r.select("z", "x", "y").distinct().count()
    codes = T.decode_u16(r.withColumn("variant", F.lit("u16")), ["z", "x", "y"], size=64).select(F.explode("values").alias("c")).where("c IS NOT NULL").distinct()
    assert {x.c for x in codes.collect()} == {int(np.float32((v + 500) / 9500 * 65534)) for v in (100, 200)}


def test_regions_fill_in_priority_order(spark):
    px = spark.createDataFrame([(9, 1, 1, 0, c, -87.0 + c + 0.5, 33.5) for c in range(4)], "z int, x int, y int, row int, col int, lon double, lat double")
    reg = spark.createDataFrame([(0, "a", -87.0, 33.0, -85.0, 34.0, 1.0, 1.0), (1, "b", -87.0, 33.0, -84.0, 34.0, 1.0, 1.0)],
                                "priority int, id string, west double, south double, east double, north double, dx double, dy double")
    cells = spark.createDataFrame([("a", 0, 0, None), ("a", 0, 1, 7), ("b", 0, 0, 1), ("b", 0, 1, 2), ("b", 0, 2, 3)], "id string, row int, col int, v int")
    got = {r.col: (r.v, r.from_priority) for r in P.render_regions(px, reg, cells).collect()}
    assert got == {0: (1, 1), 1: (7, 0), 2: (3, 1)}
