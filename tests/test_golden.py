"""Known values: addresses, covers, encodings, histograms, confusion metrics, classes."""

import math

import pytest
from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.functions import colors as K
from tilewater.functions import geodesy as G
from tilewater.functions import text as X
from tilewater.functions import values as V
from tilewater.operators import coverage as C
from tilewater.operators import generators as N
from tilewater.operators import raster_stats as R
from tilewater.operators import validation as Q

BOX = "name string, west double, south double, east double, north double"


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_known_tiles(spark):
    r = one(spark, nyc=A.tile_x(F.lit(-74.0060), F.lit(10)), tx=A.tile_x(F.lit(-82.4572), F.lit(10)), ty=A.tile_y(F.lit(27.9506), F.lit(10)),
            p=A.tile_pixel(F.lit(-86.8025), F.lit(33.5207), F.lit(12)))
    assert (r.nyc, r.tx, r.ty) == (301, 277, 429)
    assert (r.p.x, r.p.y) == (1060, 1642) and 0 <= r.p.px < 256 and 0 <= r.p.py < 256


def test_cover_and_pyramid_counts(spark):
    b = spark.createDataFrame([("bham", -87.02, 33.30, -86.52, 33.75)], BOX)
    n = {r.z: r["count"] for r in N.bbox_tile_cover(b, 9, 12).groupBy("z").count().collect()}
    assert n == {9: 2, 10: 6, 11: 16, 12: 49}
    conus = spark.createDataFrame([("conus", -125.0, 24.0, -66.5, 49.5)], BOX)
    total = C.pyramid_estimate(conus, "name", 9, 14).where("name IS NULL").first()
    assert total.tiles == 5_243_329 and total.raw_bytes == 5_243_329 * 131072


def test_shards_partition_the_tiles(spark):
    t = spark.range(500).select(F.lit(12).alias("z"), (1000 + F.col("id") % 37).cast("int").alias("x"), (1600 + F.col("id") % 29).cast("int").alias("y"))
    s = [r.s for r in t.select(A.tile_shard(F.col("z"), F.col("x"), F.col("y"), 2).alias("s")).collect()]
    assert len(s) == 500 and set(s) == {0, 1}


def test_parent_contains_child(spark):
    x, y, z = F.lit(1060), F.lit(1642), F.lit(12)
    b = A.tile_bounds(x, y, z)
    p = A.tile_bounds(A.ancestor(x, 1), A.ancestor(y, 1), F.lit(11))
    r = one(spark, b=b, p=p)
    assert r.p.top >= r.b.top and r.p.bottom <= r.b.bottom and r.p.left <= r.b.left and r.p.right >= r.b.right


def test_encode_elevation_every_metre(spark):
    import numpy as np

    v = np.arange(-500, 9001)
    got = spark.range(-500, 9001).select(V.encode_elevation(F.col("id").cast("int"), "v1").alias("a"), V.encode_elevation(F.col("id").cast("int"), "f32").alias("b")).toPandas()
    v1 = ((v.astype(np.int16) + np.float64(500)) / 9500 * 65534).astype(np.float32).astype(np.uint16)
    f32 = (((v.astype(np.float32) + np.float32(500)) / np.float32(9500)) * np.float32(65534)).astype(np.uint16)
    assert (got.a.to_numpy() == v1).all() and (got.b.to_numpy() == f32).all()
    assert int((v1 != f32).sum()) == 10


def test_encode_edges(spark):
    rows = [(-500.0, 0), (9000.0, 65534), (float("nan"), 65535), (-32768.0, 65535), (9001.0, 65535), (None, 65535)]
    d = spark.createDataFrame([(v,) for v, _ in rows], "v double").select(V.encode_elevation(F.col("v"), "f32").alias("c"))
    assert [r.c for r in d.collect()] == [c for _, c in rows]
    hand = [(0.0, 0), (1.24, 12), (float("nan"), 65535), (-1.0, 65535), (-9999.0, 65535), (7000.0, 65534)]
    d = spark.createDataFrame([(v,) for v, _ in hand], "v double").select(V.encode_hand(F.col("v"), -9999.0).alias("c"))
    assert [r.c for r in d.collect()] == [c for _, c in hand]


def _grid(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_histogram_summary(spark):
    g = _grid(spark, [(0,), (10,), (20,), (20,), (None,), (None,)], "v int")
    s = R.histogram_summary(R.code_histogram(g), g.agg(F.count("*").alias("total_cells"))).first()
    assert (s.valid_cells, s.nodata_cells, s.min_m, s.p50_m, s.p95_m, s.p99_m, s.max_m, s.below_3ft) == (4, 2, 0.0, 1.0, 2.0, 2.0, 2.0, 1)


def test_empty_histogram(spark):
    g = _grid(spark, [(None,)], "v int")
    s = R.histogram_summary(R.code_histogram(g), g.agg(F.count("*").alias("total_cells"))).first()
    assert (s.valid_cells, s.valid_fraction, s.p50_m, s.below_30ft_fraction) == (0, 0.0, None, 0.0)


CONF = [(2, True, 0.0), (5, False, 1.0), (10, True, 2.0), (20, False, 3.0), (30, False, 4.0), (None, True, 5.0)]


def test_confusion_metrics(spark):
    # five valid cells, two of them in the reference, one of those under one foot together with no other
    g = _grid(spark, [(2, True, 0.0), (10, False, 1.0), (10, True, 2.0), (20, False, 3.0), (30, False, 4.0), (None, True, 5.0)], "v int, m boolean, e double")
    c = Q.confusion_counts(g, "v", F.col("m"), [1.0])
    m = Q.random_baseline(Q.confusion_metrics(c)).first()
    assert (m.valid, m.tp, m.precision, m.recall) == (5, 1, 1.0, 0.5)
    assert m.random_precision == pytest.approx(0.4) and m.precision_lift == pytest.approx(2.5)
    assert m.tp + m.fp + m.fn + m.tn == m.valid
    b = Q.same_coverage_baseline(g, "v", "e", F.col("m"), [1.0]).first()
    assert (b.cells, b.cutoff, b.base_precision) == (1, 0.0, 1.0)


def test_empty_threshold(spark):
    g = _grid(spark, [(20, True, 1.0), (30, False, 2.0)], "v int, m boolean, e double")
    m = Q.random_baseline(Q.confusion_metrics(Q.confusion_counts(g, "v", F.col("m"), [1.0]))).first()
    assert (m.hand, m.precision, m.precision_lift) == (0, None, None)
    b = Q.same_coverage_baseline(g, "v", "e", F.col("m"), [1.0]).first()
    assert (b.cells, b.cutoff, b.precision_lift) == (None, None, None)


def test_risk_levels_fall_with_height(spark):
    d = spark.range(0, 120).select(V.flood_risk_level(F.col("id") / 10.0, F.lit(1.0)).alias("r")).collect()
    levels = [r.r for r in d]
    assert levels == sorted(levels, reverse=True) and levels[0] == 1.0 and levels[-1] == 0.0
    r = one(spark, a=V.flood_risk_level(F.lit(7.0), F.lit(2.0)), b=V.flood_risk_level(F.lit(4.0), F.lit(2.0)), c=V.flood_risk_level(F.lit(2.5), F.lit(2.0)))
    assert (r.a, r.b, r.c) == (0.0, pytest.approx(0.33), pytest.approx(0.66))


def test_risk_class(spark):
    r = one(spark, low=V.flood_risk_class(F.lit(10.0), F.lit(1.0), F.lit(True)), water=V.flood_risk_class(F.lit(None).cast("double"), F.lit(1.0), F.lit(True)),
            unknown=V.flood_risk_class(F.lit(None).cast("double"), F.lit(1.0), F.lit(False)))
    assert tuple(r) == ("low", "water", "unknown")


def test_threshold_codes(spark):
    r = one(spark, a=V.threshold_code(F.lit(20.0), "round"), b=V.threshold_code(F.lit(20.0), "exact"), c=V.threshold_code(F.lit(3.0), "round"))
    assert tuple(r) == (61, 60, 9)


def test_one_decimal_text_equals_printf(spark):
    import random

    random.seed(3)
    vals = [0.25, 0.35, 2.25, 1.45, 1.15, -0.04, -2.5, 0.0, 12345.65, 0.05, -0.25] + [round(random.uniform(-50, 50), 2) for _ in range(3000)]
    d = spark.createDataFrame([(v,) for v in vals], "v double").select("v", X.fixed1(F.col("v")).alias("t"))
    assert [r.t for r in d.collect()] == [f"{v:.1f}" for v in vals]


def test_title_case_and_tags(spark):
    r = one(spark, a=X.coverage_label(F.lit(1), F.lit("basin-set-v0p21-huc6-010700")), b=X.coverage_label(F.lit(3), F.lit("x")), c=X.number_tag(F.lit(5.5)), d=X.number_tag(F.lit(-2.0)))
    assert tuple(r) == ("Basin Set V0P21 Huc6 010700", "3 regions", "5p5", "m2")


def test_albers_known_point(spark):
    # origin of the projection, and a round trip
    r = one(spark, o=G.ALBERS_CONUS.forward(F.lit(-96.0), F.lit(23.0)))
    assert abs(r.o.px) < 1e-6 and abs(r.o.py) < 1e-6


def test_slider(spark):
    r = one(spark, a=V.slider_water_level(F.lit(0.0)), b=V.slider_water_level(F.lit(50.0)), c=V.water_level_slider(F.lit(10.0)))
    assert (r.a, r.b, r.c) == (0.1, 10.0, pytest.approx(50.0))


def test_legend(spark):
    rows = spark.range(1).select(F.explode(K.legend_classes(F.lit(1.0))).alias("e")).select("e.*").collect()
    assert [r.label for r in rows] == ["Safe (>6.0m)", "Caution (3.0-6.0m)", "Danger (1.5-3.0m)", "Flooded (<1.5m)"]


def test_bad_arguments(spark):
    from tilewater.operators import planning, windows

    with pytest.raises(ValueError):
        A.tile_shard(F.lit(1), F.lit(1), F.lit(1), 0)
    with pytest.raises(ValueError):
        windows.prune_oldest(spark.range(1), -1)
    with pytest.raises(ValueError):
        planning.ingest_plan(spark.range(1), spark.range(1), prefix="0a")
    assert math.isclose(A.HALF_WORLD_M, 20037508.342789244)
