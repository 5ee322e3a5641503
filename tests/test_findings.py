"""Small cases of what a reviewer found on larger tables."""

from pyspark.sql import functions as F

from tilewater.operators import validation as Q


def test_band_borders_end_below_the_height(spark):
    rows = [(r, 50, 100, 200) for r in (-30, 0, 3, 26, 27, 33, 34, 60, 88, 93, 94, 117, 120, 150)]
    d = spark.createDataFrame(rows, "row int, col int, v int, cand int")
    got = Q.diff_attribution(d, "v", "cand", F.lit(False), height=101, band_rows=30, edge=3, drain_dm=60, limit_dm=8).first()
    near = [r for r, *_ in rows if min(abs(r - b) for b in (30, 60, 90)) <= 3]
    assert (got["gt_1m"], got["at_band"]) == (len(rows), len(near))


def test_drain_mask_joins_no_cells_and_area_runs_one_python(spark):
    from tilewater.operators import drainage as D
    from tilewater.plans import registry
    from tilewater.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    plan = registry.load()["drain_mask"].run(t)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    for key in ("drain_mask", "upstream_area", "flow_direction_d8"):  # each further Python of a task is memory of an executor
        df = registry.load()[key].run(t)
        assert df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    cells = spark.createDataFrame([(r, c, float(r * c % 7)) for r in range(9) for c in range(70)], "row int, col int, v double")
    two = D.upstream_area(D.flow_direction_d8(cells, block=8), 1.0, 8)
    one = D.upstream_area_of_heights(cells, "v", 1.0, 8)
    assert sorted(two.collect()) == sorted(one.collect())


def _ring(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def test_equal_lines_and_polygons_meet_once(spark):
    from tilewater.operators import geometry as G

    square = lambda a, b: _ring((a, a), (a, b), (b, b), (b, a), (a, a))
    polys = spark.createDataFrame([(i, square(1, 9)) for i in range(50)] + [(i + 50, square(3, 7)[::-1]) for i in range(50)], "id int, pts array<struct<x:double,y:double>>")
    lines = spark.createDataFrame([(3 * i + k, _ring(*at)) for i in range(40) for k, at in enumerate((((2, 2), (2.5, 2)), ((0, 5), (5, 5)), ((30, 30), (31, 30))))],
                                  "line int, pts array<struct<x:double,y:double>>")
    met = G.lines_meeting(lines, "line", polys, "id")
    assert sorted(r.line for r in met.collect()) == [x for x in range(120) if x % 3 < 2]
    # what is left of the search after its written parts joins lines with distinct shapes, by merging
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_cx" not in plan and "strategy=merge" in plan


def test_hole_of_many_vertices(spark):
    import math
    import time

    from tilewater.operators import geometry as G

    round_ = lambda r, n, way: _ring(*[(20 + r * math.cos(way * 2 * math.pi * i / n), 20 + r * math.sin(way * 2 * math.pi * i / n)) for i in range(n)], (20 + r, 20))
    d = spark.createDataFrame([(1, 0, round_(9, 40, -1)), (1, 1, round_(5, 8000, 1))], "id int, pos int, pts array<struct<x:double,y:double>>")
    t0 = time.time()
    got = {r.pos: (r.role, r.outer_pos) for r in G.polygon_rings(d, "id").collect()}
    assert got == {0: ("outer", 0), 1: ("hole", 0)}
    assert time.time() - t0 < 60  # was quadratic in the vertices


def test_tiles_are_unpacked_by_one_python_a_task(spark):
    from tilewater.plans import registry
    from tilewater.sources.tables import Tables

    for key in ("scan_dem_tiles", "unpack_tile_batch"):
        plan = registry.load()[key].run(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
        assert sum(plan.count(n) for n in ("MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "ArrowEvalPython")) == 1


def test_archives_are_dealt_over_the_cores(spark):
    from tilewater.plans import registry
    from tilewater.sources.tables import Tables

    df = registry.load()["archive_checksum"].run(Tables(spark, "/root/testdata/sf0.001"))
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
