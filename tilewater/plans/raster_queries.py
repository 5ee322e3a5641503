"""Queries for raster quality: statistics, histograms, confusion metrics, differences, coverage, pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.operators import coverage as V
from tilewater.operators import imaging as I
from tilewater.operators import raster_stats as R
from tilewater.operators import resample as Z
from tilewater.operators import validation as Q
from tilewater.plans import sqltext as S
from tilewater.plans.registry import query

C = F.col
FEET = (1, 6, 30, 150, 600, 1200)
_FEET_SQL = "f(threshold_ft) AS (VALUES " + ", ".join(f"({v}e0)" for v in FEET) + ")"
_LIM = "threshold_ft * 0.3048e0 * 10e0"


def _round(df, digits=9, skip=()):
    return df.select(*[F.round(C(c), digits).alias(c) if t == "double" and c not in skip else C(c) for c, t in df.dtypes])


@query("tile_stats_u16", "fx_tile_cells", """
    SELECT vec_id, min(coalesce(v, 65535)) AS min_code, max(coalesce(v, 65535)) AS max_code,
           round(count_if(v IS NULL) * 100e0 / count(*), 9) AS nodata_pct FROM fx_tile_cells GROUP BY vec_id""")
def _(t):
    return _round(R.tile_stats_u16(t.tile_cells(), ["vec_id"]))


@query("dem_quality", "fx_grid", """
    SELECT cast(floor(row / 4) AS bigint) AS file, min(coalesce(v, -32768)) AS min, max(coalesce(v, -32768)) AS max, round(count_if(v IS NULL) * 100e0 / count(*), 9) AS nodata_pct,
           round(count_if(v % 50 = 0) * 100e0 / count(*), 9) AS zero_pct, count(*) = 600 AS size_ok
    FROM (SELECT row, CASE WHEN v % 50 = 0 THEN 0 ELSE v END AS v FROM fx_grid) GROUP BY 1""")
def _(t):
    g = t.grid().select(F.floor(C("row") / 4).alias("file"), F.when(C("v") % 50 == 0, 0).otherwise(C("v")).alias("v"))
    return _round(R.dem_quality(g, ["file"], expected=600))


@query("raster_stats", "fx_tile_cells", """
    SELECT vec_id, min(v) AS min, max(v) AS max, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS stddev FROM fx_tile_cells GROUP BY vec_id""")
def _(t):
    return _round(R.raster_stats(t.tile_cells(), ["vec_id"]), 8)


@query("tile_relief_stats", "fx_tile_cells", """
    WITH s AS (SELECT vec_id, min(m) AS lo, max(m) AS hi FROM (SELECT vec_id, v * 1e0 AS m FROM fx_tile_cells WHERE vec_id % 6 <> 0 AND v >= -1000 OR v = 77) GROUP BY vec_id)
    SELECT e.vec_id, CASE WHEN hi > lo THEN lo ELSE 0e0 END AS min_m, CASE WHEN hi > lo THEN hi ELSE 120e0 END AS max_m
    FROM embeddings e LEFT JOIN s ON s.vec_id = e.vec_id""")
def _(t):
    c = t.tile_cells().withColumn("m", F.when((C("vec_id") % 6 != 0) | (C("v") == 77), C("v").cast("double")))
    return R.tile_relief_stats(c, ["vec_id"], C("m"))


@query("wet_ratio", "fx_tile_cells", """
    SELECT vec_id, coalesce(bool_or(v / 1e2 < -1), false) AS water_visible, round(count_if(v / 1e2 < -1) / count(*), 9) AS wet_ratio FROM fx_tile_cells GROUP BY vec_id""")
def _(t):
    return _round(R.wet_ratio(t.tile_cells(), ["vec_id"], C("v") / 100.0, F.lit(-1.0)))


@query("code_histogram", "fx_grid", "SELECT v AS code, count(*) AS cells FROM fx_grid WHERE v IS NOT NULL GROUP BY v")
def _(t):
    return R.code_histogram(t.grid())


_BELOW = ", ".join(
    f"count_if(v <= round_even({ft} * 0.3048e0 * 10e0, 0)) AS below_{ft}ft, round(count_if(v <= round_even({ft} * 0.3048e0 * 10e0, 0)) / count(v), 9) AS below_{ft}ft_fraction"
    for ft in (1, 3, 6, 10, 20, 30))


@query("histogram_summary", "fx_grid", f"""
    SELECT count(*) AS total_cells, count(v) AS valid_cells, count(*) - count(v) AS nodata_cells, round(count(v) / count(*), 9) AS valid_fraction,
           round((count(*) - count(v)) / count(*), 9) AS nodata_fraction, min(v) / 1e1 AS min_m, quantile_disc(v, 0.5) / 1e1 AS p50_m,
           quantile_disc(v, 0.95) / 1e1 AS p95_m, quantile_disc(v, 0.99) / 1e1 AS p99_m, max(v) / 1e1 AS max_m, {_BELOW} FROM fx_grid""")
def _(t):
    g = t.grid()
    return _round(R.histogram_summary(R.code_histogram(g), g.agg(F.count("*").alias("total_cells"))))


@query("threshold_coverage", "fx_grid", f"""
    WITH {_FEET_SQL} SELECT threshold_ft, count(v) AS valid_cells, count_if(v <= {_LIM}) AS cells, round(count_if(v <= {_LIM}) * 100e0 / count(v), 9) AS coverage_pct
    FROM fx_grid, f GROUP BY threshold_ft""")
def _(t):
    return _round(R.threshold_coverage(t.grid(), "v", FEET))


_CONF = f"""
    {_FEET_SQL},
    k AS (SELECT threshold_ft, count(v) AS valid, count_if(v IS NOT NULL AND ref_mask) AS ref, count_if(v <= {_LIM}) AS hand, count_if(v <= {_LIM} AND ref_mask) AS tp,
                 count_if(v <= {_LIM} AND NOT ref_mask) AS fp, count_if(v > {_LIM} AND ref_mask) AS fn, count_if(v > {_LIM} AND NOT ref_mask) AS tn FROM fx_grid, f GROUP BY threshold_ft)"""


@query("confusion_metrics", "fx_grid", f"""
    WITH {_CONF} SELECT *, round(tp / nullif(tp + fp + fn, 0), 9) AS iou, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall,
        round(hand * 100e0 / valid, 9) AS hand_pct, round(ref * 100e0 / valid, 9) AS ref_pct, round(tp * 100e0 / nullif(ref, 0), 9) AS overlap_pct_of_ref,
        round(tp * 100e0 / nullif(hand, 0), 9) AS overlap_pct_of_hand FROM k""")
def _(t):
    return _round(Q.confusion_metrics(Q.confusion_counts(t.grid(), "v", C("ref_mask"), FEET)))


@query("random_baseline", "fx_grid", f"""
    WITH {_CONF}, e AS (SELECT *, hand * ref * 1e0 / valid AS rtp FROM k)
    SELECT threshold_ft, round(rtp, 6) AS random_tp, round(CASE WHEN rtp > 0 THEN rtp / (hand + ref - rtp) END, 9) AS random_iou,
           round(CASE WHEN hand > 0 THEN ref / valid END, 9) AS random_precision,
           round(CASE WHEN hand > 0 THEN (tp / nullif(tp + fp, 0)) / (ref / valid) END, 9) AS precision_lift,
           round(CASE WHEN rtp > 0 THEN (tp / (tp + fp + fn)) / (rtp / (hand + ref - rtp)) END, 9) AS iou_lift FROM e""")
def _(t):
    m = Q.random_baseline(Q.confusion_metrics(Q.confusion_counts(t.grid(), "v", C("ref_mask"), FEET)))
    return _round(m.select("threshold_ft", F.round("random_tp", 6).alias("random_tp"), "random_iou", "random_precision", "precision_lift", "iou_lift"))


@query("same_coverage_baseline", "fx_grid", f"""
    WITH {_CONF}, b AS (SELECT cand AS bv, ref_mask, row_number() OVER (ORDER BY cand) AS rn FROM fx_grid WHERE v IS NOT NULL AND cand IS NOT NULL),
    n AS (SELECT count(*) AS candidates FROM b),
    c AS (SELECT k.*, candidates, least(hand, candidates) AS rank, bv AS cutoff FROM k CROSS JOIN n LEFT JOIN b ON rn = least(hand, candidates)),
    d AS (SELECT threshold_ft, count(*) AS cells, count_if(ref_mask) AS base_tp FROM c JOIN b ON b.bv <= cutoff GROUP BY threshold_ft)
    SELECT c.threshold_ft, hand, cutoff, cells, base_tp, round(base_tp / cells, 9) AS base_precision, round(base_tp / ref, 9) AS base_recall,
           round(base_tp / (cells + ref - base_tp), 9) AS base_iou, round(cells * 100e0 / valid, 9) AS base_pct,
           round(CASE WHEN base_tp > 0 THEN (tp / nullif(hand, 0)) / (base_tp / cells) END, 9) AS precision_lift,
           round(CASE WHEN base_tp > 0 THEN (tp / (tp + fp + fn)) / (base_tp / (cells + ref - base_tp)) END, 9) AS iou_lift
    FROM c LEFT JOIN d ON d.threshold_ft = c.threshold_ft""")
def _(t):
    return _round(Q.same_coverage_baseline(t.grid(), "v", "cand", C("ref_mask"), FEET))


@query("mask_jaccard", "fx_grid", f"""
    WITH {_FEET_SQL}, m AS (SELECT threshold_ft, coalesce(v <= {_LIM}, false) AS a, coalesce(cand <= {_LIM}, false) AS b FROM fx_grid, f)
    SELECT threshold_ft, count_if(a AND b) AS both, count_if(a OR b) AS either, round(count_if(a AND b) / nullif(count_if(a OR b), 0), 9) AS jaccard FROM m GROUP BY threshold_ft""")
def _(t):
    return _round(Q.mask_jaccard(t.grid(), "v", "cand", FEET))


_LOW = lambda ft: (f"count_if(v <= {round(ft * 0.3048 * 10)}) AS low_a_{ft}ft, count_if(cand <= {round(ft * 0.3048 * 10)}) AS low_b_{ft}ft, "
                   f"round(count_if(v <= {round(ft * 0.3048 * 10)} AND cand <= {round(ft * 0.3048 * 10)}) / "
                   f"nullif(count_if(coalesce(v <= {round(ft * 0.3048 * 10)}, false) OR coalesce(cand <= {round(ft * 0.3048 * 10)}, false)), 0), 9) AS jaccard_{ft}ft")


@query("raster_diff_stats", "fx_grid", f"""
    WITH p AS (SELECT v, cand, abs(v - cand) AS d FROM fx_grid)
    SELECT count(*) AS cells, count(v) AS valid_a, count(cand) AS valid_b, count(d) AS valid_pairs, count_if(d > 10) AS gt_1m, round(avg(d) / 10, 9) AS mean_m,
           round(max(d) / 1e1, 9) AS max_m, round(count_if(d <= 10) * 100e0 / count(d), 9) AS within_1m_pct, {_LOW(30)}, {_LOW(150)}, {_LOW(600)},
           round(quantile_cont(d, 0.5) / 10, 9) AS p50_m, round(quantile_cont(d, 0.9) / 10, 9) AS p90_m, round(quantile_cont(d, 0.95) / 10, 9) AS p95_m,
           round(quantile_cont(d, 0.99) / 10, 9) AS p99_m FROM p""")
def _(t):
    return _round(Q.raster_diff_stats(t.grid(), "v", "cand", (30, 150, 600)))


_ATT = ("near_nodata", "near_drain", "at_band", "at_edge", "interior", "explained", "unexplained",
        "first_near_nodata", "first_near_drain", "first_at_band", "first_at_edge")


@query("diff_attribution", "fx_grid", f"""
    WITH n AS (SELECT DISTINCT row + dr AS row, col + dc AS col, bad, wet FROM (SELECT row, col, v IS NULL OR cand IS NULL AS bad,
                 coalesce(v <= 60, false) OR coalesce(cand <= 60, false) AS wet FROM fx_grid), (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc) WHERE dr <> 0 OR dc <> 0),
         h AS (SELECT row, col, bool_or(bad) AS bad, bool_or(wet) AS wet FROM n GROUP BY row, col),
         e AS (SELECT g.row, g.col, coalesce(bad, false) AS near_nodata, coalesce(wet, false) AS near_drain,
                 EXISTS (SELECT 1 FROM range(30, 101, 30) r(edge) WHERE edge < 101 AND abs(g.row - edge) <= 3) AS at_band, g.col < 6 AS at_edge
               FROM fx_grid g LEFT JOIN h ON h.row = g.row AND h.col = g.col WHERE abs(v - cand) > 8),
         o AS (SELECT count(*) AS gt_1m, count_if(near_nodata) AS near_nodata, count_if(near_drain) AS near_drain, count_if(at_band) AS at_band, count_if(at_edge) AS at_edge,
                 count_if(NOT at_edge) AS interior, count_if(near_nodata OR near_drain OR at_band OR at_edge) AS explained,
                 count_if(NOT (near_nodata OR near_drain OR at_band OR at_edge)) AS unexplained, count_if(near_nodata) AS first_near_nodata,
                 count_if(near_drain AND NOT near_nodata) AS first_near_drain, count_if(at_band AND NOT near_nodata AND NOT near_drain) AS first_at_band,
                 count_if(at_edge AND NOT near_nodata AND NOT near_drain AND NOT at_band) AS first_at_edge FROM e)
    SELECT *, {', '.join(f'round({n} * 100e0 / gt_1m, 9) AS {n}_pct' for n in _ATT)} FROM o""")
def _(t):
    return _round(Q.diff_attribution(t.grid(), "v", "cand", C("col") < 6, height=101, band_rows=30, edge=3, drain_dm=60, limit_dm=8))


@query("seam_metrics", "fx_grid", """
    WITH l AS (SELECT c_custkey % 7 AS seam, cast(c_custkey * 37 % 100 AS integer) AS row, cast(c_custkey * 91 % 150 AS integer) AS col FROM customer),
         s AS (SELECT seam, v, cand, abs(v - cand) AS d FROM l LEFT JOIN fx_grid g ON g.row = l.row AND g.col = l.col)
    SELECT seam, count(*) AS samples, count(v) AS valid_a, count(cand) AS valid_b, count(d) AS valid_pairs, count_if(v <= 9 OR cand <= 9) AS either_low,
           round(count_if(v <= 9 OR cand <= 9) * 100e0 / count(*), 9) AS either_low_pct, round(avg(d) / 10, 9) AS mean_m, round(max(d) / 1e1, 9) AS max_m,
           round(count_if(d <= 3) * 100e0 / count(d), 9) AS within_0p3m_pct, round(count_if(d <= 10) * 100e0 / count(d), 9) AS within_1m_pct,
           round(quantile_cont(d, 0.5) / 10, 9) AS p50_m, round(quantile_cont(d, 0.9) / 10, 9) AS p90_m, round(quantile_cont(d, 0.95) / 10, 9) AS p95_m
    FROM s GROUP BY seam""")
def _(t):
    k = C("c_custkey")
    line = t.read("customer").select((k % 7).alias("seam"), (k * 37 % 100).cast("int").alias("row"), (k * 91 % 150).cast("int").alias("col"))
    s = line.join(t.grid().select("row", "col", "v", "cand"), ["row", "col"], "left")
    return _round(Q.seam_metrics(s, ["seam"], "v", "cand"))


@query("tile_vs_static", "fx_tile_cells", """
    WITH p AS (SELECT cast(9 + vec_id % 3 AS integer) AS z, v AS a, CASE WHEN (row * 8 + col + vec_id) % 41 = 0 THEN NULL ELSE v + row - 3 END AS b FROM fx_tile_cells),
         q AS (SELECT z, a, b, abs(a - b) * 0.328084e0 AS d FROM p)
    SELECT z, count(*) AS pixels, count(d) AS valid_both, round(count_if((a IS NULL) <> (b IS NULL)) / count(*), 9) AS mismatch_rate, round(max(d), 9) AS max_ft,
           round(quantile_cont(d, 0.5), 9) AS p50_ft, round(quantile_cont(d, 0.95), 9) AS p95_ft, round(quantile_cont(d, 0.99), 9) AS p99_ft,
           quantile_cont(d, 0.95) <= 1.4 AND count_if((a IS NULL) <> (b IS NULL)) / count(*) <= 0.03 AS passed
    FROM q GROUP BY GROUPING SETS ((z), ())""")
def _(t):
    b = F.when((C("row") * 8 + C("col") + C("vec_id")) % 41 != 0, C("v") + C("row") - 3)
    p = t.tile_cells().select((F.lit(9) + C("vec_id") % 3).cast("int").alias("z"), C("v").alias("a"), b.alias("b"))
    return _round(Q.tile_vs_static(p, "z", ["vec_id"], "a", "b", max_p95_ft=1.4, max_mismatch=0.03))


@query("gate_checks", "fx_grid", """
    SELECT cast(floor(row / 10) AS bigint) AS unit, round(count(v) * 100e0 / count(*), 9) AS valid_pct, max(v) AS max_v, count_if(v <= 300) AS low_cells,
           count(v) * 100e0 / count(*) >= 96.5 AS coverage_ok, coalesce(max(v) <= 4990, false) AS range_ok, count_if(v <= 300) >= 60 AS low_ok,
           count(v) * 100e0 / count(*) >= 96.5 AND coalesce(max(v) <= 4990, false) AND count_if(v <= 300) >= 60 AS all_pass FROM fx_grid GROUP BY 1""")
def _(t):
    m = t.grid().groupBy(F.floor(C("row") / 10).alias("unit")).agg(
        (F.count("v") * 100.0 / F.count("*")).alias("valid_pct"), F.max("v").alias("max_v"), F.count_if(C("v") <= 300).alias("low_cells"))
    return _round(Q.gate_checks(m, {"coverage_ok": C("valid_pct") >= 96.5, "range_ok": C("max_v") <= 4990, "low_ok": C("low_cells") >= 60}))


@query("mosaic_priority", "fx_tile_cells", """
    WITH l AS (SELECT vec_id, row, col, 0 AS priority, CASE WHEN (vec_id + row) % 3 = 0 THEN v END AS v FROM fx_tile_cells
               UNION ALL SELECT vec_id, row, col, 1, CASE WHEN (vec_id + col) % 2 = 0 THEN v + 1000 END FROM fx_tile_cells
               UNION ALL SELECT vec_id, row, col, 2, v + 2000 FROM fx_tile_cells WHERE vec_id % 2 = 0)
    SELECT vec_id, row, col, arg_min(v, priority) FILTER (v IS NOT NULL) AS v, min(priority) FILTER (v IS NOT NULL) AS from_priority FROM l GROUP BY vec_id, row, col""")
def _(t):
    c, k = t.tile_cells(), C("vec_id")
    lay = lambda p, v, cond=F.lit(True): c.where(cond).select("vec_id", "row", "col", F.lit(p).alias("priority"), v.alias("v"))
    layers = lay(0, F.when((k + C("row")) % 3 == 0, C("v"))).unionByName(lay(1, F.when((k + C("col")) % 2 == 0, C("v") + 1000))) \
        .unionByName(lay(2, C("v") + 2000, k % 2 == 0))
    return Z.mosaic_priority(layers, ["vec_id", "row", "col"])


@query("zero_dominant_mask", "fx_tile_cells", """
    WITH c AS (SELECT vec_id, row, col, CASE WHEN v IS NULL OR (vec_id % 3 = 0 AND (row > 0 OR col > 4)) OR (vec_id % 3 = 1 AND row > 1) THEN 0 ELSE v END AS v FROM fx_tile_cells),
         s AS (SELECT vec_id, count_if(v = 0) / count(*) >= 0.9 AS ocean FROM c GROUP BY vec_id)
    SELECT c.vec_id, row, col, CASE WHEN ocean AND v = 0 THEN NULL ELSE v END AS v FROM c JOIN s ON s.vec_id = c.vec_id""")
def _(t):
    k = C("vec_id") % 3
    sea = C("v").isNull() | ((k == 0) & ((C("row") > 0) | (C("col") > 4))) | ((k == 1) & (C("row") > 1))
    c = t.tile_cells().select("vec_id", "row", "col", F.when(sea, 0).otherwise(C("v")).alias("v"))
    return Z.zero_dominant_mask(c, ["vec_id"]).select("vec_id", "row", "col", "v")


# ---- coverage ---------------------------------------------------------------------------------

_STATUS = """
    s AS (SELECT event_id, z, x, y, cast(event_id % 4 AS integer) AS overlapping, event_id % 4 > 0 AND event_id % 7 <> 0 AS has_elevation, event_type = 'view' AS roads,
            CASE WHEN event_id % 4 = 0 THEN 'no-overlap' WHEN event_id % 21 = 0 THEN 'error:ValueError' WHEN event_id % 7 = 0 THEN 'overlap-no-extract' END AS note FROM fx_requests)"""


def _statuses(t):
    e = C("event_id")
    note = F.when(e % 4 == 0, "no-overlap").when(e % 21 == 0, "error:ValueError").when(e % 7 == 0, "overlap-no-extract")
    return t.requests().select("event_id", "z", "x", "y", (e % 4).cast("int").alias("overlapping"), ((e % 4 > 0) & (e % 7 != 0)).alias("has_elevation"),
                               (C("event_type") == "view").alias("roads"), note.alias("note"))


@query("coverage_summary", "fx_requests", f"""
    WITH {_STATUS} SELECT count(*) AS total, count_if(has_elevation) AS have_elevation, round(count_if(has_elevation) / count(*), 9) AS coverage_pct,
        count_if(overlapping > 0) AS with_overlap, count_if(overlapping = 0) AS no_overlap, count_if(note = 'overlap-no-extract') AS overlap_no_extract,
        count_if(note LIKE 'error:%') AS errors, count_if(roads AND NOT has_elevation) AS suspect_gaps FROM s""")
def _(t):
    return _round(V.coverage_summary(_statuses(t)))


@query("coverage_findings", "fx_requests", f"""
    WITH {_STATUS} SELECT z, x, y, overlapping, note, 'overlap-no-extract' AS problem FROM s WHERE note = 'overlap-no-extract'
    UNION ALL SELECT z, x, y, overlapping, note, 'error' FROM s WHERE note LIKE 'error:%'
    UNION ALL SELECT z, x, y, overlapping, note, 'suspect-gap' FROM s WHERE roads AND NOT has_elevation""")
def _(t):
    return V.coverage_findings(_statuses(t))


@query("coverage_extent", "fx_degree_tiles", """
    SELECT min(lon) * 1e0 AS west, min(lat) * 1e0 AS south, max(lon + 1) * 1e0 AS east, max(lat + 1) * 1e0 AS north FROM fx_degree_tiles""")
def _(t):
    d = t.degree_tiles().select(*[c.cast("double").alias(n) for n, c in (
        ("west", C("lon")), ("south", C("lat")), ("east", C("lon") + 1), ("north", C("lat") + 1))])
    return V.union_bbox(d)


@query("zoom_extent", "fx_requests", f"""
    WITH g AS (SELECT z, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS tiles FROM fx_requests GROUP BY z)
    SELECT *, round({S.top('min_y', 'z')}, 9) AS north, round({S.left('min_x', 'z')}, 9) AS west, round({S.top('max_y + 1', 'z')}, 9) AS south,
           round({S.left('max_x + 1', 'z')}, 9) AS east FROM g""")
def _(t):
    return _round(V.zoom_extent(t.requests()))


@query("rounded_ranges", "fx_points", f"""
    SELECT DISTINCT 'lat' AS axis, {S.i32('round_even(lat, 0)')} AS low, {S.i32('round_even(lat + 1.25e0, 0)')} AS high FROM fx_points
    UNION SELECT DISTINCT 'lon', {S.i32('round_even(lon, 0)')}, {S.i32('round_even(lon + 0.5e0, 0)')} FROM fx_points""")
def _(t):
    b = t.points().select(C("lat").alias("south"), (C("lat") + 1.25).alias("north"), C("lon").alias("west"), (C("lon") + 0.5).alias("east"))
    return V.rounded_ranges(b)


@query("bounds_check", "fx_points", """
    SELECT event_id, concat_ws(',', CASE WHEN event_id % 3 = 0 THEN 'north' END, CASE WHEN event_id % 4 = 0 THEN 'south' END,
           CASE WHEN event_id % 5 = 0 THEN 'east' END, CASE WHEN event_id % 6 = 0 THEN 'west' END) AS errors,
           event_id % 3 <> 0 AND event_id % 4 <> 0 AND event_id % 5 <> 0 AS valid FROM fx_points""")
def _(t):
    e = C("event_id")
    a = t.points().select("event_id", C("lat").alias("south"), (C("lat") + 1).alias("north"), C("lon").alias("west"), (C("lon") + 1).alias("east"))
    off = lambda c, k: (C(c) + F.when(e % k == 0, 0.0002).otherwise(0.00005)).alias(c)
    b = a.select("event_id", off("north", 3), off("south", 4), off("east", 5), off("west", 6))
    return V.bounds_check(a, b, "event_id")


_SIZED = "SELECT cast(pos % 5 AS integer) AS z, bytes % 150000 AS b FROM fx_archives"


@query("zoom_size_summary", "fx_archives", f"""
    SELECT z, count(*) AS files, cast(sum(b) AS bigint) AS bytes, count_if(b < 5120) AS lt5k, count_if(b >= 5120 AND b < 20480) AS bt5_20k,
           count_if(b >= 20480) AS gt20k, count_if(b > 102400) AS gt100k FROM ({_SIZED}) GROUP BY z""")
def _(t):
    return V.zoom_size_summary(t.archives().select((C("pos") % 5).cast("int").alias("z"), (C("bytes") % 150000).alias("bytes")))


@query("pyramid_estimate", "fx_points", f"""
    WITH b AS (SELECT event_id, z, {S.wx('lon', 'z')} AS x0, {S.wx('lon + 1e0', 'z')} AS x1, {S.wy('lat + 1e0', 'z')} AS y0, {S.wy('lat', 'z')} AS y1
               FROM fx_points, range(9, 15) AS r(z)),
         n AS (SELECT event_id, cast(z AS integer) AS z, cast((floor(x1) - floor(x0) + 1) * (floor(y1) - floor(y0) + 1) AS bigint) AS n FROM b)
    SELECT event_id, z, cast(sum(n) AS bigint) AS tiles, cast(sum(n * 131072) AS bigint) AS raw_bytes FROM n GROUP BY ROLLUP (event_id, z)""")
def _(t):
    b = t.points().select("event_id", C("lon").alias("west"), C("lat").alias("south"), (C("lon") + 1.0).alias("east"), (C("lat") + 1.0).alias("north"))
    return V.pyramid_estimate(b, "event_id", 9, 14)


@query("source_raster_estimate", "fx_points", """
    WITH c AS (SELECT event_id, cast(round_even((water_level_m + 1) * 1e3 * 1000000 / (cell * cell), 0) AS bigint) AS cells
               FROM (SELECT event_id, water_level_m, CASE WHEN event_id % 2 = 0 THEN 10e0 ELSE 30e0 END AS cell FROM fx_points))
    SELECT event_id, cells, cells * 2 AS raw_bytes, cast(round_even(cells * 2 * (4e0 / 3e0), 0) AS bigint) AS with_overviews FROM c""")
def _(t):
    e = V.source_raster_estimate((C("water_level_m") + 1) * 1000.0, F.when(C("event_id") % 2 == 0, 10.0).otherwise(30.0))
    return t.points().select("event_id", e.alias("e")).select("event_id", "e.*")


@query("coverage_set_diff", "fx_degree_tiles fx_points", f"""
    WITH e AS (SELECT DISTINCT {S.i32('floor(lat)')} AS lat, {S.i32('floor(lon)')} AS lon FROM fx_points)
    SELECT lat, lon, 'missing' AS side FROM (SELECT lat, lon FROM e EXCEPT SELECT lat, lon FROM fx_degree_tiles)
    UNION ALL SELECT lat, lon, 'extra' FROM (SELECT lat, lon FROM fx_degree_tiles EXCEPT SELECT lat, lon FROM e)""")
def _(t):
    e = t.points().select(F.floor("lat").cast("int").alias("lat"), F.floor("lon").cast("int").alias("lon")).distinct()
    return V.coverage_set_diff(e, t.degree_tiles(), ["lat", "lon"])


@query("interior_holes", "fx_degree_tiles", """
    WITH e AS (SELECT min(lat) AS a0, max(lat) AS a1, min(lon) AS o0, max(lon) AS o1 FROM fx_degree_tiles),
         s AS (SELECT lat, cast(unnest(range(o0, o1 + 1)) AS integer) AS lon FROM (SELECT cast(unnest(range(a0, a1 + 1)) AS integer) AS lat, o0, o1 FROM e))
    SELECT lat, lon, n AS neighbors, n >= 2 AS suspicious FROM (SELECT s.lat, s.lon, (SELECT count(*) FROM fx_degree_tiles d WHERE abs(d.lat - s.lat) <= 1 AND abs(d.lon - s.lon) <= 1) AS n
        FROM s WHERE NOT EXISTS (SELECT 1 FROM fx_degree_tiles d WHERE d.lat = s.lat AND d.lon = s.lon))""")
def _(t):
    return V.interior_holes(t.degree_tiles())


# ---- pixels -----------------------------------------------------------------------------------

_PX = """px AS (SELECT cast(floor(row / 10) AS bigint) AS frame, row, col, abs(v * 7) % 256 AS r, abs(v * 13) % 256 AS g, abs(v * 29) % 256 AS b, CASE WHEN v % 11 = 0 THEN 0 ELSE 255 END AS a,
                abs(v * 7 + (cand - v)) % 256 AS r1, abs(v * 13) % 256 AS g1, abs(v * 29 + (cand - v) * 3) % 256 AS b1 FROM fx_grid WHERE v IS NOT NULL AND cand IS NOT NULL)"""


def _pixels(t, changed=False):
    v, d = C("v"), C("cand") - C("v")
    m = lambda e: F.abs(e) % 256
    r, b = (m(v * 7 + d), m(v * 29 + d * 3)) if changed else (m(v * 7), m(v * 29))
    return t.grid().where("v IS NOT NULL AND cand IS NOT NULL").select(
        F.floor(C("row") / 10).alias("frame"), "row", "col", r.alias("r"), m(v * 13).alias("g"), b.alias("b"),
        F.when(v % 11 == 0, 0).otherwise(255).alias("a"))


@query("pixel_change", "fx_grid", f"""
    WITH {_PX} SELECT frame, round((avg(abs(r1 - r)) + avg(abs(g1 - g)) + avg(abs(b1 - b))) / 3, 9) AS mean_abs_delta,
        round(count_if(greatest(abs(r1 - r), abs(g1 - g), abs(b1 - b)) >= 18) / count(*), 9) AS changed_ratio FROM px GROUP BY frame""")
def _(t):
    return _round(I.pixel_change(_pixels(t), _pixels(t, changed=True), ["frame"]))


@query("pixel_richness", "fx_grid", f"""
    WITH {_PX} SELECT frame, count(DISTINCT r * 65536 + g * 256 + b) AS colors, round(count_if(b > r + 22 AND b >= g - 12) / count(*), 9) AS blue_ratio,
        round(count_if(r < 16 AND g < 16 AND b < 16) / count(*), 9) AS dark_ratio FROM px GROUP BY frame""")
def _(t):
    return _round(I.pixel_richness(_pixels(t), ["frame"]))


@query("blank_ratio", "fx_grid", f"""
    WITH {_PX} SELECT frame, round(count_if(a = 0 OR (abs(r - 120) <= 60 AND abs(g - 120) <= 60 AND abs(b - 120) <= 60)) / count(*), 9) AS blank_ratio
    FROM px WHERE row % 2 = 0 AND col % 2 = 0 GROUP BY frame""")
def _(t):
    return _round(I.blank_ratio(_pixels(t), ["frame"], (120, 120, 120), tolerance=60, stride=2))


@query("depth_grid_summary", "fx_grid", """
    WITH d AS (SELECT row, col, cast(floor(row / 10) AS bigint) AS frame, v / 1e3 - 1 AS w, cand / 1e2 AS s FROM fx_grid),
         e AS (SELECT *, greatest(0e0, w) AS d FROM d WHERE w IS NOT NULL)
    SELECT frame, round(sum(d), 6) AS mass, count_if(d > 1e-4) AS wet_cells, round(max(d), 6) AS max_depth, round(max(s), 6) AS max_speed,
           (SELECT count(*) FROM d WHERE d.frame = e.frame AND w IS NULL) AS bad_cells, count_if(w < -1e-6) AS negative_cells,
           round(sum(col * d) / sum(d), 6) AS center_x, round(sum(row * d) / sum(d), 6) AS center_y FROM e GROUP BY frame""")
def _(t):
    d = t.grid().select("row", "col", F.floor(C("row") / 10).alias("frame"), (C("v") / 1000.0 - 1).alias("w"), (C("cand") / 100.0).alias("s"))
    return _round(I.depth_grid_summary(d, ["frame"], C("w"), C("s")), 6)
