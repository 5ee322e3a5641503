"""Queries for joins of points, tiles, regions, sources and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.operators import grids as GR
from tilewater.operators import joins as J
from tilewater.operators import raster_stats as R
from tilewater.operators import resample as Z
from tilewater.plans import sqltext as S
from tilewater.plans.registry import query
from tilewater.plans.risk import risk_by_class

C = F.col

_AT9 = f"""
    w9 AS (SELECT event_id, water_level_m, {S.wx('lon', '9')} AS wx, {S.wy(S.clip('lat'), '9')} AS wy FROM fx_points),
    p9 AS (SELECT event_id, water_level_m, {S.i32('floor(wx)')} AS x, {S.i32('floor(wy)')} AS y,
                  {S.i32('floor(greatest(0, least(255, trunc((wy - floor(wy)) * 256))) / 32)')} AS row,
                  {S.i32('floor(greatest(0, least(255, trunc((wx - floor(wx)) * 256))) / 32)')} AS col FROM w9),
    t9 AS (SELECT DISTINCT x, y FROM fx_tile_cells),
    s9 AS (SELECT p9.*, c.v, t9.x IS NOT NULL AS tile_found FROM p9 LEFT JOIN fx_tile_cells c USING (x, y, row, col) LEFT JOIN t9 ON t9.x = p9.x AND t9.y = p9.y)"""


def _sampled(t):
    return J.sample_points(t.points(), t.tile_rows(), zoom=9, tile_px=8)


@query("sample_points", "fx_points fx_tile_cells", f"WITH {_AT9} SELECT event_id, x, y, row, col, v, tile_found FROM s9")
def _(t):
    return _sampled(t).select("event_id", "x", "y", "row", "col", "v", "tile_found")


@query("risk_by_class", "fx_points fx_tile_cells", f"""
    WITH {_AT9} SELECT CASE WHEN NOT tile_found THEN 'unknown' WHEN v IS NULL THEN 'water' WHEN v - water_level_m < 0.5 THEN 'very_high'
        WHEN v - water_level_m < 2 THEN 'high' WHEN v - water_level_m < 5 THEN 'moderate' ELSE 'low' END AS risk,
        count(*) AS points, round(avg(v), 6) AS mean_height FROM s9 GROUP BY 1""")
def _(t):
    return risk_by_class(t)


@query("tile_source_overlap", "fx_requests fx_degree_tiles", f"""
    WITH b AS (SELECT event_id, {S.top('y', 'z')} AS tp, {S.top('y + 1', 'z')} AS bt, {S.left('x', 'z')} AS lf, {S.left('x + 1', 'z')} AS rt FROM fx_requests)
    SELECT event_id, lat, lon FROM b JOIN fx_degree_tiles ON lat <= tp - 1e-12 AND lat + 1 >= bt + 1e-12 AND lon <= rt - 1e-12 AND lon + 1 >= lf + 1e-12""")
def _(t):
    return J.tile_source_overlap(t.requests().select("event_id", "z", "x", "y"), t.degree_tiles()).select("event_id", "lat", "lon")


_M = "20037508.342789244e0"
_LAT = lambda y: f"degrees(2e0 * atan(exp(({y}) / {_M} * pi())) - pi() / 2e0)"


@query("tile_regions", "fx_requests fx_regions", f"""
    WITH m AS (SELECT event_id, -{_M} + x * (2e0 * {_M} / pow(2e0, z)) AS minx, {_M} - y * (2e0 * {_M} / pow(2e0, z)) AS maxy, 2e0 * {_M} / pow(2e0, z) AS sp FROM fx_requests),
         b AS (SELECT event_id, minx / {_M} * 180e0 AS w, (minx + sp) / {_M} * 180e0 AS e, {_LAT('maxy - sp')} AS s, {_LAT('maxy')} AS n FROM m)
    SELECT event_id, id, priority FROM b JOIN fx_regions ON west < e AND east > w AND south < n AND north > s""")
def _(t):
    return J.tile_regions(t.requests().select("event_id", "z", "x", "y"), t.regions()).select("event_id", "id", "priority")


@query("point_regions", "fx_points fx_regions", """
    SELECT event_id, arg_min(id, priority) AS region, min(priority) AS priority
    FROM fx_points JOIN fx_regions ON west <= lon AND lon < east AND south <= lat AND lat < north GROUP BY event_id""")
def _(t):
    return J.first_region(t.points().select("event_id", "lon", "lat"), t.regions(), "event_id")


_VAL = "CASE WHEN (event_id + priority) % 3 <> 0 THEN (event_id * 31 + priority * 7) % 500 END"


@query("sample_with_fallback", "fx_points fx_tile_cells fx_regions", f"""
    WITH {_AT9},
    t AS (SELECT event_id, priority, id, {_VAL} AS v, (event_id + priority * 3) % 5 < 2 AS failed
          FROM fx_points JOIN fx_regions ON west <= lon AND lon < east AND south <= lat AND lat < north),
    f AS (SELECT event_id, arg_min(v, priority) FILTER (v IS NOT NULL AND NOT failed) AS v, arg_min(id, priority) FILTER (v IS NOT NULL AND NOT failed) AS id,
                 arg_min(id, priority) AS first_id, bool_or(failed) AS any_failed FROM t GROUP BY event_id)
    SELECT p.event_id, CASE WHEN f.id IS NOT NULL THEN f.v WHEN any_failed AND s9.v IS NOT NULL THEN s9.v END AS v,
           CASE WHEN f.id IS NOT NULL THEN f.id WHEN any_failed AND s9.v IS NOT NULL THEN first_id END AS region,
           CASE WHEN f.id IS NOT NULL THEN 'source' WHEN any_failed AND s9.v IS NOT NULL THEN 'cache' WHEN first_id IS NULL THEN 'outside' ELSE 'no-data' END AS origin
    FROM fx_points p LEFT JOIN f ON f.event_id = p.event_id JOIN s9 ON s9.event_id = p.event_id""")
def _(t):
    pts = t.points().select("event_id", "lon", "lat")
    e, k = C("event_id"), C("priority")
    values = J.point_regions(pts, t.regions()).select(
        "event_id", "priority", F.when((e + k) % 3 != 0, (e * 31 + k * 7) % 500).alias("v"), ((e + k * 3) % 5 < 2).alias("failed"))
    cached = _sampled(t).select("event_id", C("v").cast("bigint").alias("cached_v"))
    return J.sample_with_fallback(pts, t.regions(), values, cached, "event_id")


_GAP = f"""
    e9 AS (SELECT event_id, event_type, 9 AS z, {S.tx('lon', '9')} AS x, {S.ty('lat', '9')} AS y FROM fx_points),
    g9 AS (SELECT DISTINCT z, x, y FROM e9 WHERE EXISTS (SELECT 1 FROM e9 f WHERE f.event_type = 'view' AND f.x = e9.x AND f.y = e9.y)
             AND NOT EXISTS (SELECT 1 FROM fx_tile_cells c WHERE c.x = e9.x AND c.y = e9.y AND c.v IS NOT NULL))"""


def _gaps(t):
    at = t.points().select("event_type", F.lit(9).alias("z"), A.tile_x(C("lon"), F.lit(9)).alias("x"), A.tile_y(C("lat"), F.lit(9)).alias("y"))
    zxy = ["z", "x", "y"]
    return J.coverage_gaps(at.select(*zxy).distinct(), at.where(C("event_type") == "view").select(*zxy),
                           t.tile_cells().where("v IS NOT NULL").select(*zxy).distinct())


@query("coverage_gaps", "fx_points fx_tile_cells", f"WITH {_GAP} SELECT z, x, y FROM g9")
def _(t):
    return _gaps(t)


_MISSING = f"""
    mb AS (SELECT z, x, y, {S.i32("floor(" + S.top('y + 1', 'z') + " - 1e-12)")} AS la0, {S.i32("ceil(" + S.top('y', 'z') + " - 1e-12)")} AS la1,
                  {S.i32("floor(" + S.left('x', 'z') + " - 1e-12)")} AS lo0, {S.i32("ceil(" + S.left('x + 1', 'z') + " - 1e-12)")} AS lo1 FROM g9),
    mc AS (SELECT z, x, y, lo0, lo1, unnest(range(la0, la1 + 1))::integer AS lat FROM mb),
    md AS (SELECT z, x, y, lat, unnest(range(lo0, lo1 + 1))::integer AS lon FROM mc),
    ms AS (SELECT z, x, y, {S.degree_id('lat', 'lon')} AS source_id FROM md WHERE NOT EXISTS (SELECT 1 FROM fx_degree_tiles d WHERE d.lat = md.lat AND d.lon = md.lon))"""


@query("missing_sources", "fx_points fx_tile_cells fx_degree_tiles", f"WITH {_GAP}, {_MISSING} SELECT z, x, y, source_id FROM ms")
def _(t):
    return J.missing_sources(_gaps(t), t.degree_tiles()).select("z", "x", "y", "source_id")


@query("missing_id_counts", "fx_points fx_tile_cells fx_degree_tiles", f"WITH {_GAP}, {_MISSING} SELECT source_id, count(*) AS tiles FROM ms GROUP BY source_id")
def _(t):
    return J.missing_sources(_gaps(t), t.degree_tiles()).groupBy("source_id").agg(F.count("*").alias("tiles"))


@query("raster_pair", "fx_grid", """
    SELECT coalesce(a.row, b.row) AS row, coalesce(a.col, b.col) AS col, a.v AS a, b.cand AS b
    FROM (SELECT * FROM fx_grid WHERE (row + col) % 17 <> 0) a FULL JOIN (SELECT * FROM fx_grid WHERE (row + col) % 19 <> 0) b ON a.row = b.row AND a.col = b.col""")
def _(t):
    g = t.grid()
    return J.raster_pair(g.where((C("row") + C("col")) % 17 != 0).select("row", "col", "v"),
                         g.where((C("row") + C("col")) % 19 != 0).select("row", "col", C("cand").alias("v")), ["row", "col"])


@query("raster_pair_nearest", "fx_grid", f"""
    WITH k AS (SELECT row, col, cand AS b, {S.i32('floor((row + 0.5e0) * 0.75e0)')} AS sr, {S.i32('floor((col + 0.5e0) * 0.75e0)')} AS sc FROM fx_grid)
    SELECT k.row, k.col, g.v AS a, b FROM k LEFT JOIN fx_grid g ON g.row = sr AND g.col = sc""")
def _(t):
    g = t.grid()
    return Z.pair_nearest(g.select("row", "col", "v"), g.select("row", "col", C("cand").alias("b")), 0.75).select("row", "col", C("v").alias("a"), "b")


@query("raster_pair_checked", "fx_grid", """
    WITH g AS (SELECT *, cast(floor(row / 5) AS integer) AS raster FROM fx_grid),
    s AS (SELECT raster, max(row) - min(row) + 1 AS height, CASE WHEN raster % 7 = 0 THEN 'transform' END AS t, CASE WHEN raster % 6 = 5 THEN 'shape' END AS h,
                 CASE WHEN raster % 4 = 1 THEN 'crs' END AS c FROM g GROUP BY raster),
    e AS (SELECT raster, CASE WHEN raster % 11 = 3 THEN 'not in right' ELSE nullif(concat_ws(',', h, t, c), '') END AS grid_error FROM s)
    SELECT raster, row, col, v AS a, cand AS b, NULL AS grid_error FROM g JOIN e USING (raster) WHERE grid_error IS NULL
    UNION ALL SELECT raster, NULL, NULL, NULL, NULL, grid_error FROM e WHERE grid_error IS NOT NULL""")
def _(t):
    r = C("raster")
    g = t.grid().withColumn("raster", F.floor(C("row") / 5).cast("int"))
    left = g.groupBy("raster").agg((F.max("row") - F.min("row") + 1).alias("height"), F.lit(150).alias("width"), F.lit(10.0).alias("a"), F.lit(0.0).alias("b"),
                                   (F.min("raster") * 7.0).alias("c"), F.lit(0.0).alias("d"), F.lit(-10.0).alias("e"), F.lit(300.0).alias("f"), F.lit("EPSG:5070").alias("crs"))
    right = left.where(r % 11 != 3).withColumns({
        "width": F.when(r % 6 == 5, C("width") + 1).otherwise(C("width")), "c": C("c") + F.when(r % 7 == 0, 0.5).otherwise(1e-6),
        "crs": F.when(r % 4 != 1, C("crs"))})
    cells = lambda v: g.select("raster", "row", "col", C(v).alias("v"))
    return GR.checked_pair(cells("v"), cells("cand"), left, right, "raster").select("raster", "row", "col", "a", "b", "grid_error")


# a turned source in Mercator metres under a target in degrees
_SOURCE, _TARGET = (43000.0, 1500.0, -13905000.0, 800.0, -40000.0, 6310000.0), (0.21, 0.0, -125.0, 0.0, -0.17, 49.0)
_CENTRE = """
    p AS (SELECT row, col, cand AS b, (-125e0 + (col + 0.5e0) * 0.21e0) * 20037508.342789244e0 / 180e0 AS x,
                 ln(tan((49e0 - (row + 0.5e0) * 0.17e0 + 90e0) * pi() / 360e0)) / pi() * 20037508.342789244e0 AS y FROM fx_grid WHERE row < 200),
    q AS (SELECT row, col, b, ((y - 6310000e0) * 43000e0 - (x + 13905000e0) * 800e0) / (43000e0 * -40000e0 - 1500e0 * 800e0) AS sr,
                 ((x + 13905000e0) * -40000e0 - (y - 6310000e0) * 1500e0) / (43000e0 * -40000e0 - 1500e0 * 800e0) AS sc FROM p)"""


def _onto(t, bilinear):
    def mercator(x, y):
        m = A.lonlat_to_mercator(x, y)
        return m["mx"], m["my"]

    g = t.grid()
    return GR.resample_onto(g.where("row < 200").select("row", "col", C("cand").alias("b")), _TARGET, g.select("row", "col", "v"), _SOURCE, mercator, bilinear)


@query("raster_pair_projected", "fx_grid", f"""
    WITH {_CENTRE} SELECT q.row, q.col, g.v AS a, b FROM q LEFT JOIN fx_grid g ON g.row = floor(sr) AND g.col = floor(sc)""")
def _(t):
    return _onto(t, False).select("row", "col", C("v").alias("a"), "b")


@query("raster_pair_bilinear", "fx_grid", f"""
    WITH {_CENTRE}, k AS (SELECT row, col, b, floor(sr - 0.5e0) AS r0, floor(sc - 0.5e0) AS c0, sr - 0.5e0 - floor(sr - 0.5e0) AS fy, sc - 0.5e0 - floor(sc - 0.5e0) AS fx FROM q),
    w AS (SELECT k.row, k.col, b, g.v, (CASE WHEN dx = 1 THEN fx ELSE 1e0 - fx END) * (CASE WHEN dy = 1 THEN fy ELSE 1e0 - fy END) AS w
          FROM k CROSS JOIN (VALUES (0), (1)) i(dx) CROSS JOIN (VALUES (0), (1)) j(dy) LEFT JOIN fx_grid g ON g.row = r0 + dy AND g.col = c0 + dx)
    SELECT row, col, any_value(b) AS b, round(sum(v * w) / sum(w) FILTER (v IS NOT NULL), 5) AS a FROM w GROUP BY row, col""")
def _(t):
    return _onto(t, True).select("row", "col", F.round("v", 5).alias("a"), "b")


_PT = "SELECT event_id, (event_id * 7919 % 9000) / 1e2 + 0.004e0 AS gy, (event_id * 104729 % 14000) / 1e2 + 0.003e0 AS gx FROM events"


@query("bilinear_sample", "fx_grid", f"""
    WITH p AS ({_PT}), q AS (SELECT event_id, gx, gy, cast(floor(gx) AS integer) AS x0, cast(floor(gy) AS integer) AS y0 FROM p),
         c AS (SELECT event_id, y0 + dy AS row, x0 + dx AS col,
                      (CASE WHEN dx = 1 THEN gx - x0 ELSE 1e0 - (gx - x0) END) * (CASE WHEN dy = 1 THEN gy - y0 ELSE 1e0 - (gy - y0) END) AS w
               FROM q, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy))
    SELECT event_id, round(sum(v * w) / sum(w) FILTER (v IS NOT NULL), 6) AS v FROM c LEFT JOIN fx_grid g USING (row, col) GROUP BY event_id""")
def _(t):
    e = C("event_id")
    p = t.read("events").select("event_id", ((e * 7919 % 9000) / 100.0 + 0.004).alias("gy"), ((e * 104729 % 14000) / 100.0 + 0.003).alias("gx"))
    return Z.bilinear_sample(p, "event_id", "gx", "gy", t.grid().select("row", "col", "v")).select("event_id", F.round("v", 6).alias("v"))


@query("neighbor_any", "fx_grid", """
    WITH h AS (SELECT DISTINCT row + dr AS row, col + dc AS col FROM fx_grid, (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc)
               WHERE stream_mask AND (dr <> 0 OR dc <> 0))
    SELECT g.row, g.col, h.row IS NOT NULL AS near FROM fx_grid g LEFT JOIN h ON h.row = g.row AND h.col = g.col""")
def _(t):
    return J.neighbor_any(t.grid().select("row", "col", "stream_mask"), {"near": C("stream_mask")}).select("row", "col", "near")


@query("tile_edge_alignment", "fx_tile_cells", """
    WITH p AS (SELECT a.z, a.x, a.y, abs(a.v - b.v) AS d FROM fx_tile_cells a JOIN fx_tile_cells b
               ON b.z = a.z AND b.y = a.y AND b.row = a.row AND b.x = a.x + 1 AND a.col = 7 AND b.col = 0 WHERE a.v IS NOT NULL AND b.v IS NOT NULL)
    SELECT z, x, y, count(*) AS pairs, round(count_if(d <= 200) / count(*), 9) AS aligned, count_if(d <= 200) / count(*) >= 0.9 AS passed FROM p GROUP BY z, x, y""")
def _(t):
    return J.tile_edge_alignment(t.tile_cells(), 7, tolerance=200).withColumn("aligned", F.round("aligned", 9))


_PL = "SELECT c_custkey AS id, -125e0 + (c_custkey * 7919 % 58500) / 1e3 AS lon, 24e0 + (c_custkey * 104729 % 25500) / 1e3 AS lat FROM customer"
_HV = "round(6371.0088e0 * 2e0 * atan2(sqrt({h}), sqrt(1e0 - {h})), 6)".replace(
    "{h}", "(pow(sin(radians(b.lat - a.lat) / 2e0), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2e0), 2))")


def _catalog(t):
    k = C("c_custkey")
    return t.read("customer").select(k.alias("id"), (F.lit(-125.0) + (k * 7919 % 58500) / 1000.0).alias("lon"),
                                     (F.lit(24.0) + (k * 104729 % 25500) / 1000.0).alias("lat"))


@query("far_pairs", "", f"""
    WITH p AS ({_PL}) SELECT a.id AS from_id, b.id AS to_id, {_HV} AS km FROM p a JOIN p b ON a.id <> b.id ORDER BY km DESC, from_id, to_id LIMIT 40""")
def _(t):
    return J.far_pairs(_catalog(t), 40).select("from_id", "to_id", F.round("km", 6).alias("km"))


@query("named_pairs", "", f"""
    WITH p AS ({_PL}), r AS (SELECT c_custkey AS from_id, (c_custkey * 31 % 2000) AS to_id FROM customer)
    SELECT from_id, to_id, {_HV} AS km, a.id IS NOT NULL AND b.id IS NOT NULL AS known FROM r LEFT JOIN p a ON a.id = from_id LEFT JOIN p b ON b.id = to_id""")
def _(t):
    k = C("c_custkey")
    r = t.read("customer").select(k.alias("from_id"), (k * 31 % 2000).alias("to_id"))
    return J.named_pairs(r, _catalog(t)).withColumn("km", F.round("km", 6))


@query("catalog_lookup", "", """
    SELECT c_custkey AS request, n_name AS name, n_regionkey AS region FROM customer JOIN nation
    ON 'nation_' || (c_custkey % 40) = lower(n_name)""")
def _(t):
    k = C("c_custkey")
    r = t.read("customer").select(k.alias("request"), F.concat(F.lit("nAtIoN_"), (k % 40).cast("string")).alias("name"))
    c = t.read("nation").select(C("n_name").alias("name"), C("n_regionkey").alias("region"))
    return J.catalog_lookup(r, c, ["name"]).select("request", "name", "region")


@query("related_places", "", """
    WITH l AS (SELECT c_name AS name, 0 AS rank, c_custkey + 5 AS k FROM customer UNION ALL SELECT c_name, 1, c_custkey * 2 FROM customer UNION ALL SELECT c_name, 2, c_custkey - 3 FROM customer)
    SELECT l.name, rank, o.c_name AS related_name, o.c_custkey AS related_id FROM l JOIN customer o ON o.c_custkey = k""")
def _(t):
    k = C("c_custkey")
    nm = lambda c: F.concat(F.lit("CUSTOMER#"), F.lpad(c.cast("string"), 9, "0"))
    c = t.read("customer").select(C("c_name").alias("name"), k.alias("id"), F.array(nm(k + 5), nm(k * 2), nm(k - 3)).alias("rel"))
    return J.related_places(c, "name", "rel", ["name", "id"]).select("name", "rank", "related_name", "related_id")


_FT = (1, 3, 6, 10, 20, 30)


@query("threshold_compare", "fx_grid", """
    WITH f(threshold_ft) AS (VALUES (1e0), (3e0), (6e0), (10e0), (20e0), (30e0)), g(threshold_ft) AS (VALUES (3e0), (10e0), (30e0), (60e0)),
         a AS (SELECT threshold_ft, count_if(v <= threshold_ft * 0.3048e0 * 10e0) AS c, count(v) AS n FROM fx_grid, f GROUP BY 1),
         b AS (SELECT threshold_ft, count_if(cand <= threshold_ft * 0.3048e0 * 10e0) AS c, count(cand) AS n FROM fx_grid, g GROUP BY 1)
    SELECT a.threshold_ft, a.c AS cells_a, b.c AS cells_b, round(a.c * 100e0 / a.n, 9) AS pct_a, round(b.c * 100e0 / b.n, 9) AS pct_b
    FROM a JOIN b ON a.threshold_ft = b.threshold_ft""")
def _(t):
    g = t.grid()
    side = lambda value, feet, tag: R.threshold_coverage(g, value, feet).select(
        "threshold_ft", C("cells").alias(f"cells_{tag}"), F.round("coverage_pct", 9).alias(f"pct_{tag}"))
    return side("v", _FT, "a").join(side("cand", (3, 10, 30, 60), "b"), "threshold_ft")


_FL = """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN p_name END AS name, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_size % 5 END AS stream_order,
         CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE cast(p_partkey % 3 = 0 AS integer) END AS in_network, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS ftype FROM part"""


def _flowlines(t):
    k, s = C("p_partkey"), C("p_size")
    return t.read("part").select(
        k.alias("id"), F.when(k % 6 == 0, C("p_name")).alias("name"), F.when(s % 9 != 0, s % 5).alias("stream_order"),
        F.when(k % 10 != 0, (k % 3 == 0).cast("int")).alias("in_network"), F.when(k % 4 != 0, C("p_type")).alias("ftype"))


_CHOSEN = f"""
    l AS ({_FL}), k AS (SELECT *, coalesce(in_network, 0) = 1 AS net FROM l WHERE name IS NOT NULL OR coalesce(stream_order, 0) >= 3),
    ch AS (SELECT id, coalesce(name, ftype, 'Mapped drainage') AS label FROM k WHERE net OR NOT (SELECT coalesce(bool_or(net), false) FROM k))"""


@query("select_flowlines", "", f"WITH {_CHOSEN} SELECT id, label FROM ch")
def _(t):
    return J.select_flowlines(_flowlines(t), 3).select("id", "label")


@query("named_top_values", "", f"WITH {_CHOSEN} SELECT label, count(*) AS n FROM ch GROUP BY label ORDER BY n DESC, label LIMIT 16")
def _(t):
    return J.select_flowlines(_flowlines(t), 3).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(16)
