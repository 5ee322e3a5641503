"""Queries for covers, neighbourhoods, prefetch lists and line samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.operators import generators as G
from tilewater.operators import joins as J
from tilewater.plans import sqltext as S
from tilewater.plans.registry import query

C = F.col

_BOXES = ("SELECT event_id, lon AS west, lat AS south, lon + (event_id % 5) * 0.3e0 AS east, "
          "lat + (event_id % 7) * 0.2e0 AS north FROM fx_points")


def _boxes(t):
    e = C("event_id")
    return t.points().select("event_id", C("lon").alias("west"), C("lat").alias("south"),
                             (C("lon") + (e % 5) * 0.3).alias("east"), (C("lat") + (e % 7) * 0.2).alias("north"))


def _idx(expr):
    return f"greatest(0, least(cast(pow(2, z) AS integer) - 1, {S.i32('floor(' + expr + ')')}))"


@query("bbox_tile_cover", "fx_points", f"""
    WITH b AS ({_BOXES}), r AS (SELECT b.*, z FROM b, (VALUES (6), (7), (8)) AS zz(z)),
         x AS (SELECT event_id, z, {_idx(S.wx('west', 'z'))} AS x0, {_idx(S.wx('east', 'z'))} AS x1,
                      {_idx(S.wy('north', 'z'))} AS y0, {_idx(S.wy('south', 'z'))} AS y1 FROM r)
    SELECT event_id, z, x, unnest(range(y0, y1 + 1))::integer AS y FROM (SELECT event_id, z, y0, y1, unnest(range(x0, x1 + 1))::integer AS x FROM x)""")
def _(t):
    return G.bbox_tile_cover(_boxes(t), 6, 8).select("event_id", "z", "x", "y")


@query("bbox_tile_cover_margin", "fx_points", f"""
    WITH b AS (SELECT *, 7 AS z FROM ({_BOXES})),
         x AS (SELECT event_id, z, {S.tx('west', 'z')} AS x0, {S.tx('east', 'z')} AS x1, {S.ty('north', 'z')} AS y0, {S.ty('south', 'z')} AS y1 FROM b)
    SELECT event_id, z, x, unnest(range(greatest(0, y0 - 1), y1 + 2))::integer AS y
    FROM (SELECT event_id, z, y0, y1, unnest(range(greatest(0, x0 - 1), x1 + 2))::integer AS x FROM x)""")
def _(t):
    return G.bbox_tile_cover(_boxes(t), 7, 7, margin=1).select("event_id", "z", "x", "y")


@query("degree_tiles_for_bounds", "fx_requests", f"""
    WITH b AS (SELECT event_id, {S.i32("floor(" + S.top('y + 1', 'z') + " - 1e-12)")} AS la0, {S.i32("ceil(" + S.top('y', 'z') + " - 1e-12)")} AS la1,
                      {S.i32("floor(" + S.left('x', 'z') + " - 1e-12)")} AS lo0, {S.i32("ceil(" + S.left('x + 1', 'z') + " - 1e-12)")} AS lo1 FROM fx_requests),
         c AS (SELECT event_id, lo0, lo1, unnest(range(la0, la1 + 1))::integer AS lat FROM b),
         d AS (SELECT event_id, lat, unnest(range(lo0, lo1 + 1))::integer AS lon FROM c)
    SELECT event_id, lat, lon, {S.degree_id('lat', 'lon')} AS tile_id FROM d""")
def _(t):
    r = t.requests().select("event_id", A.tile_bounds(C("x"), C("y"), C("z")).alias("b"))
    d = J.degree_candidates(r, C("b.top"), C("b.bottom"), C("b.left"), C("b.right"))
    return d.select("event_id", "lat", "lon", A.degree_tile_id(C("lat"), C("lon")).alias("tile_id"))


@query("expected_degree_tiles", "fx_points", f"""
    WITH b AS (SELECT event_id, west, south, west - (event_id % 4) AS east, south + (event_id % 3) AS north FROM ({_BOXES})),
         c AS (SELECT event_id, west, east, unnest(range({S.i32('floor(south)')}, {S.i32('floor(north)')} + 1))::integer AS lat FROM b)
    SELECT event_id, lat, unnest(range({S.i32('floor(east)')}, {S.i32('floor(west)')} + 1))::integer AS lon FROM c""")
def _(t):
    e = C("event_id")
    b = _boxes(t).withColumn("east", C("west") - e % 4).withColumn("north", C("south") + e % 3)
    return G.expected_degree_tiles(b).select("event_id", "lat", "lon")


@query("region_tile_presets", "fx_degree_tiles", """
    WITH p(area, lat0, lat1, lon0, lon1) AS (VALUES ('miami', 25, 25, -81, -80), ('new_orleans', 29, 30, -90, -90),
        ('houston', 29, 30, -95, -95), ('nyc', 40, 41, -74, -74), ('gulf_coast', 25, 30, -98, -82))
    SELECT area, lat, lon FROM fx_degree_tiles JOIN p ON lat BETWEEN lat0 AND lat1 AND lon BETWEEN lon0 AND lon1""")
def _(t):
    return G.region_presets(t.degree_tiles()).select("area", "lat", "lon")


@query("tile_neighborhood", "fx_requests", f"""
    SELECT event_id, dx, dy, {S.i32('((x + dx) % pow(2, z) + pow(2, z)) % pow(2, z)')} AS nx,
           {S.i32('greatest(0, least(pow(2, z) - 1, y + dy))')} AS ny
    FROM fx_requests, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy)""")
def _(t):
    return G.tile_neighborhood(t.requests().select("event_id", "z", "x", "y"), 1).select("event_id", "dx", "dy", "nx", "ny")


_PRED = """
    WITH d(v) AS (VALUES (-1), (0), (1)), h(v) AS (VALUES (0), (1)),
    l(i, s) AS (VALUES (0, 0.5e0), (1, -0.5e0), (2, 1e0), (3, -1e0)),
    c AS (
      SELECT event_id, 100 + (a.v + 1) * 3 + b.v AS o, z AS pz, x + a.v AS px, y + b.v AS py, water_level_m AS pw, true AS tile FROM fx_requests, d a, d b WHERE a.v <> 0 OR b.v <> 0
      UNION ALL SELECT event_id, 200 + a.v * 2 + b.v, z + 1, x * 2 + a.v, y * 2 + b.v, water_level_m, true FROM fx_requests, h a, h b WHERE z < 14
      UNION ALL SELECT event_id, 300, z - 1, cast(floor(x / 2) AS integer), cast(floor(y / 2) AS integer), water_level_m, true FROM fx_requests WHERE z > 8
      UNION ALL SELECT event_id, 400 + i, z, x, y, water_level_m + s, false FROM fx_requests, l WHERE water_level_m + s BETWEEN -10 AND 50),
    v AS (SELECT c.*, printf('%.1f', pw) AS k FROM c WHERE NOT tile OR (pz BETWEEN 8 AND 14 AND px >= 0 AND py >= 0 AND px < pow(2, pz) AND py < pow(2, pz))),
    w AS (SELECT v.*, row_number() OVER (PARTITION BY v.event_id, pz, px, py, k ORDER BY o) AS again FROM v JOIN fx_requests r ON r.event_id = v.event_id
          WHERE NOT (pz = r.z AND px = r.x AND py = r.y AND k = printf('%.1f', r.water_level_m))),
    n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY o) - 1 AS rank FROM w WHERE again = 1)
    SELECT event_id, cast(rank AS integer) AS rank, pz, px, py, pw FROM n WHERE rank < 20"""


@query("predict_tiles", "fx_requests", _PRED)
def _(t):
    return G.predict_tiles(t.requests().select("event_id", "z", "x", "y", "water_level_m"), "event_id")


_VIEWS = f"""
    vw AS (SELECT event_id, lon, lat, {S.i32('3 + floor((event_id % 60) / 10)')} AS z FROM fx_points),
    wp AS (SELECT event_id, z, (lon + 180e0) / 360e0 * 256e0 * pow(2e0, z) AS wx,
                  (0.5e0 - ln((1e0 + sin(radians(lat))) / (1e0 - sin(radians(lat)))) / (4e0 * pi())) * 256e0 * pow(2e0, z) AS wy FROM vw)"""


def _grid_sql(pad: int, name: str) -> str:
    e = lambda c, off: S.i32(f"floor(({c} + {off}) / 256e0)")
    return f"""
    {name}_x AS (SELECT *, unnest(range({e('wx', -256.0)} - {pad}, {e('wx', 255.0)} + {pad} + 1))::integer AS tx FROM wp),
    {name}_y AS (SELECT *, unnest(range({e('wy', -200.0)} - {pad}, {e('wy', 199.0)} + {pad} + 1))::integer AS ty FROM {name}_x),
    {name} AS (SELECT event_id, z, {S.i32('((tx % pow(2, z)) + pow(2, z)) % pow(2, z)')} AS x, ty AS y,
                      sqrt(pow(tx - wx / 256e0, 2) + pow(ty - wy / 256e0, 2)) AS distance FROM {name}_y WHERE ty >= 0 AND ty < pow(2, z)),
    {name}_n AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(distance, 9), y, x) - 1 AS rk FROM {name})"""


def _views(t):
    return t.points().select("event_id", "lon", "lat", (F.lit(3.0) + (C("event_id") % 60) / 10.0).alias("zoom"))


@query("viewport_tiles", "fx_points", f"""
    WITH {_VIEWS}, {_grid_sql(0, 'g')} SELECT event_id, z, x, y, round(distance, 6) AS distance FROM g_n WHERE rk < 24""")
def _(t):
    return G.viewport_tiles(_views(t), "event_id", 512, 400).select(
        "event_id", "z", "x", "y", F.round("distance", 6).alias("distance"))


@query("viewport_ring_tiles", "fx_points", f"""
    WITH {_VIEWS}, {_grid_sql(0, 'g')}, {_grid_sql(1, 'p')},
    r AS (SELECT p_n.*, row_number() OVER (PARTITION BY event_id ORDER BY rk) - 1 AS rr FROM p_n
          WHERE rk < 96 AND NOT EXISTS (SELECT 1 FROM g_n WHERE g_n.event_id = p_n.event_id AND g_n.x = p_n.x AND g_n.y = p_n.y AND g_n.rk < 72))
    SELECT event_id, z, x, y, round(distance, 6) AS distance FROM r WHERE rr < 24""")
def _(t):
    return G.viewport_ring(_views(t), "event_id", 512, 400).select(
        "event_id", "z", "x", "y", F.round("distance", 6).alias("distance"))


_TO = "-125e0 + ((event_id * 104729) % 58500) / 1e3"


@query("jump_plan", "fx_points", f"""
    WITH j0 AS (SELECT event_id, lon, lat, 4e0 + (event_id % 90) / 10e0 AS zoom, {_TO} AS to_lon, 24e0 + ((event_id * 7919) % 25500) / 1e3 AS to_lat,
                       5e0 + (event_id % 70) / 10e0 AS to_zoom FROM fx_points),
    j1 AS (SELECT *, 2e0 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians(to_lat - lat) / 2e0), 2) + cos(radians(lat)) * cos(radians(to_lat)) * pow(sin(radians(to_lon - lon) / 2e0), 2)))) AS km FROM j0),
    vw AS (SELECT event_id, km, to_lon AS lon, to_lat AS lat, {S.i32('least(7, floor(to_zoom))')} AS z FROM j1
           WHERE km >= 250 OR (km >= 75 AND abs(to_zoom - zoom) >= 2.25)),
    wp AS (SELECT event_id, z, (lon + 180e0) / 360e0 * 256e0 * pow(2e0, z) AS wx,
                  (0.5e0 - ln((1e0 + sin(radians(lat))) / (1e0 - sin(radians(lat)))) / (4e0 * pi())) * 256e0 * pow(2e0, z) AS wy FROM vw),
    {_grid_sql(0, 'g')}
    SELECT event_id, z, x, y, round(distance, 6) AS distance FROM g_n WHERE rk < 24""")
def _(t):
    e = C("event_id")
    j = t.points().select("event_id", "lon", "lat", (F.lit(4.0) + (e % 90) / 10.0).alias("zoom"),
                          (F.lit(-125.0) + ((e * 104729) % 58500) / 1000.0).alias("to_lon"),
                          (F.lit(24.0) + ((e * 7919) % 25500) / 1000.0).alias("to_lat"), (F.lit(5.0) + (e % 70) / 10.0).alias("to_zoom"))
    return G.jump_plan(j, "event_id", 512, 400).select("event_id", "z", "x", "y", F.round("distance", 6).alias("distance"))


@query("cells_from_tile", "", f"""
    SELECT vec_id, {S.i32('floor(k / 8)')} AS row, {S.i32('k % 8')} AS col, v
    FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding) AS v FROM embeddings)""")
def _(t):
    return G.cells_from_tile(t.read("embeddings").select("vec_id", "embedding"), "embedding", 8)


@query("line_sample_points", "", """
    WITH v AS (SELECT c_custkey AS line_id, 0 AS i, c_custkey % 90 * 1e0 AS x, 0e0 AS y FROM customer
               UNION ALL SELECT c_custkey, 1, c_custkey % 90 + 3e0 + c_custkey % 4, 4e0 FROM customer
               UNION ALL SELECT c_custkey, 2, c_custkey % 90 + 3e0 + c_custkey % 4, 4e0 + (c_custkey % 6) * 2.5e0 FROM customer),
         s AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v WINDOW w AS (PARTITION BY line_id ORDER BY i)),
         g AS (SELECT *, sqrt(pow(x1 - x, 2) + pow(y1 - y, 2)) AS len FROM s WHERE x1 IS NOT NULL),
         c AS (SELECT *, sum(len) OVER (PARTITION BY line_id ORDER BY i) AS hi, sum(len) OVER (PARTITION BY line_id) AS total FROM g),
         n AS (SELECT DISTINCT line_id, total, greatest(2, cast(floor(total / 1.3e0) AS integer) + 1) AS n FROM c),
         k AS (SELECT line_id, total, n, unnest(range(0, n))::integer AS k FROM n),
         d AS (SELECT *, total * k / (n - 1) AS d FROM k),
         m AS (SELECT d.line_id, k, d, c.x, c.y, x1, y1, len, hi - len AS lo, row_number() OVER (PARTITION BY d.line_id, k ORDER BY i DESC) AS last
               FROM d JOIN c ON c.line_id = d.line_id AND hi - len <= d)
    SELECT line_id, k, round(x + (x1 - x) * CASE WHEN len > 0 THEN (d - lo) / len ELSE 0 END, 6) AS x,
           round(y + (y1 - y) * CASE WHEN len > 0 THEN (d - lo) / len ELSE 0 END, 6) AS y FROM m WHERE last = 1""")
def _(t):
    k = C("c_custkey")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x1 = k % 90 + 3 + k % 4
    line = F.array(p(k % 90, F.lit(0)), p(x1, F.lit(4)), p(x1, (k % 6) * 2.5 + 4.0))
    s = G.line_sample_points(t.read("customer").select(k.alias("line_id"), line.alias("pts")), "line_id", "pts", 1.3)
    return s.select("line_id", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("build_plan_rows", "fx_archives", """
    SELECT path AS id, step, stage FROM fx_archives,
        (VALUES (0, 'download_verify_inputs'), (1, 'compute_hand'), (2, 'write_source_cog'), (3, 'precompute_cache'), (4, 'qa_metrics')) AS s(step, stage)
    WHERE huc IN ('010001', '010002', '010096')""")
def _(t):
    r = t.archives().select(C("path").alias("id"), "huc").where(C("huc").isin("010001", "010002", "010096"))
    return G.build_plan_rows(r).select("id", "step", "stage")
