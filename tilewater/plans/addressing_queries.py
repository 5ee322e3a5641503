"""Queries for tile addressing and coverage geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.functions import geodesy as G
from tilewater.operators import joins as J
from tilewater.plans import sqltext as S
from tilewater.plans.registry import query

C = F.col


def _r(col, alias, n=9):
    return F.round(col, n).alias(alias)


@query("lonlat_to_tile", "fx_requests", "SELECT event_id, z, x, y FROM fx_requests")
def _(t):
    return t.requests().select("event_id", "z", "x", "y")


@query("lonlat_to_tile_floor", "fx_points", f"""
    WITH p AS (SELECT event_id, lon * 1.6e0 AS lon, lat * 2e0 AS lat, {S.i32('event_id % 12')} AS z FROM fx_points)
    SELECT event_id, z,
           {S.i32('greatest(0, least(pow(2e0, z) - 1, floor(' + S.wx('lon', 'z') + ')))')} AS x,
           {S.i32('greatest(0, least(pow(2e0, z) - 1, floor(' + S.wy(S.clip('lat'), 'z') + ')))')} AS y
    FROM p""")
def _(t):
    p = t.points().select("event_id", (C("lon") * 1.6).alias("lon"), (C("lat") * 2.0).alias("lat"),
                          (C("event_id") % 12).cast("int").alias("z"))
    return p.select("event_id", "z", A.tile_x_floor(C("lon"), C("z")).alias("x"),
                    A.tile_y_floor(C("lat"), C("z")).alias("y"))


@query("lonlat_to_tile_pixel", "fx_points", f"""
    WITH w AS (SELECT event_id, {S.wx('lon', '12')} AS wx, {S.wy(S.clip('lat'), '12')} AS wy FROM fx_points)
    SELECT event_id, {S.i32('floor(wx)')} AS x, {S.i32('floor(wy)')} AS y,
           {S.i32('greatest(0, least(255, trunc((wx - floor(wx)) * 256)))')} AS px,
           {S.i32('greatest(0, least(255, trunc((wy - floor(wy)) * 256)))')} AS py
    FROM w""")
def _(t):
    return t.points().select("event_id", A.tile_pixel(C("lon"), C("lat"), F.lit(12)).alias("a")).select("event_id", "a.*")


@query("tile_to_bounds", "fx_requests", f"""
    SELECT event_id, round({S.top('y', 'z')}, 9) AS lat_top, round({S.top('y + 1', 'z')}, 9) AS lat_bottom,
           round({S.left('x', 'z')}, 9) AS lon_left, round({S.left('x + 1', 'z')}, 9) AS lon_right
    FROM fx_requests""")
def _(t):
    b = A.tile_bounds(C("x"), C("y"), C("z"))
    return t.requests().select("event_id", b.alias("b")).select(
        "event_id", _r(C("b.top"), "lat_top"), _r(C("b.bottom"), "lat_bottom"), _r(C("b.left"), "lon_left"),
        _r(C("b.right"), "lon_right"))


_SPAN = "(2e0 * 20037508.342789244e0 / pow(2e0, z))"


@query("tile_mercator_bounds", "fx_requests", f"""
    SELECT event_id, round(x * {_SPAN} - 20037508.342789244e0, 5) AS minx,
           round(20037508.342789244e0 - y * {_SPAN} - {_SPAN}, 5) AS miny,
           round(x * {_SPAN} - 20037508.342789244e0 + {_SPAN}, 5) AS maxx,
           round(20037508.342789244e0 - y * {_SPAN}, 5) AS maxy
    FROM fx_requests""")
def _(t):
    return t.requests().select("event_id", A.tile_mercator_bounds(C("x"), C("y"), C("z")).alias("b")).select(
        "event_id", *[_r(C(f"b.{c}"), c, 5) for c in ("minx", "miny", "maxx", "maxy")])


@query("mercator_to_lonlat", "fx_points", """
    WITH m AS (SELECT event_id, lon * 1e5 AS mx, lat * 1e5 AS my FROM fx_points)
    SELECT event_id, round(mx / 20037508.342789244e0 * 180e0, 9) AS lon,
           round(degrees(2e0 * atan(exp(my / 20037508.342789244e0 * pi())) - pi() / 2e0), 9) AS lat
    FROM m""")
def _(t):
    m = A.mercator_to_lonlat(C("lon") * 1e5, C("lat") * 1e5)
    return t.points().select("event_id", m.alias("m")).select("event_id", _r(C("m.lon"), "lon"), _r(C("m.lat"), "lat"))


@query("lonlat_to_mercator", "fx_points", f"""
    SELECT event_id, round(lon * 20037508.342789244e0 / 180e0, 5) AS mx,
           round(ln(tan(({S.clip('lat')} + 90e0) * pi() / 360e0)) / pi() * 20037508.342789244e0, 5) AS my
    FROM fx_points""")
def _(t):
    return t.points().select("event_id", A.lonlat_to_mercator(C("lon"), C("lat")).alias("m")).select(
        "event_id", _r(C("m.mx"), "mx", 5), _r(C("m.my"), "my", 5))


@query("tile_pixel_centers", "fx_tile_cells", f"""
    SELECT vec_id, row, col, round(x * {_SPAN} - 20037508.342789244e0 + (col + 0.5e0) * {_SPAN} / 8, 5) AS cx,
           round(20037508.342789244e0 - y * {_SPAN} - (row + 0.5e0) * {_SPAN} / 8, 5) AS cy
    FROM fx_tile_cells""")
def _(t):
    from tilewater.operators.generators import tile_pixel_centers

    tiles = t.read("embeddings").select(
        "vec_id", F.lit(9).alias("z"), (F.lit(80) + C("vec_id") % 80).cast("int").alias("x"),
        (F.lit(176) + F.floor(C("vec_id") / 80)).cast("int").alias("y"))
    return tile_pixel_centers(tiles, size=8).select("vec_id", "row", "col", _r(C("cx"), "cx", 5), _r(C("cy"), "cy", 5))


_WRAP = "(((({0} + 180e0) % 360e0) + 360e0) % 360e0 - 180e0)"
_VLAT = "greatest(-85.051129e0, least(85.051129e0, {0}))"


@query("mercator_world_point", "fx_points", f"""
    WITH p AS (SELECT event_id, {_WRAP.format('(lon * 3e0)')} AS w, {_VLAT.format('(lat * 2e0)')} AS lat,
                      {S.i32('event_id % 12')} AS z FROM fx_points),
         q AS (SELECT event_id, CASE WHEN w = -180e0 THEN 180e0 ELSE w END AS lon, sin(radians(lat)) AS s,
                      256e0 * pow(2e0, z) AS scale FROM p)
    SELECT event_id, round((lon + 180e0) / 360e0 * scale, 6) AS wx,
           round((0.5e0 - ln((1e0 + s) / (1e0 - s)) / (4e0 * pi())) * scale, 6) AS wy, scale
    FROM q""")
def _(t):
    p = G.world_pixel(C("lon") * 3.0, C("lat") * 2.0, (C("event_id") % 12).cast("int"))
    return t.points().select("event_id", p.alias("p")).select("event_id", _r(C("p.wx"), "wx", 6), _r(C("p.wy"), "wy", 6),
                                                              C("p.scale").alias("scale"))


_H = ("(pow(sin(radians(33.5186e0 - lat) / 2e0), 2e0) + cos(radians(lat)) * cos(radians(33.5186e0)) * "
      "pow(sin(radians(-86.8104e0 - lon) / 2e0), 2e0))")


@query("haversine_km", "fx_points", f"""
    SELECT event_id, round(2e0 * 6371.0088e0 * asin(least(1e0, sqrt({_H}))), 6) AS km_asin,
           round(2e0 * 6371.0088e0 * atan2(sqrt({_H}), sqrt(1e0 - {_H})), 6) AS km_atan
    FROM fx_points""")
def _(t):
    to = (F.lit(-86.8104), F.lit(33.5186))
    return t.points().select("event_id", _r(G.haversine_km(C("lon"), C("lat"), *to), "km_asin", 6),
                             _r(G.haversine_km_atan(C("lon"), C("lat"), *to), "km_atan", 6))


_DLAT, _DLON = S.i32("floor(lat - 40e0)"), S.i32("floor(lon + 90e0)")


@query("degree_tile_id", "fx_points", f"""
    WITH d AS (SELECT event_id, {_DLAT} AS la, {_DLON} AS lo FROM fx_points)
    SELECT event_id, {S.degree_id('la', 'lo')} AS tile_id,
           CASE WHEN la >= 0 THEN 'N' ELSE 'S' END || lpad(cast(abs(la) AS varchar), 2, '0') ||
           CASE WHEN lo >= 0 THEN 'E' ELSE 'W' END || lpad(cast(abs(lo) AS varchar), 3, '0') AS compact_id
    FROM d""")
def _(t):
    d = t.points().select("event_id", F.floor(C("lat") - 40).cast("int").alias("la"),
                          F.floor(C("lon") + 90).cast("int").alias("lo"))
    return d.select("event_id", A.degree_tile_id(C("la"), C("lo")).alias("tile_id"),
                    A.compact_degree_id(C("la"), C("lo")).alias("compact_id"))


@query("parse_degree_tile_id", "fx_points", f"""
    WITH d AS (SELECT event_id, {_DLAT} AS la, {_DLON} AS lo FROM fx_points)
    SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE la END AS lat,
           CASE WHEN event_id % 5 = 4 THEN NULL ELSE lo END AS lon
    FROM d""")
def _(t):
    la, lo = F.floor(C("lat") - 40).cast("int"), F.floor(C("lon") + 90).cast("int")
    k = C("event_id") % 5
    name = F.when(k == 4, C("event_type")).when(k == 3, A.compact_degree_id(la, lo)) \
        .when(k == 2, F.upper(A.degree_tile_id(la, lo))).otherwise(A.degree_tile_id(la, lo))
    named = t.points().select("event_id", name.alias("name"))
    return named.select("event_id", A.parse_degree_tile_id(C("name")).alias("d")).select("event_id", "d.*")


@query("tile_family", "fx_requests", f"""
    SELECT event_id, {S.i32('floor(x / 2)')} AS parent_x, {S.i32('floor(y / 2)')} AS parent_y,
           {S.i32('floor(x / pow(2, z - 6))')} AS z6_x, {S.i32('floor(y / pow(2, z - 6))')} AS z6_y,
           x * 2 + 1 AS child_x, y * 2 AS child_y,
           cast(z AS varchar) || '/' || cast(x AS varchar) || '/' || cast(y AS varchar) AS tile_key,
           {S.i32('((x - 300) % pow(2, z) + pow(2, z)) % pow(2, z)')} AS moved_x,
           {S.i32('greatest(0, least(pow(2, z) - 1, y + 400))')} AS moved_y
    FROM fx_requests""")
def _(t):
    x, y, z = C("x"), C("y"), C("z")
    return t.requests().select(
        "event_id", A.ancestor(x, 1).alias("parent_x"), A.ancestor(y, 1).alias("parent_y"),
        A.ancestor(x, z - 6).alias("z6_x"), A.ancestor(y, z - 6).alias("z6_y"),
        (x * 2 + 1).alias("child_x"), (y * 2).alias("child_y"), A.tile_key(z, x, y).alias("tile_key"),
        A.wrap_x(x - 300, z).alias("moved_x"), A.clamp_y(y + 400, z).alias("moved_y"))


@query("tile_valid", "fx_points", f"""
    WITH r AS (SELECT event_id, {S.i32('event_id % 25 - 1')} AS z, {S.i32('event_id * 7919 % 5000 - 40')} AS x,
                      {S.i32('event_id * 104729 % 5000 - 40')} AS y, water_level_m * 100 - 20 AS w FROM fx_points),
         s AS (SELECT *, x >= 0 AND y >= 0 AND x < pow(2e0, greatest(z, 0)) AND y < pow(2e0, greatest(z, 0)) AS inside FROM r)
    SELECT event_id, z BETWEEN 0 AND 22 AND inside AS terrain_ok, z BETWEEN 0 AND 18 AND inside AS v1_ok,
           z BETWEEN 8 AND 14 AND inside AS preload_ok, w BETWEEN -50 AND 100 AS level_sane,
           w BETWEEN -10 AND 10000 AS level_ok
    FROM s""")
def _(t):
    e = C("event_id")
    r = t.points().select("event_id", (e % 25 - 1).cast("int").alias("z"), (e * 7919 % 5000 - 40).cast("int").alias("x"),
                          (e * 104729 % 5000 - 40).cast("int").alias("y"), (C("water_level_m") * 100 - 20).alias("w"))
    ok = lambda lo, hi: A.tile_valid(C("z"), C("x"), C("y"), lo, hi)
    return r.select("event_id", ok(0, 22).alias("terrain_ok"), ok(0, 18).alias("v1_ok"), ok(8, 14).alias("preload_ok"),
                    C("w").between(-50, 100).alias("level_sane"), C("w").between(-10, 10000).alias("level_ok"))


_BOX = ("lon * 1.5e0 AS west, lat * 2e0 AS south, lon * 1.5e0 + event_id % 7 - 3 AS east, "
        "lat * 2e0 + event_id % 11 - 4 AS north")


def _box(t):
    e = C("event_id")
    return t.points().select("event_id", "lon", "lat", (C("lon") * 1.5).alias("west"), (C("lat") * 2.0).alias("south"),
                             (C("lon") * 1.5 + e % 7 - 3).alias("east"), (C("lat") * 2.0 + e % 11 - 4).alias("north"))


@query("bbox_valid", "fx_points", f"""
    WITH b AS (SELECT event_id, {_BOX} FROM fx_points)
    SELECT event_id, -180 <= west AND west < east AND east <= 180 AND -90 <= south AND south < north AND north <= 90 AS ok
    FROM b""")
def _(t):
    return _box(t).select("event_id", A.bbox_valid(C("west"), C("south"), C("east"), C("north")).alias("ok"))


@query("bbox_contains", "fx_points fx_regions", """
    SELECT event_id, priority, west <= lon AND lon < east AND south <= lat AND lat < north AS inside
    FROM fx_points JOIN fx_regions ON priority = event_id % 25""")
def _(t):
    j = t.points().join(t.regions(), C("event_id") % 25 == C("priority"))
    return j.select("event_id", "priority",
                    A.bbox_contains(C("west"), C("south"), C("east"), C("north"), C("lon"), C("lat")).alias("inside"))


@query("bbox_intersects", "fx_points fx_regions", """
    SELECT event_id, priority, west < lon + 4e0 AND east > lon AND south < lat + 2e0 AND north > lat AS hit
    FROM fx_points JOIN fx_regions ON priority = event_id % 25""")
def _(t):
    j = t.points().join(t.regions(), C("event_id") % 25 == C("priority"))
    hit = A.bbox_intersects((C("west"), C("south"), C("east"), C("north")),
                            (C("lon"), C("lat"), C("lon") + 4.0, C("lat") + 2.0))
    return j.select("event_id", "priority", hit.alias("hit"))


@query("tile_shard", "fx_requests", f"""
    SELECT event_id, {S.i32('xor(xor(z::bigint * 73856093, x::bigint * 19349663), y::bigint * 83492791) % 7')} AS shard
    FROM fx_requests""")
def _(t):
    return t.requests().select("event_id", A.tile_shard(C("z"), C("x"), C("y"), 7).alias("shard"))


def _albers_sql() -> str:
    a = G.ALBERS_CONUS
    s = "sin(radians(lat))"
    q = (f"(({s} / (1e0 - {a.e2!r}::double * {s} * {s}) - ln((1e0 - {a.e!r}::double * {s}) / (1e0 + {a.e!r}::double * {s}))"
         f" / (2e0 * {a.e!r}::double)) * (1e0 - {a.e2!r}::double))")
    return f"""
    WITH q AS (SELECT event_id, lon, lat, sqrt({a.c!r}::double - {q} * {a.n!r}::double) * 6378137e0 / {a.n!r}::double AS rho,
                      radians(lon + 96e0) * {a.n!r}::double AS theta FROM fx_points)
    SELECT event_id, round(rho * sin(theta), 4) AS px, round({a.rho0!r}::double - rho * cos(theta), 4) AS py,
           round(lon, 7) AS lon_back, round(lat, 7) AS lat_back
    FROM q"""


@query("project_albers", "fx_points", _albers_sql())
def _(t):
    p = t.points().select("event_id", G.ALBERS_CONUS.forward(C("lon"), C("lat")).alias("p"))
    back = G.ALBERS_CONUS.inverse(C("p.px"), C("p.py"))
    return p.select("event_id", "p", back.alias("b")).select(
        "event_id", _r(C("p.px"), "px", 4), _r(C("p.py"), "py", 4), _r(C("b.lon"), "lon_back", 7),
        _r(C("b.lat"), "lat_back", 7))


@query("projected_grid_estimate", "fx_points", """
    WITH g AS (SELECT event_id, greatest(1, cast(round_even(water_level_m * 1e4 / 30e0, 0) AS bigint)) AS cols,
                      greatest(1, cast(round_even(abs(lat) * 1e3 / 30e0, 0) AS bigint)) AS rws FROM fx_points)
    SELECT event_id, cols AS columns, rws AS rows, cols * rws AS cells, cols * rws * 2 AS raw_bytes FROM g""")
def _(t):
    g = A.grid_estimate(C("water_level_m") * 1e4, F.abs("lat") * 1e3, 30.0)
    return t.points().select("event_id", g.alias("g")).select("event_id", "g.*")


@query("axis_index", "fx_points", f"""
    WITH axis AS (SELECT s_suppkey AS idx, -125e0 + s_suppkey * 0.5e0 + (s_suppkey % 3) * 0.1e0 AS c FROM supplier),
         mids AS (SELECT idx, (lag(c) OVER (ORDER BY idx) + c) / 2e0 AS lo, (lead(c) OVER (ORDER BY idx) + c) / 2e0 AS hi FROM axis)
    SELECT event_id, {S.i32('floor((lat - 24e0) / 0.25e0)')} AS row_index, idx AS near_index
    FROM fx_points JOIN mids ON (lo IS NULL OR lon > lo) AND (hi IS NULL OR lon <= hi)""")
def _(t):
    k = C("s_suppkey")
    axis = t.read("supplier").select(k.alias("idx"), (F.lit(-125.0) + k * 0.5 + (k % 3) * 0.1).alias("c"))
    near = J.nearest_on_axis(t.points(), "lon", axis, "idx", "c", bucket=1.0)
    return near.select("event_id", A.affine_index(24.0, 0.25, C("lat")).alias("row_index"), C("idx").alias("near_index"))
