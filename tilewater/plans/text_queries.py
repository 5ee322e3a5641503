"""Queries for strings, URLs, identifiers and payload parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewater.functions import text as X
from tilewater.plans import sqltext as S
from tilewater.plans.registry import query

C = F.col


def _struct(df, name):
    keys = [c for c in df.columns if c != name]
    return df.select(*keys, f"{name}.*")


@query("huc_code", "fx_archives", """
    SELECT pos, CASE WHEN pos % 6 = 5 THEN NULL ELSE huc END AS code,
           CASE WHEN pos % 4 IN (0, 1) THEN huc END AS from_name, left(huc, 4) AS parent FROM fx_archives""")
def _(t):
    k = C("pos") % 4
    name = F.when(k == 0, F.concat("huc", F.lit(".zip"))).when(k == 1, F.concat(F.lit("root/a/"), C("huc"), F.lit(".ZIP"))) \
        .when(k == 2, F.concat(F.lit("x"), C("huc"), F.lit(".zip"))).otherwise(F.concat("huc", F.lit(".tif")))
    raw = F.when(C("pos") % 6 == 5, F.concat("huc", F.lit("a"))).otherwise(F.concat(F.lit(" "), "huc", F.lit(" ")))
    return t.archives().select("pos", X.huc_valid(raw).alias("code"), X.huc_from_name(name).alias("from_name"),
                               F.substring("huc", 1, 4).alias("parent"))


@query("region_tags", "", """
    WITH c AS (SELECT c_custkey AS k, (c_custkey % 50 - 10) / 4e0 AS km,
                      CASE WHEN c_custkey % 7 = 0 THEN '--' ELSE ' ' || c_name || ' & ' || c_mktsegment || '!' END AS title,
                      lpad(cast(c_custkey % 22 AS varchar), 4, '0') AS a, lpad(cast(c_custkey % 19 AS varchar), 4, '0') AS b FROM customer),
         d AS (SELECT *, replace(replace(CASE WHEN km = floor(km) THEN cast(cast(km AS bigint) AS varchar) ELSE cast(km AS varchar) END, '.', 'p'), '-', 'm') AS tag FROM c)
    SELECT k, CASE WHEN k % 7 = 0 THEN 'region' ELSE trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') END AS slug,
           tag, 'pair-' || least(a, b) || '-' || greatest(a, b) || '-buffer' || tag || 'km' AS pair FROM d""")
def _(t):
    k = C("c_custkey")
    title = F.when(k % 7 == 0, "--").otherwise(F.concat(F.lit(" "), "c_name", F.lit(" & "), "c_mktsegment", F.lit("!")))
    c = t.read("customer").select(k.alias("k"), ((k % 50 - 10) / 4.0).alias("km"), title.alias("title"),
                                  F.lpad((k % 22).cast("string"), 4, "0").alias("a"), F.lpad((k % 19).cast("string"), 4, "0").alias("b"))
    return c.select("k", X.slugify(C("title")).alias("slug"), X.number_tag(C("km")).alias("tag"),
                    X.pair_tag(C("a"), C("b"), C("km")).alias("pair"))


@query("generalization_offset", "fx_points", """
    WITH p AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 4326 WHEN 1 THEN 5070 ELSE 3857 END AS epsg, water_level_m * 100 AS m FROM fx_points)
    SELECT event_id, CASE WHEN epsg = 4326 THEN m / 111320e0 ELSE m END AS "offset",
           CASE WHEN epsg = 4326 THEN 'degrees' ELSE 'crs_units' END AS units, CASE WHEN epsg = 4326 THEN 6 ELSE 2 END AS digits,
           event_id % 5 = 0 OR event_id % 3 = 1 AS srid_ok FROM p""")
def _(t):
    e = C("event_id")
    epsg = F.when(e % 3 == 0, 4326).when(e % 3 == 1, 5070).otherwise(3857)
    found = F.when(e % 10 == 0, F.array().cast("array<int>")).when(e % 10 != 5, F.array(F.lit(102039), F.lit(5070)))
    p = t.points().select("event_id", epsg.alias("epsg"), (C("water_level_m") * 100).alias("m"), found.alias("found"))
    return _struct(p.select("event_id", X.generalization_offset(C("epsg"), C("m")).alias("g"),
                            X.srid_matches(C("found"), C("epsg")).alias("srid_ok")), "g")


@query("coverage_label", "fx_archives", """
    WITH g AS (SELECT huc, bytes % 40 AS slot, count(*) AS n FROM fx_archives GROUP BY 1, 2)
    SELECT huc, slot, CASE WHEN n = 1 THEN 'Basin V0P21 Huc6 ' || huc ELSE cast(n AS varchar) || ' regions' END AS label FROM g""")
def _(t):
    g = t.archives().groupBy("huc", (C("bytes") % 40).alias("slot")).agg(F.count("*").alias("n"), F.min("huc").alias("h"))
    return g.select("huc", "slot", X.coverage_label(C("n"), F.concat(F.lit("basin-v0p21-huc6-"), "h")).alias("label"))


_BIG = "bytes * cast(pow(10, pos % 10) AS bigint)"


def _big(t):
    return t.archives().select("pos", (C("bytes") * F.pow(F.lit(10), C("pos") % 10).cast("bigint")).alias("n"))


@query("format_bytes_dec", "fx_archives", f"""
    WITH b AS (SELECT pos, {_BIG} AS n FROM fx_archives)
    SELECT pos, {S.pick(("n < 1e3", "cast(n AS varchar) || ' B'"), ("n < 1e6", "printf('%.1f', n / 1e3) || ' KB'"),
        ("n < 1e9", "printf('%.1f', n / 1e6) || ' MB'"), ("n < 1e12", "printf('%.1f', n / 1e9) || ' GB'"),
        other="printf('%.1f', n / 1e12) || ' TB'")} AS size FROM b""")
def _(t):
    return _big(t).select("pos", X.format_bytes_dec(C("n")).alias("size"))


@query("format_bytes_bin", "fx_archives", f"""
    WITH b AS (SELECT pos, {_BIG} AS n FROM fx_archives)
    SELECT pos, {S.pick(("n < 1024", "n || 'B'"), ("n < 1048576", "(n >> 10) || 'K'"), ("n < 1073741824", "(n >> 20) || 'M'"),
        ("n < 1099511627776", "(n >> 30) || 'G'"), ("n < 1125899906842624", "(n >> 40) || 'T'"), other="(n >> 50) || 'P'")} AS size FROM b""")
def _(t):
    return _big(t).select("pos", X.format_bytes_bin(C("n")).alias("size"))


@query("url_host", "fx_entries", r"""
    SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'invalid' ELSE lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) END AS host FROM fx_entries""")
def _(t):
    u = F.when(C("page_id") % 9 == 0, F.lit("/relative/path")).otherwise(C("url"))
    return t.entries().select("page_id", X.url_host(u).alias("host"))


@query("mime_group", "fx_entries", """
    SELECT page_id, CASE WHEN page_id % 8 = 7 THEN 'other' WHEN page_id % 6 = 0 THEN 'text' WHEN page_id % 6 = 1 THEN 'js' WHEN page_id % 6 = 2 THEN 'image'
        WHEN page_id % 6 = 3 THEN 'json' WHEN page_id % 6 = 4 THEN 'pbf' ELSE 'binary' END AS grp,
        CASE WHEN page_id % 2 = 0 THEN 'font/woff2' ELSE 'wasm' END AS grp2 FROM fx_entries""")
def _(t):
    m = F.when(C("page_id") % 8 == 7, F.lit("")).otherwise(C("mime"))
    m2 = F.when(C("page_id") % 2 == 0, "font/woff2; charset=x").otherwise("application/wasm")
    return t.entries().select("page_id", X.mime_group(m).alias("grp"), X.mime_group(m2).alias("grp2"))


@query("entry_size", "fx_entries", """
    SELECT page_id, CASE WHEN body_size > 0 THEN body_size ELSE headers_size + content_size END AS bytes FROM fx_entries""")
def _(t):
    return t.entries().select("page_id", X.entry_size(C("body_size"), C("headers_size"), C("content_size")).alias("bytes"))


@query("tile_url_parse", "fx_requests", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'elevation' WHEN event_id % 3 = 1 THEN 'vector' END AS kind,
           CASE WHEN event_id % 3 < 2 THEN z END AS z, CASE WHEN event_id % 3 < 2 THEN x END AS x,
           CASE WHEN event_id % 3 < 2 THEN y END AS y FROM fx_requests""")
def _(t):
    zxy = F.concat_ws("/", "z", "x", "y")
    k = C("event_id") % 3
    url = F.when(k == 0, F.concat(F.lit("https://t.example/api/v1/tiles/elevation-data/"), zxy, F.lit(".u16?method=precompressed"))) \
        .when(k == 1, F.concat(F.lit("https://t.example/api/v1/tiles/vector/usa/"), zxy, F.lit(".pbf"))) \
        .otherwise(F.concat(F.lit("https://t.example/api/v1/tiles/flood/"), zxy, F.lit(".png")))
    u = t.requests().select("event_id", url.alias("url"))
    return _struct(u.select("event_id", X.tile_url_parse(C("url")).alias("p")), "p")


def _view_url(t):
    e = C("event_id")
    s = lambda c: c.cast("string")
    url = F.concat(
        F.lit("https://maps.example/"), F.when(e % 6 == 0, "").otherwise("?a=1"),
        F.when(e % 6 == 0, "").otherwise(F.concat(F.lit("&lat="), s(e % 120 - 10), F.lit(".123456"))),
        F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("&lng=-"), s(e * 7919 % 200), F.lit(".5deg"))),
        F.when(e % 3 == 0, F.lit("&zoom=abc")).otherwise(F.concat(F.lit("&zoom="), s(e % 17), F.lit(".375"))),
        F.when(e % 5 == 0, F.lit("&water=-3")).otherwise(F.concat(F.lit("&water="), s(e * 31 % 12000), F.lit(".25"))))
    return t.points().select("event_id", F.when(e % 10 == 0, F.lit("https://maps.example/")).otherwise(url).alias("url"))


_R = "floor(greatest({lo}, least({hi}, {v})) * {f} + 0.5e0) / {f}"
_VIEW = f"""
    v AS (SELECT event_id, event_id % 10 = 0 AS bare,
            CASE WHEN event_id % 6 = 0 OR event_id % 10 = 0 THEN 33.5186e0
                 ELSE {_R.format(lo="-85.051129e0", hi="85.051129e0", f="1e5", v="cast((event_id % 120 - 10) || '.123456' AS double)")} END AS lat,
            CASE WHEN event_id % 4 = 0 OR event_id % 10 = 0 THEN -86.8104e0
                 ELSE {_R.format(lo="-180e0", hi="180e0", f="1e5", v="-((event_id * 7919) % 200 + 0.5e0)")} END AS lng,
            CASE WHEN event_id % 3 = 0 OR event_id % 10 = 0 THEN 11.3e0
                 ELSE {_R.format(lo="0e0", hi="14e0", f="1e2", v="(event_id % 17 + 0.375e0)")} END AS zoom,
            CASE WHEN event_id % 5 = 0 OR event_id % 10 = 0 THEN 10e0
                 ELSE {_R.format(lo="0.1e0", hi="10000e0", f="1e1", v="((event_id * 31) % 12000 + 0.25e0)")} END AS water
          FROM fx_points)"""


@query("view_state_parse", "fx_points", f"WITH {_VIEW} SELECT event_id, lat, lng, zoom, water, NOT bare AS explicit FROM v")
def _(t):
    return _struct(_view_url(t).select("event_id", X.view_state_parse(C("url")).alias("s")), "s")


@query("view_state_url", "fx_points", f"""
    WITH {_VIEW} SELECT event_id, 'https://maps.example/?lat=' || printf('%.5f', lat) || '&lng=' || printf('%.5f', lng) || '&zoom=' ||
        printf('%.2f', zoom) || '&view=hand&water=' || printf('%.1f', water) AS share_url FROM v""")
def _(t):
    v = _view_url(t).select("event_id", X.view_state_parse(C("url")).alias("s"))
    return v.select("event_id", X.view_state_url(F.lit("https://maps.example/"), C("s")).alias("share_url"))


_PLACES = """
    p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_name || ', ' || c_mktsegment END AS label,
            CASE WHEN c_custkey % 5 = 0 THEN 'City ' || c_nationkey WHEN c_custkey % 5 = 1 THEN 'Town ' || c_nationkey
                 WHEN c_custkey % 5 = 2 THEN '350' || c_nationkey WHEN c_custkey % 5 = 3 THEN 'Named ' || c_nationkey ELSE c_name END AS name,
            CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 25 + c_custkey % 20 + 0.125e0 END AS latitude, -80e0 - c_custkey % 30 AS longitude,
            CASE WHEN c_custkey % 3 = 0 THEN 25 + c_custkey % 20 - 0.5e0 END AS south, CASE WHEN c_custkey % 3 = 0 THEN 25 + c_custkey % 20 + 0.5e0 END AS north,
            CASE WHEN c_custkey % 3 = 0 THEN -81e0 - c_custkey % 30 END AS west, CASE WHEN c_custkey % 3 = 0 THEN -79e0 - c_custkey % 30 END AS east
          FROM customer),
    q AS (SELECT * FROM p WHERE label IS NOT NULL AND latitude IS NOT NULL)"""


def _places(t):
    """Geocoder payloads, one JSON text per customer, with every fallback and every defect."""
    k = C("c_custkey")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    n = C("c_nationkey").cast("string")
    address = F.when(k % 5 == 0, F.concat(F.lit('{"city":" City '), n, F.lit('","town":"x"}'))) \
        .when(k % 5 == 1, F.concat(F.lit('{"city":"  ","town":"Town '), n, F.lit('"}'))) \
        .when(k % 5 == 2, F.concat(F.lit('{"postcode":"350'), n, F.lit('"}'))).otherwise("{}")
    name = F.when(k % 5 == 3, F.concat(F.lit('"Named '), n, F.lit('"'))).otherwise(F.lit('""'))
    la, lo = 25 + k % 20, -80 - k % 30
    s = lambda c: c.cast("string")
    box = F.when(k % 3 == 0, F.concat(F.lit('["'), s(la - 0.5), F.lit('","'), s(la + 0.5), F.lit('","'), s(lo - 1), F.lit('","'), s(lo + 1), F.lit('"]'))) \
        .when(k % 3 == 1, '["1","2","3"]').otherwise('["1","2","3","north"]')
    body = F.concat(
        F.lit('{"display_name":'), F.when(k % 13 == 0, q(F.lit("  "))).otherwise(q(F.concat(F.lit(" "), "c_name", F.lit(", "), "c_mktsegment"))),
        F.lit(',"name":'), name, F.lit(',"lat":'), F.when(k % 11 == 0, q(F.lit("n/a"))).otherwise(q(F.concat(s(la), F.lit(".125")))),
        F.lit(',"lon":'), q(s(lo)), F.lit(',"boundingbox":'), box, F.lit(',"address":'), address, F.lit("}"))
    return X.place_parse(t.read("customer").select(k.alias("k"), body.alias("payload")), "payload")


@query("place_parse", "", f"WITH {_PLACES} SELECT k, name, label, latitude, longitude, south, north, west, east FROM q")
def _(t):
    return _places(t)


@query("search_target", "", f"""
    WITH {_PLACES} SELECT k, CASE WHEN south IS NOT NULL THEN 'bounds' ELSE 'point' END AS target,
        CASE WHEN south IS NOT NULL THEN (south + north) / 2e0 ELSE latitude END AS center_lat,
        CASE WHEN south IS NOT NULL THEN (west + east) / 2e0 ELSE longitude END AS center_lng,
        least(11e0, CASE WHEN south IS NOT NULL THEN k % 14 * 1e0 ELSE 10.5e0 END) AS zoom FROM q""")
def _(t):
    return _places(t).select("k", *X.search_target(F.lit(11.0), (C("k") % 14).cast("double")))


@query("search_signature", "", f"""
    WITH {_PLACES} SELECT cast(floor(k / 8) AS bigint) AS page,
        string_agg(name || '|' || label || '|' || printf('%.5f', latitude) || '|' || printf('%.5f', longitude), '||' ORDER BY k) AS signature
    FROM q GROUP BY 1""")
def _(t):
    # a result page holds at most eight places, so the ordered text is bounded
    item = F.concat_ws("|", "name", "label", F.format_string("%.5f", "latitude"), F.format_string("%.5f", "longitude"))
    pages = _places(t).withColumn("page", F.floor(C("k") / 8))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("s")))), lambda r: r["s"]), "||")
    return pages.groupBy("page").agg(joined.alias("signature"))


@query("client_ip", "fx_points", """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '10.0.0.' || user_id WHEN event_id % 5 = 1 THEN '10.1.0.' || user_id
        WHEN event_id % 5 = 2 THEN '10.2.0.' || user_id WHEN event_id % 5 = 3 THEN '10.9.0.' || user_id ELSE 'unknown' END AS ip FROM fx_points""")
def _(t):
    u = C("user_id").cast("string")
    ip = lambda p: F.concat(F.lit(p), u)
    k = C("event_id") % 5
    kv = lambda *a: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in a])
    headers = F.when(k == 0, kv("x-real-ip", "10.8.8.8", "cf-connecting-ip", ip("10.0.0."))) \
        .when(k == 1, kv("cf-connecting-ip", "unknown", "x-forwarded-for", F.concat(F.lit(" "), ip("10.1.0."), F.lit(", 10.7.7.7")))) \
        .when(k == 2, kv("x-client-ip", ip("10.2.0."), "x-real-ip", "")).otherwise(kv("accept", "*/*"))
    direct = F.when(k == 3, ip("10.9.0."))
    p = t.points().select("event_id", headers.alias("h"), direct.alias("d"))
    return p.select("event_id", X.client_ip(C("h"), C("d")).alias("ip"))


@query("feature_prune", "", """
    WITH f AS (SELECT cast(5 + l_orderkey % 6 AS integer) AS z, cast(l_partkey % 32 AS integer) AS x, cast(l_suppkey % 32 AS integer) AS y,
            CASE (l_orderkey + l_linenumber) % 6 WHEN 0 THEN 'water' WHEN 1 THEN 'waterway' WHEN 2 THEN 'transportation' WHEN 3 THEN 'poi' WHEN 4 THEN 'building' ELSE 'place' END AS layer,
            CASE WHEN l_orderkey % 17 = 0 THEN NULL ELSE 'POINT(' || l_partkey || ' ' || l_suppkey || ')' END AS geometry,
            l_returnflag AS class, l_linestatus AS name FROM lineitem),
         c AS (SELECT *, layer IN ('water', 'waterway', 'transportation') AND geometry IS NOT NULL AS kept, coalesce(length(geometry), 0) AS g,
            length('{"class":"' || class || '","name":"' || name || '"}') AS full_len,
            CASE WHEN layer IN ('water', 'waterway') THEN length('{"class":"' || class || '"}') ELSE 2 END AS small_len FROM f),
         u AS (SELECT z, x, y, sum(CASE WHEN kept THEN small_len + g END) AS small, sum(full_len + g) AS full_size FROM c GROUP BY z, x, y),
         j AS (SELECT c.*, c.z <= 8 AND small IS NOT NULL AND small < full_size AS pruned FROM c JOIN u ON c.z = u.z AND c.x = u.x AND c.y = u.y)
    SELECT z, x, y, layer, pruned, count(*) AS features,
           cast(sum(CASE WHEN NOT pruned THEN 2 WHEN layer IN ('water', 'waterway') THEN 1 ELSE 0 END) AS bigint) AS props
    FROM j WHERE NOT pruned OR kept GROUP BY z, x, y, layer, pruned""")
def _(t):
    k = (C("l_orderkey") + C("l_linenumber")) % 6
    layer = F.when(k == 0, "water").when(k == 1, "waterway").when(k == 2, "transportation").when(k == 3, "poi").when(k == 4, "building").otherwise("place")
    geom = F.when(C("l_orderkey") % 17 != 0, F.concat(F.lit("POINT("), C("l_partkey").cast("string"), F.lit(" "), C("l_suppkey").cast("string"), F.lit(")")))
    f = t.read("lineitem").select(
        (5 + C("l_orderkey") % 6).cast("int").alias("z"), (C("l_partkey") % 32).cast("int").alias("x"), (C("l_suppkey") % 32).cast("int").alias("y"),
        layer.alias("layer"), geom.alias("geometry"),
        F.create_map(F.lit("class"), C("l_returnflag"), F.lit("name"), C("l_linestatus")).alias("props"))
    return X.feature_prune(f).groupBy("z", "x", "y", "layer", "pruned").agg(F.count("*").alias("features"), F.sum(F.size("props")).alias("props"))
