"""Queries for inventory, ingest planning and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewater.operators import planning as P
from tilewater.operators import windows as W
from tilewater.plans.raster_queries import _round
from tilewater.plans.registry import query
from tilewater.sources import documents as D

C = F.col


@query("source_inventory", "fx_archives", """
    WITH u AS (SELECT huc, count(*) AS n FROM fx_archives WHERE valid_name GROUP BY huc)
    SELECT count(*) AS files, (SELECT count(*) FROM u) AS units, cast(sum(bytes) AS bigint) AS bytes, (SELECT count_if(n > 1) FROM u) AS duplicate_units, count_if(NOT valid_name) AS invalid_names,
           greatest(0, 331 - (SELECT count(*) FROM u)) AS remaining_units, round((SELECT count(*) FROM u) / 331, 9) AS unit_fraction,
           cast(greatest(0, 4224140860297 - sum(bytes)) AS bigint) AS remaining_bytes, round(sum(bytes) / 4224140860297, 9) AS byte_fraction FROM fx_archives""")
def _(t):
    return _round(P.source_inventory(t.archives(), 331, 4_224_140_860_297))


@query("duplicate_archives", "fx_archives", """
    SELECT huc, path, n AS copies FROM (SELECT *, count(*) OVER (PARTITION BY huc) AS n FROM fx_archives WHERE valid_name) WHERE n > 1""")
def _(t):
    return P.duplicate_archives(t.archives())


_BEST = "b AS (SELECT huc, path, bytes FROM (SELECT *, row_number() OVER (PARTITION BY huc ORDER BY bytes DESC, pos) AS rn FROM fx_archives WHERE valid_name AND bytes > 0) WHERE rn = 1)"
_DONE = "d AS (SELECT DISTINCT huc FROM fx_archives WHERE pos % 97 % 3 = 0)"


def _done(t):
    return t.archives().where(C("pos") % 97 % 3 == 0).select("huc").distinct()


@query("ingest_plan", "fx_archives", f"""
    WITH {_BEST}, {_DONE} SELECT huc, path, bytes, 'planned' AS status FROM b WHERE huc LIKE '010%' AND huc > '010010' AND huc NOT IN (SELECT huc FROM d) ORDER BY huc LIMIT 25""")
def _(t):
    return P.ingest_plan(W.preferred_archive(t.archives()), _done(t), prefix="010", start_after="010010", limit=25)


_REQ = "q AS (SELECT DISTINCT lpad(cast(10000 + s_suppkey * 3 % 150 AS varchar), 6, '0') AS huc FROM supplier)"


def _requested(t):
    return t.read("supplier").select(F.lpad((F.lit(10000) + C("s_suppkey") * 3 % 150).cast("string"), 6, "0").alias("huc"))


@query("missing_requested", "fx_archives", f"WITH {_BEST}, {_REQ} SELECT huc FROM q WHERE huc > '010010' AND huc NOT IN (SELECT huc FROM b)")
def _(t):
    return P.missing_requested(_requested(t), W.preferred_archive(t.archives()), start_after="010010")


@query("ingest_states", "fx_archives", f"""
    WITH {_BEST}, {_REQ}, m AS (SELECT DISTINCT lpad(cast(10000 + p_partkey % 140 AS varchar), 6, '0') AS huc FROM part WHERE p_partkey % 140 % 4 = 0)
    SELECT huc, CASE WHEN huc NOT IN (SELECT huc FROM b) AND huc NOT IN (SELECT huc FROM m) THEN 'missing' WHEN huc IN (SELECT huc FROM m) THEN 'ready' ELSE 'missing_manifest' END AS state FROM q""")
def _(t):
    k = C("p_partkey") % 140
    m = t.read("part").where(k % 4 == 0).select(F.lpad((F.lit(10000) + k).cast("string"), 6, "0").alias("huc")).distinct()
    return P.ingest_states(_requested(t), W.preferred_archive(t.archives()), m)


def _progress_lines(t):
    """Append-only JSON lines, one per event; every thirteenth line is damaged."""
    e = C("event_id")
    state = F.when(C("event_type") == "view", "start").when(C("event_type") == "error", "failed").otherwise("completed")
    doc = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), state.alias("event"),
                             F.lpad((F.lit(10000) + C("user_id") % 97).cast("string"), 6, "0").alias("huc"), (e * 10).alias("output_bytes")))
    return t.read("events").select(e.alias("line"), F.when(e % 13 == 0, F.substring(doc, 1, 20)).otherwise(doc).alias("text"))


@query("scan_progress_log", "", """
    WITH p AS (SELECT event_id AS line, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CASE event_type WHEN 'view' THEN 'start' WHEN 'error' THEN 'failed' ELSE 'completed' END AS event,
                      lpad(cast(10000 + user_id % 97 AS varchar), 6, '0') AS huc FROM events WHERE event_id % 13 <> 0),
         r AS (SELECT *, row_number() OVER (PARTITION BY huc ORDER BY ts DESC, line DESC) AS rn, count(*) OVER (PARTITION BY huc) AS n FROM p)
    SELECT huc, event, ts, n AS events FROM r WHERE rn = 1""")
def _(t):
    return P.latest_progress(D.parse_progress(_progress_lines(t), "text"))


@query("run_status_counts", "fx_requests", """
    WITH r AS (SELECT z, CASE event_id % 4 WHEN 0 THEN 'existing' WHEN 1 THEN 'empty-skipped' ELSE 'written' END AS status, event_id % 131072 AS bytes, (event_id * 37 % 900) / 1e1 AS ms FROM fx_requests)
    SELECT z, count_if(status = 'written') AS written, count_if(status = 'existing') AS existing, count_if(status = 'empty-skipped') AS empty_skipped,
           cast(coalesce(sum(bytes) FILTER (status = 'written'), 0) AS bigint) AS bytes, max(ms) AS max_ms FROM r GROUP BY z""")
def _(t):
    e = C("event_id")
    s = F.when(e % 4 == 0, "existing").when(e % 4 == 1, "empty-skipped").otherwise("written")
    return P.run_status_counts(t.requests().select("z", s.alias("status"), (e % 131072).alias("bytes"), ((e * 37 % 900) / 10.0).alias("ms")), ["z"])


def _manifest_regions(t):
    k = C("c_custkey")
    lay = F.when(k % 3 == 0, "elevation").otherwise("hand")
    w, s = -125 + (k % 5) * 11.5, 24 + (k % 4) * 5.25
    # document 0, 5, 10, ... hold a region whose box is the wrong way round
    east = F.when((F.floor(k / 8) % 5 == 0) & (k % 8 == 3), w - 1).otherwise(w + 12.5)
    return t.read("customer").select(
        F.floor(k / 8).alias("doc"), k.alias("pos"), lay.alias("layer"), F.when(lay == "hand", "uint16-decimeters").otherwise("elevation-meter-range").alias("encoding"),
        C("c_name").alias("id"), w.cast("double").alias("west"), s.cast("double").alias("south"), east.cast("double").alias("east"),
        (s + 6.5).cast("double").alias("north"), F.lit("EPSG:5070").alias("crs"), F.concat(F.lit("file:///data/"), "c_name").alias("url"))


_MR = """mr AS (SELECT cast(floor(c_custkey / 8) AS bigint) AS doc, c_custkey AS pos, CASE WHEN c_custkey % 3 = 0 THEN 'elevation' ELSE 'hand' END AS layer, c_name AS id, -125 + (c_custkey % 5) * 11.5e0 AS west,
         24 + (c_custkey % 4) * 5.25e0 AS south, CASE WHEN floor(c_custkey / 8) % 5 = 0 AND c_custkey % 8 = 3 THEN -126 + (c_custkey % 5) * 11.5e0 ELSE -112.5 + (c_custkey % 5) * 11.5e0 END AS east,
         30.5 + (c_custkey % 4) * 5.25e0 AS north, 'EPSG:5070' AS crs, 'file:///data/' || c_name AS url FROM customer)"""


@query("build_manifest", "", f"""
    WITH {_MR}, j AS (SELECT doc, layer, '"' || layer || '":{{"encoding":"' || CASE layer WHEN 'hand' THEN 'uint16-decimeters' ELSE 'elevation-meter-range' END || '","nodata":65535,"regions":[' ||
        string_agg('{{"id":"' || id || '","bbox":[' || west || ',' || south || ',' || east || ',' || north || '],"crs":"EPSG:5070","url":"' || url || '"}}', ',' ORDER BY pos) || ']}}' AS txt FROM mr GROUP BY doc, layer)
    SELECT doc, '{{"schema_version":1,"dataset_version":"v1","layers":{{' || string_agg(txt, ',' ORDER BY layer) || '}}}}' AS manifest FROM j GROUP BY doc""")
def _(t):
    return P.build_manifest(_manifest_regions(t), "v1", ["doc"])


@query("scan_manifest", "", f"""
    WITH {_MR}, g AS (SELECT doc FROM mr GROUP BY doc HAVING bool_and(west < east))
    SELECT doc, 'v1' AS dataset_version, layer, CASE layer WHEN 'hand' THEN 'uint16-decimeters' ELSE 'elevation-meter-range' END AS encoding,
           cast(row_number() OVER (PARTITION BY doc, layer ORDER BY pos) - 1 AS integer) AS priority, id, west, south, east, north, crs, url FROM mr WHERE doc IN (SELECT doc FROM g)""")
def _(t):
    return P.scan_manifest(P.build_manifest(_manifest_regions(t), "v1", ["doc"]), "manifest")


@query("scan_tile_catalog", "fx_requests", """
    SELECT z, count(*) AS tiles, (SELECT min(z) FROM fx_requests) AS min_zoom, (SELECT max(z) FROM fx_requests) AS max_zoom FROM fx_requests GROUP BY z""")
def _(t):
    return P.tile_catalog(t.requests())


@query("nearest_sorted_bounds", "fx_points", """
    SELECT event_id, lat + 1e0 AS lat_max, lon AS lon_min FROM fx_points ORDER BY lat_max DESC, lon_min, event_id""")
def _(t):
    b = t.points().select("event_id", (C("lat") + 1.0).alias("lat_max"), C("lon").alias("lon_min"))
    return b.orderBy(F.desc("lat_max"), "lon_min", "event_id")
