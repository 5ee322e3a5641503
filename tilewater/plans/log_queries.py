"""Queries for request logs, latencies and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewater.operators import logs as L
from tilewater.plans.raster_queries import _round
from tilewater.plans.registry import query
from tilewater.sources import documents as D

C = F.col

_ENC = "CASE WHEN page_id % 3 = 0 THEN 'br' WHEN page_id % 5 = 0 THEN 'gzip' ELSE '(none)' END"
_CAC = "CASE WHEN page_id % 4 = 1 THEN 'public, max-age=3600' ELSE '(none)' END"


def _enc():
    k = C("page_id")
    return F.when(k % 3 == 0, "br").when(k % 5 == 0, "gzip").otherwise("(none)")


def _cac():
    return F.when(C("page_id") % 4 == 1, "public, max-age=3600").otherwise("(none)")


def _har_docs(t):
    """Log documents of up to ten entries each, as JSON text."""
    h = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    entry = F.struct(
        C("time_ms").alias("time"), F.struct("url").alias("request"),
        F.struct((F.lit(200) + C("page_id") % 3).alias("status"), C("body_size").alias("bodySize"), C("headers_size").alias("headersSize"),
                 F.array(h("X-Other", F.lit("1")), h("Content-Encoding", F.nullif(_enc(), F.lit("(none)"))),
                         h("cache-control", F.nullif(_cac(), F.lit("(none)")))).alias("headers"),
                 F.struct(C("content_size").alias("size"), C("mime").alias("mimeType")).alias("content")).alias("response"))
    docs = t.entries().groupBy(F.floor(C("page_id") / 10).alias("doc")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda i: i["e"]).alias("entries"))
    return docs.select("doc", F.to_json(F.struct(F.struct("entries").alias("log"))).alias("text"))


@query("scan_har", "fx_entries", f"""
    SELECT cast(floor(page_id / 10) AS bigint) AS doc, cast(page_id % 10 AS integer) AS entry, url, cast(200 + page_id % 3 AS integer) AS status, mime,
           body_size, cast(headers_size AS bigint) AS headers_size, content_size, time_ms, {_ENC} AS encoding, {_CAC} AS cache FROM fx_entries""")
def _(t):
    return D.scan_har(_har_docs(t), "text")


_HOST = "lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"
_TYPE = "CASE page_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'js' WHEN 2 THEN 'image' WHEN 3 THEN 'json' WHEN 4 THEN 'pbf' ELSE 'binary' END"
_SIZE = "CASE WHEN body_size > 0 THEN body_size ELSE headers_size + content_size END"
_SIZED = f"s AS (SELECT *, {_HOST} AS host, {_TYPE} AS type, {_SIZE} AS bytes, {_ENC} AS encoding, {_CAC} AS cache FROM fx_entries)"


@query("transfer_totals", "fx_entries", f"""
    WITH {_SIZED} SELECT host, type, cast(sum(bytes) AS bigint) AS bytes, count(*) AS requests FROM s GROUP BY GROUPING SETS ((host), (type), ())""")
def _(t):
    return L.transfer_totals(t.entries())


@query("transfer_by_zoom", "fx_entries", f"""
    WITH {_SIZED} SELECT kind, z, cast(sum(bytes) AS bigint) AS bytes, count(*) AS requests, round(sum(time_ms), 6) AS total_ms, round(avg(time_ms), 6) AS avg_ms, max(time_ms) AS max_ms,
        string_agg(DISTINCT encoding, ',' ORDER BY encoding) AS encodings, string_agg(DISTINCT cache, ',' ORDER BY cache) AS caches
    FROM s GROUP BY GROUPING SETS ((kind, z), (kind))""")
def _(t):
    e = L.with_sizes(t.entries()).withColumn("encoding", _enc()).withColumn("cache", _cac())
    return _round(L.transfer_by_zoom(e), 6)


@query("largest_entries", "fx_entries", f"""
    WITH {_SIZED} SELECT page_id, url, type, bytes FROM s ORDER BY bytes DESC, url, page_id LIMIT 25""")
def _(t):
    return L.largest_entries(t.entries()).select("page_id", "url", "type", "bytes")


_EV = """e AS (SELECT event_id AS seq, z, (event_id * 37 % 10000) / 1e1 AS elapsed_ms, CASE event_type WHEN 'view' THEN 'request' WHEN 'click' THEN 'response' WHEN 'purchase' THEN 'finished'
         WHEN 'error' THEN 'failed' ELSE 'request' END AS kind, CASE WHEN event_id % 9 <> 0 THEN event_id % 5000 END AS body_bytes, CASE WHEN event_id % 8 <> 0 THEN event_id % 300 END AS header_bytes FROM fx_requests)"""


def _events(t):
    e, ty = C("event_id"), C("event_type")
    kind = F.when(ty == "click", "response").when(ty == "purchase", "finished").when(ty == "error", "failed").otherwise("request")
    return t.requests().select(e.alias("seq"), "z", ((e * 37 % 10000) / 10.0).alias("elapsed_ms"), kind.alias("kind"),
                               F.when(e % 9 != 0, e % 5000).alias("body_bytes"), F.when(e % 8 != 0, e % 300).alias("header_bytes"))


_FUN = ", ".join(f"count_if(kind = '{k}') AS {k}_n, arg_min(elapsed_ms, seq) FILTER (kind = '{k}') AS first_{k}_ms" for k in ("request", "response", "finished", "failed"))


@query("event_funnel", "fx_requests", f"WITH {_EV} SELECT z, {_FUN} FROM e GROUP BY ROLLUP (z)")
def _(t):
    return L.event_funnel(_events(t))


@query("transfer_finished", "fx_requests", f"""
    WITH {_EV} SELECT z, count(*) AS n, cast(sum(coalesce(body_bytes, 0) + coalesce(header_bytes, 0)) AS bigint) AS transfer_bytes, cast(coalesce(sum(body_bytes), 0) AS bigint) AS body_bytes,
        arg_min(elapsed_ms, seq) AS first_ms, arg_max(elapsed_ms, seq) AS last_ms FROM e WHERE kind = 'finished' GROUP BY ROLLUP (z)""")
def _(t):
    return L.transfer_finished(_events(t))


_RES = """r AS (SELECT event_id, event_type AS scenario, z, 1e0 + (event_id * 7919 % 99991) / 1e2 AS time_ms, CASE WHEN event_id % 10 = 0 THEN 'timeout' END AS error,
          50e0 + event_id % 200 AS memory_mb, event_id % 3 = 0 AS cache_hit FROM fx_requests)"""


def _results(t):
    e = C("event_id")
    return t.requests().select("event_id", C("event_type").alias("scenario"), "z", ((e * 7919 % 99991) / 100.0 + 1.0).alias("time_ms"),
                               F.when(e % 10 == 0, "timeout").alias("error"), (F.lit(50.0) + e % 200).alias("memory_mb"), (e % 3 == 0).alias("cache_hit"))


@query("latency_report", "fx_requests", f"""
    WITH {_RES}, o AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY time_ms, event_id) AS i, count(*) OVER (PARTITION BY scenario) AS n FROM r WHERE error IS NULL),
    q AS (SELECT scenario, any_value(n) AS n, any_value(floor((n + 1) * 19 / 20)) AS j, any_value((n + 1) * 19 / 20 - floor((n + 1) * 19 / 20)) AS d FROM o GROUP BY scenario),
    p AS (SELECT o.scenario, max(CASE WHEN i = j THEN time_ms END) AS a, max(CASE WHEN i = j + 1 THEN time_ms END) AS b, any_value(d) AS d FROM o JOIN q ON q.scenario = o.scenario GROUP BY o.scenario)
    SELECT o.scenario, count(*) AS n, round(sum(time_ms), 6) AS total_ms, round(avg(time_ms), 6) AS avg_ms, max(memory_mb) AS peak_mb, round(avg(cache_hit::integer), 6) AS hit_rate,
           round(count(*) / (sum(time_ms) / 1000), 6) AS tiles_per_s, round(any_value(a + (b - a) * p.d), 6) AS p95_ms FROM o JOIN p ON p.scenario = o.scenario GROUP BY o.scenario""")
def _(t):
    return _round(L.latency_report(_results(t), ["scenario"]), 6)


_AT = lambda q: f"list_sort(list(time_ms))[cast(floor({q} * (count(*) - 1)) AS bigint) + 1]"


@query("latency_quantiles", "fx_requests", f"""
    WITH {_RES} SELECT scenario, count(*) AS n, round(min(time_ms), 6) AS min, round(max(time_ms), 6) AS max, round(avg(time_ms), 6) AS avg, count_if(time_ms > 16.7) AS over_16, count_if(time_ms > 33.4) AS over_33,
        round({_AT(0.5)}, 6) AS p50, round({_AT(0.9)}, 6) AS p90, round({_AT(0.95)}, 6) AS p95 FROM r GROUP BY scenario""")
def _(t):
    return _round(L.latency_quantiles(_results(t), "time_ms", ["scenario"]), 6)


@query("latency_consistency", "fx_requests", f"""
    WITH {_RES} SELECT z, scenario, round(avg(time_ms), 6) AS avg_ms, round(min(time_ms), 6) AS min_ms, round(max(time_ms), 6) AS max_ms, round(max(time_ms) / min(time_ms), 6) AS ratio,
        max(time_ms) / min(time_ms) < 40 AS consistent FROM r WHERE error IS NULL GROUP BY z, scenario""")
def _(t):
    return _round(L.latency_consistency(_results(t), ["z", "scenario"], limit=40.0), 6)


@query("metric_delta", "fx_requests", """
    WITH n AS (SELECT event_type || '-' || (event_id * 31 % 500) AS name, event_id % 2 AS half FROM fx_requests)
    SELECT name, count_if(half = 1) - count_if(half = 0) AS delta FROM n GROUP BY name""")
def _(t):
    n = t.requests().select(F.concat_ws("-", "event_type", (C("event_id") * 31 % 500).cast("string")).alias("name"), (C("event_id") % 2).alias("half"))
    side = lambda h: n.where(C("half") == h).groupBy("name").agg(F.count("*").alias("value"))
    return L.metric_delta(side(0), side(1))


@query("catalog_zoom_summary", "", """
    SELECT c_nationkey AS nation, count(*) AS n, round(min(c_custkey % 91 / 1e1), 1) AS min_zoom, round(max(c_custkey % 91 / 1e1), 1) AS max_zoom, round(avg(c_custkey % 91 / 1e1), 6) AS avg_zoom
    FROM customer GROUP BY c_nationkey""")
def _(t):
    z = t.read("customer").select(C("c_nationkey").alias("nation"), (C("c_custkey") % 91 / 10.0).alias("zoom"))
    return z.groupBy("nation").agg(F.count("*").alias("n"), F.round(F.min("zoom"), 1).alias("min_zoom"), F.round(F.max("zoom"), 1).alias("max_zoom"),
                                   F.round(F.avg("zoom"), 6).alias("avg_zoom"))


@query("response_signature_counts", "fx_requests", """
    SELECT trim(CASE WHEN event_id % 11 = 0 THEN 404 ELSE 200 END || ' ' || CASE WHEN event_id % 3 = 0 THEN 'HIT' ELSE '' END || ' ' ||
           CASE WHEN event_id % 4 = 0 THEN 'terrain' WHEN event_id % 4 = 1 THEN 'tile' ELSE '' END || ' ' || CASE WHEN event_id % 5 = 0 THEN 'br' ELSE 'identity' END) AS signature, count(*) AS n
    FROM fx_requests GROUP BY 1""")
def _(t):
    e = C("event_id")
    r = t.requests().select(F.when(e % 11 == 0, 404).otherwise(200).alias("status"), F.when(e % 3 == 0, "HIT").alias("cache"),
                            F.when(e % 4 == 0, "terrain").alias("terrain_source"), F.when(e % 4 == 1, "tile").alias("tile_source"), F.when(e % 5 == 0, "br").alias("encoding"))
    return L.response_signature_counts(r)


@query("service_health", "fx_requests", """
    WITH h AS (SELECT z, event_type IN ('error', 'click') AND (z < 11 OR event_id % 40 <> 1) OR z = 12 AND event_id % 5 < 3 AS error, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 = 0 END AS cache_hit FROM fx_requests)
    SELECT z, count(*) AS requests, count_if(error) AS errors, round(count_if(error) / count(*), 9) AS error_rate, round(coalesce(count_if(cache_hit), 0) / greatest(count(cache_hit), 1), 9) AS hit_rate,
           round(count(*) / 3600e0, 9) AS per_second, count_if(error) / count(*) <= 0.5 AS healthy FROM h GROUP BY z""")
def _(t):
    e = C("event_id")
    bad = (C("event_type").isin("error", "click") & ((C("z") < 11) | (e % 40 != 1))) | ((C("z") == 12) & (e % 5 < 3))
    r = t.requests().select("z", bad.alias("error"), F.when(e % 7 != 0, e % 3 == 0).alias("cache_hit"))
    return _round(L.service_health(r, ["z"], 3600.0))


@query("inventory_status", "fx_archives", """
    WITH c AS (SELECT huc, count(*) * 97 AS files, min(pos) % 3 = 0 AS manifest, CASE WHEN min(pos) % 10 <> 0 THEN (min(pos) % 7) * 0.4e0 END AS gb FROM fx_archives GROUP BY huc)
    SELECT huc, CASE WHEN files < 1000 AND NOT manifest OR gb IS NULL OR gb < 1 THEN 'critical' WHEN files BETWEEN 1000 AND 1999 THEN 'degraded' ELSE 'healthy' END AS status FROM c""")
def _(t):
    c = t.archives().groupBy("huc").agg((F.count("*") * 97).alias("files"), (F.min("pos") % 3 == 0).alias("manifest"),
                                        F.when(F.min("pos") % 10 != 0, (F.min("pos") % 7) * 0.4).alias("gb"))
    return c.select("huc", L.inventory_status(C("files"), C("manifest"), C("gb")).alias("status"))
