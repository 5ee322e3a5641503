"""Streaming queries over the event table; the twin SQL is the batch form of the same question."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewater.operators import windows as W
from tilewater.plans import sqltext as S
from tilewater.plans.planning_queries import _progress_lines
from tilewater.plans.registry import query
from tilewater.sources import documents as D
from tilewater.sources.tables import Tables
from tilewater.streaming import operators as O
from tilewater.streaming.sinks import drain_append

C = F.col


class StreamTables(Tables):
    """The same views, read as streams: every table is a file source over its parquet file(s)."""

    def read(self, name: str):
        schema = Tables.read(self, name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.path}/{name}.parque[t]")  # a pattern that fits this table alone


def _stream(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.path)


def _timed(t):
    return _stream(t).points().withColumn("at", O.event_time("ts"))


# a window is out once the watermark (newest event minus the delay) has passed its end
_WM = "(SELECT max(epoch_us(ts)) - 600000000 FROM events)"


@query("stream_viewport_counts", "fx_points", f"""
    WITH h AS (SELECT cast(floor(epoch_us(ts) / 3600000000) AS bigint) * 3600000000 AS start_us, {S.tx('lon', '7')} AS x, {S.ty('lat', '7')} AS y FROM fx_points)
    SELECT start_us, x, y, count(*) AS events FROM h WHERE start_us + 3600000000 <= {_WM} GROUP BY start_us, x, y""")
def _(t):
    return drain_append(O.viewport_counts(_timed(t), 7), "viewport")


@query("stream_sessions", "", f"""
    WITH e AS (SELECT user_id, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events),
    n AS (SELECT *, sum(CASE WHEN prev IS NULL OR us - prev >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS s FROM e)
    SELECT user_id, min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS events FROM n GROUP BY user_id, s HAVING max(us) + 1800000000 <= {_WM}""")
def _(t):
    return drain_append(O.sessions(_timed(t).select("user_id", "at"), "user_id"), "sessions")


@query("stream_request_rate", "", """
    WITH e AS (SELECT user_id, epoch_us(ts) AS us FROM events), k AS (SELECT user_id, cast(floor(us / 600000000) AS bigint) * 600000000 - i * 600000000 AS start_us
        FROM e, range(0, 6) AS r(i)), m AS (SELECT max(us) - 10000000 AS wm FROM e)
    SELECT user_id, start_us, count(*) AS requests FROM k, m WHERE start_us + 3600000000 <= wm GROUP BY user_id, start_us""")
def _(t):
    # the table has minutes, not milliseconds, between requests: one-hour windows every ten minutes
    return drain_append(O.request_rate(_timed(t).select("user_id", "at"), "user_id", "1 hour", "10 minutes"), "rate")


_WIN = 1_800_000_000


@query("stream_rate_log", "", f"""
    WITH o AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events)
    SELECT user_id, us, count(*) OVER w AS in_window, count(*) OVER w <= 2 AS allowed FROM o
    WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {_WIN - 1} PRECEDING AND CURRENT ROW)""")
def _(t):
    r = _stream(t).read("events").select("user_id", W.micros("ts").alias("us"))
    return O.run_rate_log(r, "user_id", "us", 2, _WIN)


@query("stream_pan_prediction", "", """
    WITH p AS (SELECT event_id, user_id, epoch_us(ts) AS us, cast(10 + user_id % 3 AS integer) AS z, cast(400 + event_id * 7 % 5 AS integer) AS x, cast(300 + event_id % 4 AS integer) AS y FROM events),
    l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
    SELECT event_id, z, x + x - px AS next_x, y + y - py AS next_y FROM l WHERE n >= 3 AND z = pz AND abs(x - px) <= 2 AND abs(y - py) <= 2""")
def _(t):
    e = C("event_id")
    r = _stream(t).read("events").select(
        "event_id", "user_id", W.micros("ts").alias("us"), (F.lit(10) + C("user_id") % 3).cast("int").alias("z"),
        (F.lit(400) + e * 7 % 5).cast("int").alias("x"), (F.lit(300) + e % 4).cast("int").alias("y"))
    return O.run_pan_prediction(r, "user_id", ["us", "event_id"], ttl_us=86_400_000_000).select("event_id", "z", "next_x", "next_y")


@query("stream_ttl_dedupe", "", """
    WITH RECURSIVE o AS (SELECT user_id, event_type, epoch_us(ts) AS us, min(event_id) AS event_id FROM events GROUP BY ALL),
    n AS (SELECT user_id, event_type, us, min(us) OVER (PARTITION BY user_id, event_type ORDER BY us RANGE BETWEEN 3600000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_us FROM o),
    k AS (SELECT user_id, event_type, min(us) AS us FROM o GROUP BY ALL
          UNION ALL SELECT n.user_id, n.event_type, n.next_us FROM k JOIN n ON n.user_id = k.user_id AND n.event_type = k.event_type AND n.us = k.us WHERE n.next_us IS NOT NULL)
    SELECT event_id, user_id, event_type FROM k JOIN o USING (user_id, event_type, us)""")
def _(t):
    e = _stream(t).read("events").select("event_id", "user_id", "event_type", W.micros("ts").alias("us"))
    return O.run_ttl_dedupe(e, ["user_id", "event_type"], "us", 3_600_000_000, ["event_id"]).select("event_id", "user_id", "event_type")


@query("stream_ttl_dedupe_busy", "", """
    WITH RECURSIVE o AS (SELECT event_type, epoch_us(ts) AS us, min(event_id) AS event_id FROM events GROUP BY ALL),
    n AS (SELECT event_type, us, min(us) OVER (PARTITION BY event_type ORDER BY us RANGE BETWEEN 21600000001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_us FROM o),
    k AS (SELECT event_type, min(us) AS us FROM o GROUP BY ALL
          UNION ALL SELECT n.event_type, n.next_us FROM k JOIN n ON n.event_type = k.event_type AND n.us = k.us WHERE n.next_us IS NOT NULL)
    SELECT event_id, event_type FROM k JOIN o USING (event_type, us)""")
def _(t):
    # few keys with long bursts: the chains are followed by doubling
    e = _stream(t).read("events").select("event_id", "event_type", W.micros("ts").alias("us"))
    return O.run_ttl_dedupe(e, ["event_type"], "us", 21_600_000_000, ["event_id"]).select("event_id", "event_type")


@query("stream_progress_state", "", """
    WITH p AS (SELECT event_id AS line, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, CASE event_type WHEN 'view' THEN 'start' WHEN 'error' THEN 'failed' ELSE 'completed' END AS event,
                      lpad(cast(10000 + user_id % 97 AS varchar), 6, '0') AS huc FROM events WHERE event_id % 13 <> 0),
         r AS (SELECT *, row_number() OVER (PARTITION BY huc ORDER BY ts DESC, line DESC) AS rn, count(*) OVER (PARTITION BY huc) AS n FROM p)
    SELECT huc, event, ts, n AS events FROM r WHERE rn = 1""")
def _(t):
    return O.run_progress_state(D.parse_progress(_progress_lines(_stream(t)), "text"))


@query("stream_budget_prune", "fx_archives", """
    WITH fl AS (SELECT pos * 7919 % 300 AS mtime, path, bytes FROM fx_archives)
    SELECT mtime, path, bytes, sum(bytes) OVER () - (sum(bytes) OVER (ORDER BY mtime, path) - bytes) > 300000000 AS evict FROM fl""")
def _(t):
    f = _stream(t).archives().select((C("pos") * 7919 % 300).alias("mtime"), "path", "bytes")
    return O.run_budget_prune(f, 300_000_000, 20)
