"""Queries for order-dependent analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewater.functions import values as V
from tilewater.operators import generators as G
from tilewater.operators import windows as W
from tilewater.plans.registry import query

C = F.col

_PAN = "p AS (SELECT event_id, user_id, ts, cast(10 + user_id % 3 AS integer) AS z, cast(400 + event_id * 7 % 5 AS integer) AS x, cast(300 + event_id % 4 AS integer) AS y FROM events)"


def _pan(t):
    e = C("event_id")
    return t.read("events").select("event_id", "user_id", "ts", (F.lit(10) + C("user_id") % 3).cast("int").alias("z"),
                                   (F.lit(400) + e * 7 % 5).cast("int").alias("x"), (F.lit(300) + e % 4).cast("int").alias("y"))


@query("pan_velocity", "", f"""
    WITH {_PAN}, l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, z, x + x - px AS next_x, y + y - py AS next_y FROM l WHERE n >= 3 AND z = pz AND abs(x - px) <= 2 AND abs(y - py) <= 2""")
def _(t):
    return W.pan_velocity(_pan(t), "user_id", ["ts", "event_id"]).select("event_id", "z", "next_x", "next_y")


_WIN = 1_800_000_000


@query("rate_window", "", f"""
    WITH o AS (SELECT DISTINCT user_id, epoch_us(ts) AS us FROM events)
    SELECT user_id, us, count(*) OVER w AS in_window, count(*) OVER w <= 2 AS allowed FROM o
    WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {_WIN - 1} PRECEDING AND CURRENT ROW)""")
def _(t):
    r = t.read("events").select("user_id", W.micros("ts").alias("us"))
    return W.rate_window(r, "user_id", "us", F.lit(2), window_us=_WIN)


@query("path_limit", "", """
    SELECT event_id, CASE WHEN event_type = 'view' THEN 30 WHEN event_type = 'click' THEN 100 WHEN event_type = 'error' THEN 100 ELSE 60 END AS per_second FROM events""")
def _(t):
    ty = C("event_type")
    p = F.when(ty == "view", "/api/v1/tiles/flood/9/1/2.png").when(ty == "click", "/api/v1/tiles/elevation-data/9/1/2.u16") \
        .when(ty == "error", "/api/v1/tiles/vector/usa/9/1/2.pbf").otherwise("/risk/location")
    return t.read("events").select("event_id", W.path_limit(p).alias("per_second"))


_FILES = "fl AS (SELECT pos * 7919 % 300 AS mtime, path, bytes FROM fx_archives)"
_BUDGET = 300_000_000
_PLAN = f"pl AS (SELECT *, sum(bytes) OVER () - (sum(bytes) OVER (ORDER BY mtime, path) - bytes) > {_BUDGET} AS evict FROM fl)"


def _plan(t):
    return W.prune_oldest(t.archives().select((C("pos") * 7919 % 300).alias("mtime"), "path", "bytes"), _BUDGET)


@query("prune_oldest", "fx_archives", f"WITH {_FILES}, {_PLAN} SELECT mtime, path, bytes, evict FROM pl")
def _(t):
    return _plan(t)


@query("prune_summary", "fx_archives", f"""
    WITH {_FILES}, {_PLAN} SELECT count(*) AS before_files, cast(sum(bytes) AS bigint) AS before_bytes, count_if(evict) AS removed_files,
        cast(coalesce(sum(bytes) FILTER (evict), 0) AS bigint) AS removed_bytes, count_if(NOT evict) AS after_files,
        cast(sum(bytes) - coalesce(sum(bytes) FILTER (evict), 0) AS bigint) AS after_bytes FROM pl""")
def _(t):
    return W.prune_summary(_plan(t))


_SAM = """sa AS (SELECT user_id, event_id * 3.3e0 AS elapsed_ms, (event_id * 7919 % 1000) / 1e3 AS ratio, event_id % 3 = 0 AS moving, event_id % 5 <> 0 AS loaded FROM events)"""


def _samples(t):
    e = C("event_id")
    return t.read("events").select("user_id", "event_id", (e * 3.3).alias("elapsed_ms"), ((e * 7919 % 1000) / 1000.0).alias("ratio"),
                                   (e % 3 == 0).alias("moving"), (e % 5 != 0).alias("loaded"))


@query("blank_interval", "", f"""
    WITH {_SAM}, a AS (SELECT user_id, min(elapsed_ms) FILTER (elapsed_ms >= 150 AND ratio >= 0.7) AS s FROM sa GROUP BY user_id),
    b AS (SELECT sa.user_id, any_value(s) AS s, min(elapsed_ms) FILTER (elapsed_ms >= 150 AND elapsed_ms > s AND ratio < 0.2) AS r FROM sa JOIN a ON a.user_id = sa.user_id GROUP BY sa.user_id)
    SELECT sa.user_id, cast(any_value(floor(s + 0.5e0)) AS bigint) AS blank_start_ms, cast(any_value(floor(r + 0.5e0)) AS bigint) AS recovered_ms,
           cast(coalesce(any_value(floor(r - s + 0.5e0)), 0) AS bigint) AS duration_ms, max(ratio) FILTER (r IS NULL OR elapsed_ms <= r) AS peak_ratio
    FROM sa JOIN b ON b.user_id = sa.user_id GROUP BY sa.user_id""")
def _(t):
    return W.blank_interval(_samples(t), "user_id", 0.7, 0.2)


@query("stable_run_start", "", f"""
    WITH {_SAM}, l AS (SELECT user_id, elapsed_ms, NOT moving AND loaded AS st, lead(NOT moving AND loaded) OVER (PARTITION BY user_id ORDER BY elapsed_ms) AS nx FROM sa)
    SELECT user_id, cast(floor(min(elapsed_ms) FILTER (st AND nx) + 0.5e0) AS bigint) AS stable_ms FROM l GROUP BY user_id""")
def _(t):
    return W.stable_run_start(_samples(t), "user_id", ["elapsed_ms", "event_id"])


@query("first_occurrence", "fx_requests", """
    SELECT z, x, y, min(event_id) AS event_id, arg_min(user_id, event_id) AS user_id FROM fx_requests GROUP BY z, x, y""")
def _(t):
    return W.first_occurrence(t.requests(), ["z", "x", "y"], "event_id", ["user_id"])


@query("preferred_archive", "fx_archives", """
    SELECT huc, path, bytes FROM (SELECT *, row_number() OVER (PARTITION BY huc ORDER BY bytes DESC, pos) AS rn FROM fx_archives WHERE valid_name AND bytes > 0) WHERE rn = 1""")
def _(t):
    return W.preferred_archive(t.archives())


@query("first_by_root", "fx_archives", "SELECT huc, arg_min(path, pos) AS path FROM fx_archives WHERE valid_name AND bytes > 0 GROUP BY huc")
def _(t):
    return W.first_by_root(t.archives())


@query("stratified_sample", "fx_archives", """
    WITH f AS (SELECT path, bytes % 40000 AS bytes, CASE WHEN bytes % 40000 >= 20480 THEN 'large' WHEN bytes % 40000 >= 5120 THEN 'mid' ELSE 'small' END AS size_class,
                      md5('7:' || path) AS h FROM fx_archives),
    k AS (SELECT *, row_number() OVER (PARTITION BY size_class ORDER BY h, path) AS rn FROM f),
    o AS (SELECT *, row_number() OVER (ORDER BY rn > 30, h, path) AS n FROM k)
    SELECT path, bytes, size_class FROM o WHERE n <= 90""")
def _(t):
    return W.stratified_sample(t.archives().select("path", (C("bytes") % 40000).alias("bytes")), 90, seed=7)


@query("first_seen_hits", "fx_requests", """
    WITH k AS (SELECT event_id, printf('%.2f', round_even(water_level_m * 10, 0) / 10) || ':' || z || ':' || (x % 40) || ':' || (y % 9) AS k FROM fx_requests)
    SELECT event_id, row_number() OVER (PARTITION BY k ORDER BY event_id) > 1 AS hit FROM k""")
def _(t):
    k = V.water_level_key(C("water_level_m"), C("z"), C("x") % 40, C("y") % 9)
    return W.first_seen_hits(t.requests().select("event_id", k.alias("k")), "k", "event_id").select("event_id", "hit")
