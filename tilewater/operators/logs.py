"""Request-log analytics: transfer totals, funnels, latency reports, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.functions import text as X
from tilewater.operators.quantiles import quantiles

C = F.col


def with_sizes(entries: DataFrame) -> DataFrame:
    """Add host, type and bytes to log entries (url, mime, body_size, headers_size, content_size)."""
    return entries.withColumn("host", X.url_host(C("url"))).withColumn("type", X.mime_group(C("mime"))) \
        .withColumn("bytes", X.entry_size(C("body_size"), C("headers_size"), C("content_size")))


def transfer_totals(entries: DataFrame) -> DataFrame:
    """Bytes and requests by host, by type and in total, from one scan (GROUPING SETS)."""
    e = with_sizes(entries)
    return e.groupingSets([[C("host")], [C("type")], []], C("host"), C("type")).agg(
        C("host"), C("type"), F.sum("bytes").alias("bytes"), F.count("*").alias("requests")).select("host", "type", "bytes", "requests")


def transfer_by_zoom(entries: DataFrame) -> DataFrame:
    """Per kind and zoom, and per kind (zoom NULL): bytes, count, times, distinct encodings and cache headers.

    The two header columns have few distinct values (protocol constants), so the collected sets are small.
    """
    kind_z = entries.rollup("kind", "z").agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("requests"), F.sum("time_ms").alias("total_ms"), F.avg("time_ms").alias("avg_ms"),
        F.max("time_ms").alias("max_ms"), F.array_join(F.sort_array(F.collect_set("encoding")), ",").alias("encodings"),
        F.array_join(F.sort_array(F.collect_set("cache")), ",").alias("caches"))
    return kind_z.where("kind IS NOT NULL")


def event_funnel(events: DataFrame, kinds: tuple[str, ...] = ("request", "response", "finished", "failed")) -> DataFrame:
    """Counts per kind and first elapsed time in arrival order, per zoom and over all (zoom NULL)."""
    aggs = []
    for k in kinds:
        here = C("kind") == k
        aggs += [F.count_if(here).alias(f"{k}_n"), F.min_by(F.when(here, C("elapsed_ms")), F.when(here, C("seq"))).alias(f"first_{k}_ms")]
    return events.rollup("z").agg(*aggs)


def transfer_finished(events: DataFrame) -> DataFrame:
    """Finished transfers per zoom and over all (zoom NULL)."""
    done = events.where(C("kind") == "finished")
    body, head = F.coalesce("body_bytes", F.lit(0)), F.coalesce("header_bytes", F.lit(0))
    return done.rollup("z").agg(
        F.count("*").alias("n"), F.sum(body + head).alias("transfer_bytes"), F.sum(body).alias("body_bytes"),
        F.min_by("elapsed_ms", "seq").alias("first_ms"), F.max_by("elapsed_ms", "seq").alias("last_ms"))


def latency_report(results: DataFrame, keys: list[str]) -> DataFrame:
    """Average, p95 (exclusive rule), peak memory, hit rate and tiles per second of the error-free results."""
    ok = results.where(C("error").isNull())
    p95 = quantiles(ok, "time_ms", {"p95_ms": 0.95}, keys, method="exclusive")
    g = ok.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("time_ms").alias("total_ms"), F.avg("time_ms").alias("avg_ms"), F.max("memory_mb").alias("peak_mb"),
        F.avg(C("cache_hit").cast("int")).alias("hit_rate"),
        F.when(F.sum("time_ms") > 0, F.count("*") / (F.sum("time_ms") / 1000.0)).otherwise(0.0).alias("tiles_per_s"))
    return g.join(p95, keys)


def latency_quantiles(results: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Count, range, lower-index quantiles, mean, and frames over one and two 60 Hz budgets."""
    q = quantiles(results, value, {"p50": 0.5, "p90": 0.9, "p95": 0.95}, keys, method="floor")
    g = results.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"),
                                   F.count_if(C(value) > 16.7).alias("over_16"), F.count_if(C(value) > 33.4).alias("over_33"))
    return g.join(q, keys)


def latency_consistency(results: DataFrame, keys: list[str], limit: float = 3.0) -> DataFrame:
    lo, hi = F.min("time_ms"), F.max("time_ms")
    r = F.when(lo > 0, hi / lo).otherwise(float("inf"))
    return results.where(C("error").isNull()).groupBy(*keys).agg(
        F.avg("time_ms").alias("avg_ms"), lo.alias("min_ms"), hi.alias("max_ms"), r.alias("ratio"), (r < limit).alias("consistent"))


def metric_delta(before: DataFrame, after: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """after - before per counter; a missing counter counts as zero."""
    j = before.select(name, C(value).alias("_b")).join(after.select(name, C(value).alias("_a")), name, "full")
    return j.select(name, (F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))).alias("delta"))


def response_signature_counts(responses: DataFrame) -> DataFrame:
    """Frequency of the status / cache / source / encoding combination."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    source = F.coalesce(F.nullif(C("terrain_source"), F.lit("")), C("tile_source"))
    enc = F.coalesce(F.nullif(C("encoding"), F.lit("")), F.lit("identity"))
    key = F.trim(F.concat(C("status").cast("string"), F.lit(" "), blank(C("cache")), F.lit(" "), blank(source), F.lit(" "), enc))
    return responses.groupBy(key.alias("signature")).agg(F.count("*").alias("n"))


def service_health(requests: DataFrame, keys: list[str], uptime_s: float) -> DataFrame:
    """Error rate, cache hit rate, request rate and the healthy flag."""
    n, bad, hits = F.count("*"), F.count_if("error"), F.count_if("cache_hit")
    lookups = F.count("cache_hit")
    return requests.groupBy(*keys).agg(
        n.alias("requests"), bad.alias("errors"), (bad / F.greatest(n, F.lit(1))).alias("error_rate"),
        (hits / F.greatest(lookups, F.lit(1))).alias("hit_rate"), (n / F.lit(uptime_s)).alias("per_second"),
        (bad / F.greatest(n, F.lit(1)) <= 0.5).alias("healthy"))


def inventory_status(files: Column, manifest: Column, archive_gb: Column) -> Column:
    """healthy / degraded / critical from the number of source files, the manifest and the tile archive size."""
    few = (files < 1000) & ~manifest
    broken = archive_gb.isNull() | (archive_gb < 1.0)
    return F.when(few | broken, "critical").when(files.between(1000, 1999), "degraded").otherwise("healthy")


def largest_entries(entries: DataFrame, n: int = 25) -> DataFrame:
    """Top `n` entries by transferred bytes (distributed top-k, ties by URL)."""
    return with_sizes(entries).orderBy(F.desc("bytes"), "url", "page_id").limit(n)
