"""Request streams as Structured Streaming: windows, sessions, dedupe, rates, predictions, pruning.

Keyed state would put a busy session into one task, so the order-dependent operators work per micro-batch on the batch
plus a small carried table (the tail of what came before), with the same distributed code as in batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.operators import windows as W
from tilewater.operators.joins import with_row
from tilewater.operators.ordered import Ordered
from tilewater.streaming.sinks import drain_append, drain_batches

C = F.col


def event_time(ts: str) -> Column:
    """Zone-free timestamp -> instant, read as UTC whatever the session zone."""
    return F.timestamp_micros(W.micros(ts))


def viewport_counts(events: DataFrame, zoom: int, delay: str = "10 minutes") -> DataFrame:
    """Events per tile and hour. `events`: at (timestamp), lon, lat. Rows later than the watermark are dropped."""
    z = F.lit(zoom)
    e = events.withWatermark("at", delay).select("at", A.tile_x(C("lon"), z).alias("x"), A.tile_y(C("lat"), z).alias("y"))
    return e.groupBy(F.window("at", "1 hour").alias("w"), "x", "y").agg(F.count("*").alias("events")) \
        .select(F.unix_micros("w.start").alias("start_us"), "x", "y", "events")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Session per key, closed after `gap` without events."""
    e = events.withWatermark("at", delay)
    return e.groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count("*").alias("events")) \
        .select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "events")


def request_rate(events: DataFrame, key: str, width: str = "1 second", slide: str = "100 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Requests per key in overlapping windows; pre-aggregated before the shuffle, so a busy client costs one row per task and window."""
    return events.withWatermark("at", delay).groupBy(F.window("at", width, slide).alias("w"), key).agg(F.count("*").alias("requests")) \
        .select(key, F.unix_micros("w.start").alias("start_us"), "requests")


def progress_state(lines: DataFrame) -> DataFrame:
    """Latest event per unit (update or complete mode). `lines`: huc, event, ts, line."""
    return lines.groupBy("huc").agg(F.max_by("event", F.struct("ts", "line")).alias("event"), F.max("ts").alias("ts"), F.count("*").alias("events"))


def run_progress_state(lines: DataFrame) -> DataFrame:
    """Drive `progress_state` and return its last state: per unit the row of the latest batch that touched it."""
    def write(df: DataFrame, i: int, root: str) -> None:
        df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{root}/out/part={i}")

    root = drain_batches(progress_state(lines), "progress", write, mode="update")
    out = lines.sparkSession.read.parquet(f"{root}/out")
    return out.groupBy("huc").agg(F.max_by(F.struct("event", "ts", "events"), "batch").alias("s")).select("huc", "s.*")


def _carried(df: DataFrame, root: str, i: int) -> DataFrame:
    """What the previous batch left, or no rows."""
    if i == 0:
        return df.limit(0)
    return df.sparkSession.read.schema(df.schema).parquet(f"{root}/carry/{i - 1}")


def _recent(rows: DataFrame, us: str, ttl_us: int | None) -> DataFrame:
    """Rows within the time to live of the newest one; all of them without one."""
    if ttl_us is None:
        return rows
    newest = rows.agg(F.max(us).alias("_newest"))
    return rows.crossJoin(F.broadcast(newest)).where(C(us) > C("_newest") - ttl_us).drop("_newest")  # one row


def run_pan_prediction(requests: DataFrame, session: str, order: list[str], ttl_us: int | None = None, root: str | None = None, **trigger) -> DataFrame:
    """Next-tile predictions of every request, from it and its two predecessors in the session.

    Each batch is joined by the last two requests each session had before; they are written for the next batch, unless they are older than
    `ttl_us` (by the first column of `order`) when it ends. With `root` a later call goes on where this one stopped.
    """
    columns = requests.columns

    def write(df: DataFrame, i: int, root: str) -> None:
        old = _carried(df, root, i)
        both = old.withColumn("_new", F.lit(False)).unionByName(df.withColumn("_new", F.lit(True)))
        W.pan_velocity(both, session, order).where("_new").drop("_new").write.mode("overwrite").parquet(f"{root}/out/part={i}")
        # last two per session with two pre-aggregated maxima instead of a sort
        pos, row = F.struct(*order), F.struct(*columns)
        last = both.groupBy(session).agg(F.max(pos).alias("_p"), F.max_by(row, pos).alias("_r"))
        older = both.join(last.select(session, "_p"), session).where(F.struct(*order) < C("_p")) \
            .groupBy(session).agg(F.max_by(row, pos).alias("_r"))
        _recent(last.select("_r.*").unionByName(older.select("_r.*")), order[0], ttl_us).write.mode("overwrite").parquet(f"{root}/carry/{i}")

    root = drain_batches(requests, "pan", write, root=root, **trigger)
    return requests.sparkSession.read.parquet(f"{root}/out").drop("part")


def run_rate_log(requests: DataFrame, key: str, us: str, limit: int, window_us: int = 1_000_000, ttl_us: int | None = None, root: str | None = None,
                 **trigger) -> DataFrame:
    """Exact sliding request log; the last window of each key is carried into the next batch, unless it is older than `ttl_us`.

    With `root` a later call goes on where this one stopped.
    """
    def write(df: DataFrame, i: int, root: str) -> None:
        old = _carried(df, root, i)
        both = old.unionByName(df)
        seen = W.rate_window(both, key, us, F.lit(limit), window_us)
        fresh = seen.join(df.select(key, us).distinct(), [key, us], "left_semi")
        fresh.write.mode("overwrite").parquet(f"{root}/out/part={i}")
        newest = both.groupBy(key).agg(F.max(us).alias("_top"))
        last = both.join(newest, key).where(C(us) > C("_top") - window_us).drop("_top")
        _recent(last, us, ttl_us).write.mode("overwrite").parquet(f"{root}/carry/{i}")

    root = drain_batches(requests, "rate", write, root=root, **trigger)
    return requests.sparkSession.read.parquet(f"{root}/out").drop("part")


def run_ttl_dedupe(events: DataFrame, keys: list[str], us: str, ttl_us: int, order: list[str], late_us: int | None = None, root: str | None = None,
                   **trigger) -> DataFrame:
    """Drop repeats of a key inside the time to live of the last event kept, by event time (`windows.ttl_first` on each batch).

    The last kept time of each key is carried; rows of a later batch at or before its end are repeats. An entry is forgotten when it
    ended more than `late_us` (one time to live if not given) before the newest event, so rows later than that may be kept again. With `root` a later call
    goes on where this one stopped.
    """
    columns, key = events.columns, F.to_json(F.struct(*keys))
    keep_us = ttl_us + (ttl_us if late_us is None else late_us) + 1

    def write(df: DataFrame, i: int, root: str) -> None:
        rows = df.select(*columns, key.alias("_k"))
        old = _carried(rows.select("_k", C(us).cast("long").alias("_last")), root, i)
        fresh = rows.join(old, "_k", "left").where(C("_last").isNull() | C(us).isNull() | (C(us) > C("_last") + ttl_us))
        path = f"{root}/out/part={i}"
        W.ttl_first(fresh.select(*columns), keys, us, ttl_us, order).write.mode("overwrite").parquet(path)
        kept = df.sparkSession.read.schema(df.schema).parquet(path).where(C(us).isNotNull()).select(key.alias("_k"), C(us).cast("long").alias("_last"))
        last = old.unionByName(kept).groupBy("_k").agg(F.max("_last").alias("_last"))
        newest = df.select(C(us).cast("long").alias("_last")).unionByName(old.select("_last")).agg((F.max("_last") - keep_us).alias("_edge"))
        with_row(last, newest).where(C("_last") > C("_edge")).drop("_edge").write.mode("overwrite").parquet(f"{root}/carry/{i}")

    root = drain_batches(events, "dedupe", write, root=root, **trigger)
    return events.sparkSession.read.schema(events.schema).parquet(f"{root}/out").select(*columns)


_NO_TIME = -(1 << 62)  # age bucket of rows without a time: older than all others


def run_budget_prune(files: DataFrame, max_bytes: int, width: float = 3600, root: str | None = None, **trigger) -> DataFrame:
    """Eviction plan over the whole inventory (mtime, path, bytes and other columns) after the last batch: oldest files go until the rest fits.

    Files only arrive, so a file that is out stays out and the plan is one edge in (mtime, path) order. The state is that edge and the bytes
    per age bucket of `width` units of mtime, without the buckets behind the edge. A batch writes its own rows by bucket, adds up its
    totals and reads again only the bucket in which the edge lies; rows that arrive behind the edge are put aside at once. So its cost is its own
    rows, one bucket and a total per bucket within the budget, however long the stream has run.

    Rows equal in (mtime, path) stay or go together. Rows without mtime are the oldest, without path the oldest of their time; without bytes
    they weigh nothing. A processing-time trigger spaces the runs. With `root` a later call goes on where this one stopped.
    """
    if max_bytes < 0:
        raise ValueError("max_bytes must not be negative")
    age, weight = F.struct("mtime", "path"), F.coalesce("bytes", F.lit(0)).cast("long")
    bucket = F.coalesce(F.floor(C("mtime") / width).cast("long"), F.lit(_NO_TIME))
    columns = files.columns
    edge_type = files.select(age.alias("_edge")).schema

    def read(root: str, path: str, schema) -> DataFrame:
        return files.sparkSession.read.schema(schema).parquet(f"{root}/{path}")

    def write(df: DataFrame, i: int, root: str) -> None:
        spark = df.sparkSession
        before = read(root, f"edge/part={i - 1}", edge_type) if i else spark.range(1).select(F.lit(None).cast(edge_type[0].dataType).alias("_edge"))
        arrived = with_row(df, before).withColumn("_out", F.coalesce(age <= C("_edge"), F.lit(False)))
        arrived.where("_out").select(*columns).write.mode("overwrite").parquet(f"{root}/aside/part={i}")
        fresh = arrived.where("NOT _out").select(*columns, bucket.alias("_bucket"), F.lit(i).alias("_part"))
        fresh.hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("_bucket", "_part").parquet(f"{root}/inventory")
        added = fresh.groupBy("_bucket").agg(F.sum(weight).alias("_bytes"))
        totals = _carried(added, root, i).unionByName(added).groupBy("_bucket").agg(F.sum("_bytes").alias("_bytes"))
        newest = Ordered(totals.withColumn("_rank", -C("_bucket")), [], ["_rank"]).running_total("_bytes", "_upto").result()
        over = newest.where(C("_upto") > max_bytes).agg(F.max_by(F.struct("_bucket", (C("_upto") - C("_bytes")).alias("_newer")), "_bucket").alias("_b"))
        at = over.first()["_b"]  # one row: the bucket of the edge and the bytes newer than it
        edge = before
        if at is not None:
            newest = newest.where(C("_bucket") >= at["_bucket"])
            own = read(root, f"inventory/_bucket={at['_bucket']}", df.schema)
            keys = own.groupBy("mtime", "path").agg(F.sum(weight).alias("_bytes"))
            inside = Ordered(keys, [], ["mtime", "path"]).running_total("_bytes", "_upto").result()
            whole = inside.agg(F.sum("_bytes").alias("_whole"))
            left = C("_whole") - (C("_upto") - C("_bytes")) + at["_newer"]
            edge = with_row(inside, whole).where(left > max_bytes).agg(F.max(age).alias("_edge"))
        newest.select("_bucket", "_bytes").write.mode("overwrite").parquet(f"{root}/carry/{i}")
        edge.write.mode("overwrite").parquet(f"{root}/edge/part={i}")

    root = drain_batches(files, "prune", write, root=root, **trigger)
    last = read(root, "edge", files.select(age.alias("_edge"), F.lit(0).cast("long").alias("part")).schema).agg(F.max_by("_edge", "part").alias("_edge"))
    rows = read(root, "inventory", files.schema).select(*columns).unionByName(read(root, "aside", files.schema).select(*columns))
    return with_row(rows, last).withColumn("evict", F.coalesce(age <= C("_edge"), F.lit(False))).drop("_edge")


def run_append(stream: DataFrame, name: str) -> DataFrame:
    return drain_append(stream, name)
