"""Order-dependent analytics: pan velocity, rate windows, eviction, intervals, first occurrences.

Where order is needed across a whole session or table the `Ordered` helper is used, so one busy session is
spread over many tasks; where only the first or last row matters it is a `min_by` / `max_by` aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.operators.generators import PRELOAD_ZOOMS
from tilewater.operators.joins import with_row
from tilewater.operators.ordered import Ordered
from tilewater.session import cut, written

C = F.col


def micros(ts: str) -> Column:
    """Timestamp without zone -> microseconds since 1970, independent of the session time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} AS timestamp_ntz))")


def pan_velocity(requests: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Next tile of a steady pan: from the third request of a session on, same zoom, at most two tiles of movement."""
    o = Ordered(requests, [session], order).previous(["z", "x", "y"], "_p").running_total(F.lit(1), "_seq").result()
    dx, dy = C("x") - C("_p.x"), C("y") - C("_p.y")
    steady = (C("_seq") >= 3) & (C("_p.z") == C("z")) & (F.abs(dx) <= 2) & (F.abs(dy) <= 2)
    moved = o.where(steady).withColumn("next_x", C("x") + dx).withColumn("next_y", C("y") + dy)
    return moved.where(A.tile_valid(C("z"), C("next_x"), C("next_y"), *PRELOAD_ZOOMS)).drop("_p", "_seq")


# Requests per second by path prefix, first match wins.
PATH_LIMITS = (("/api/v1/tiles/flood", 30), ("/api/v1/tiles/elevation", 100), ("/api/v1/tiles/vector", 100))
DEFAULT_LIMIT = 60


def path_limit(path: Column) -> Column:
    out = F.when(path.startswith(PATH_LIMITS[0][0]), PATH_LIMITS[0][1])
    for prefix, n in PATH_LIMITS[1:]:
        out = out.when(path.startswith(prefix), n)
    return out.otherwise(DEFAULT_LIMIT)


def rate_window(requests: DataFrame, key: str, us: str, limit: Column, window_us: int = 1_000_000, blocks: int = 64) -> DataFrame:
    """Requests in the sliding window that ends at each distinct (key, time), and whether the limit allows it.

    Equal timestamps of one key count once and entries exactly one window old no longer count. Time is cut into
    blocks of `blocks` windows and the last window of a block is repeated in the next one, so the window function runs
    on (key, block) and a busy client is spread over tasks.
    """
    size = window_us * blocks
    once = requests.groupBy(key, us).agg(F.min(limit).alias("limit"))
    own = F.floor(C(us) / size)
    late = F.pmod(C(us), F.lit(size)) >= size - window_us
    copies = once.withColumn("_own", own).withColumn(
        "_block", F.explode(F.when(late, F.array(C("_own"), C("_own") + 1)).otherwise(F.array(C("_own")))))
    w = Window.partitionBy(key, "_block").orderBy(us).rangeBetween(-(window_us - 1), 0)
    return copies.withColumn("in_window", F.count("*").over(w)).where(C("_block") == C("_own")) \
        .select(key, us, "in_window", (C("in_window") <= C("limit")).alias("allowed"))


def ttl_first(events: DataFrame, keys: list[str], us: str, ttl_us: int, order: list[str]) -> DataFrame:
    """Events that a cache entry of `ttl_us` does not answer: the first of a key, then the first one more than `ttl_us` after the last kept, and so on.

    A hit does not renew the entry. Of events equal in key and time the smallest by `order` stands for all; events without a time are kept, null
    keys are equal to each other. An event more than `ttl_us` after the one before it is kept whatever went before, so a key falls apart into
    bursts. Events and the ends of their times to live are laid
    out in one order, in which an end sees the events on either side of it, and so its event's successor. The chain from the first event of a
    burst is followed by pointer doubling: rounds grow with the logarithm of the burst's length in `ttl_us`, and no burst is ever in one task.
    """
    if ttl_us < 0:
        raise ValueError("ttl_us must not be negative")
    columns, times = events.columns, F.to_json(F.struct(*keys))
    timed = events.where(C(us).isNotNull()).withColumns({"_k": times, "_us": C(us).cast("long")})
    once = written(timed.groupBy("_k", "_us").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")))
    own = once.select("_k", C("_us").alias("_at"), F.lit(0).alias("_end"))
    ends = once.select("_k", (C("_us") + ttl_us).alias("_at"), F.lit(1).alias("_end"))
    event = F.when(C("_end") == 0, C("_at"))
    laid = written(Ordered(own.unionByName(ends), ["_k"], ["_at", "_end"]).nearest(event, "_before").nearest(event, "_after", after=True).result())
    firsts = laid.where((C("_end") == 0) & F.coalesce(C("_at") - C("_before") > ttl_us, F.lit(True))).select("_k", C("_at").alias("_us"))
    jumps = laid.where((C("_end") == 1) & (C("_after") - C("_before") <= ttl_us)).select("_k", (C("_at") - ttl_us).alias("_us"), C("_after").alias("_to"))
    out = once.join(_chained(firsts, jumps), ["_k", "_us"], "left_semi").select("_row.*")
    return out.unionByName(events.where(C(us).isNull()))


def _chained(firsts: DataFrame, jumps: DataFrame) -> DataFrame:
    """_k, _us of all that the `jumps` (_k, _us, _to) reach from `firsts` (_k, _us), itself included; no two firsts reach the same.

    A round of doubling keeps the jumps from where jumps of that length end, which are the fewer the longer they are where neighbours come to have a
    successor in common; between events at even distances they never do, and each round has all of them.
    """
    levels = []
    while not jumps.isEmpty():
        levels.append(jumps)
        second = jumps.select("_k", C("_us").alias("_to"), C("_to").alias("_next"))
        twice = written(jumps.join(second, ["_k", "_to"]).select("_k", "_us", C("_next").alias("_to")))
        starts = twice.select("_k", C("_to").alias("_us")).unionByName(firsts).distinct()
        jumps = written(twice.join(starts, ["_k", "_us"], "left_semi"))
    chain = firsts
    for jumps in reversed(levels):
        chain = chain.join(jumps, ["_k", "_us"], "left").select("_k", F.explode(F.array_compact(F.array("_us", "_to"))).alias("_us"))
    return chain


def prune_oldest(files: DataFrame, max_bytes: int, order: tuple[str, str] = ("mtime", "path"), size: str = "bytes") -> DataFrame:
    """Eviction plan: oldest files go until the rest fits; adds `evict`."""
    if max_bytes < 0:
        raise ValueError("max_bytes must not be negative")
    o = Ordered(files, [], list(order)).running_total(size, "_cum").result()
    total = files.agg(F.coalesce(F.sum(size), F.lit(0)).alias("_total"))
    left_before = C("_total") - (C("_cum") - C(size))
    return with_row(o, total).withColumn("evict", left_before > max_bytes).drop("_cum", "_total")


def prune_summary(plan: DataFrame, size: str = "bytes") -> DataFrame:
    gone = F.coalesce(F.sum(F.when(C("evict"), C(size))), F.lit(0))
    return plan.agg(F.count("*").alias("before_files"), F.sum(size).alias("before_bytes"), F.count_if("evict").alias("removed_files"),
                    gone.alias("removed_bytes"), F.count_if(~C("evict")).alias("after_files"), (F.sum(size) - gone).alias("after_bytes"))


def blank_interval(samples: DataFrame, session: str, blank_at: float, visible_at: float, settle_ms: float = 150.0) -> DataFrame:
    """When the view went blank, when it came back, for how long, and the peak until then. Three small aggregates."""
    late = C("elapsed_ms") >= settle_ms
    start = samples.groupBy(session).agg(F.min(F.when(late & (C("ratio") >= blank_at), C("elapsed_ms"))).alias("start_ms"))
    s = samples.join(start, session)
    back = s.groupBy(session).agg(F.first("start_ms").alias("start_ms"), F.min(
        F.when(late & (C("elapsed_ms") > C("start_ms")) & (C("ratio") < visible_at), C("elapsed_ms"))).alias("back_ms"))
    peak = samples.join(back, session).groupBy(session).agg(
        F.first("start_ms").alias("start_ms"), F.first("back_ms").alias("back_ms"),
        F.max(F.when(C("back_ms").isNull() | (C("elapsed_ms") <= C("back_ms")), C("ratio"))).alias("peak"))
    r = lambda c: F.floor(c + 0.5)
    return peak.select(session, r(C("start_ms")).alias("blank_start_ms"), r(C("back_ms")).alias("recovered_ms"),
                       F.coalesce(r(C("back_ms") - C("start_ms")), F.lit(0)).alias("duration_ms"), C("peak").alias("peak_ratio"))


def stable_run_start(samples: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Start of the first two consecutive stable samples per session, NULL when there is none."""
    stable = samples.withColumn("_stable", ~C("moving") & C("loaded"))
    o = Ordered(stable, [session], order).following(["_stable"], "_next").result()
    return o.groupBy(session).agg(F.floor(F.min(F.when(C("_stable") & C("_next._stable"), C("elapsed_ms"))) + 0.5).alias("stable_ms"))


def first_occurrence(df: DataFrame, keys: list[str], position: str, keep: list[str]) -> DataFrame:
    """Ordered de-duplication: the row with the lowest position per key."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(position, *keep), position).alias("_r")).select(*keys, "_r.*")


def preferred_archive(archives: DataFrame) -> DataFrame:
    """Largest valid archive per unit; the first listed wins ties."""
    ok = archives.where(C("valid_name") & C("huc").isNotNull() & (C("bytes") > 0))
    best = F.max_by(F.struct("path", "bytes"), F.struct(C("bytes"), -C("pos")))
    return ok.groupBy("huc").agg(best.alias("_b")).select("huc", "_b.path", "_b.bytes")


def first_by_root(archives: DataFrame) -> DataFrame:
    """First non-empty archive per unit in root order."""
    return archives.where("valid_name AND bytes > 0").groupBy("huc").agg(F.min_by("path", "pos").alias("path"))


def stratified_sample(files: DataFrame, n: int, seed: int = 0, path: str = "path", size: str = "bytes") -> DataFrame:
    """n/3 files of each size class, topped up to n. Each pick is a distributed top-k by seeded hash."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), C(path)))
    cls = F.when(C(size) >= 20 * 1024, "large").when(C(size) >= 5 * 1024, "mid").otherwise("small")
    f = files.withColumn("size_class", cls).withColumn("_h", h)
    k = max(1, n // 3)
    picks = None
    for name in ("large", "mid", "small"):
        p = f.where(C("size_class") == name).orderBy("_h", path).limit(k)
        picks = p if picks is None else picks.unionByName(p)
    rest = f.join(picks.select(path), path, "left_anti").orderBy("_h", path).limit(n)
    first = picks.withColumn("_o", F.lit(0)).unionByName(rest.withColumn("_o", F.lit(1)))
    return first.orderBy("_o", "_h", path).limit(n).drop("_o", "_h")


def first_seen_hits(requests: DataFrame, key: str, order: str) -> DataFrame:
    """A repeat of a key is a hit (cache without bound); adds `hit`."""
    first = requests.groupBy(key).agg(F.min(order).alias("_first"))
    return requests.join(first, key).withColumn("hit", C(order) > C("_first")).drop("_first")
