"""Streams that stop after a batch and go on later give what one run gives."""

import random

from pyspark.sql import functions as F

from tilewater.operators import windows as W
from tilewater.streaming import operators as O


def _requests(spark, low, high):
    i = F.col("id")
    return spark.range(low, high, numPartitions=1).select(
        (i % 5).alias("user_id"), (i * 400_000).alias("us"), i.alias("event_id"), F.lit(10).alias("z"), (F.lit(400) + i * 7 % 5).cast("int").alias("x"),
        (F.lit(300) + i % 4).cast("int").alias("y"))


def _twice(spark, folder, run):
    """`run(stream, root)` over two files at once, and over one and then both with a stop between."""
    _requests(spark, 0, 60).write.mode("append").parquet(f"{folder}/in")
    read = lambda: spark.readStream.schema(_requests(spark, 0, 1).schema).parquet(f"{folder}/in")
    run(read(), f"{folder}/root")
    _requests(spark, 60, 120).write.mode("append").parquet(f"{folder}/in")
    return sorted(run(read(), f"{folder}/root").collect()), sorted(run(read(), f"{folder}/fresh").collect())


def test_predictions_go_on_after_a_stop(spark, tmp_path):
    parts, whole = _twice(spark, str(tmp_path), lambda s, root: O.run_pan_prediction(s, "user_id", ["us", "event_id"], root=root))
    assert parts == whole and parts


def test_rate_log_goes_on_after_a_stop(spark, tmp_path):
    run = lambda s, root: O.run_rate_log(s.select("user_id", "us"), "user_id", "us", 2, 9_000_000, ttl_us=60_000_000, root=root)
    parts, whole = _twice(spark, str(tmp_path), run)
    assert parts == whole and {r.allowed for r in parts} == {True, False}


def test_carried_rows_expire(spark, tmp_path):
    run = lambda s, root: O.run_pan_prediction(s, "user_id", ["us", "event_id"], ttl_us=1_000_000, root=root)
    _twice(spark, str(tmp_path), run)
    assert spark.read.parquet(f"{tmp_path}/fresh/carry/0").where(F.col("us") <= 119 * 400_000 - 1_000_000).isEmpty()


def test_plan_goes_on_after_a_stop(spark, tmp_path):
    files = lambda s: s.select(F.col("us").alias("mtime"), F.col("event_id").cast("string").alias("path"), (F.col("event_id") * 10).alias("bytes"))
    parts, whole = _twice(spark, str(tmp_path), lambda s, root: O.run_budget_prune(files(s), 30_000, 2_000_000, root=root))
    assert parts == whole and len(parts) == 120


def test_plan_of_many_batches(spark, tmp_path):
    """Late, repeated and incomplete rows; a batch carries the buckets within the budget only."""
    rnd, schema, rows = random.Random(8), "mtime long, path string, bytes long", []
    for i in range(6):
        part = [(rnd.randrange(i * 50, i * 50 + 90), f"f{i}-{k}", rnd.randrange(0, 40)) for k in range(80)]
        part += [(3, f"late{i}", 5), (None, f"n{i}", 1), (i * 50, None, 2), (i * 50 + 70, f"w{i}", None), (i * 50 + 40, "twin", 9)]
        rows += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    rows += [(290, "twin", 9)]
    spark.createDataFrame(rows[-1:], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = O.run_budget_prune(stream, 2_000, 10, root=f"{tmp_path}/root").collect()
    key = lambda r: (-1 if r[0] is None else r[0], r[1] or "")
    want = [(*r, sum(q[2] or 0 for q in rows if key(q) >= key(r)) > 2_000) for r in rows]
    order = lambda r: (key(r), -1 if r[2] is None else r[2])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert {r.evict for r in got} == {True, False}
    carried = [spark.read.parquet(f"{tmp_path}/root/carry/{i}").count() for i in range(7)]
    assert max(carried[2:]) < 14 and spark.read.parquet(f"{tmp_path}/root/inventory").select("_bucket").distinct().count() > 25
    assert spark.read.parquet(f"{tmp_path}/root/aside").count() > 0


def _chain(rows, ttl):
    """What a cache of `ttl` lets through, by its definition: key -> times of the entries."""
    kept = {}
    for key, us, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        mine = kept.setdefault(key, [])
        if not mine or us - mine[-1] > ttl:
            mine.append(us)
    return kept


def test_ttl_dedupe_is_what_a_cache_does(spark):
    """A busy key whose gaps never reach the time to live, a sparse one, ties, null keys and rows without a time."""
    rnd = random.Random(5)
    rows = [("busy", i * 7 + rnd.randrange(7), i) for i in range(900)] + [("sparse", i * 1000, i) for i in range(20)]
    rows += [(None, rnd.randrange(3000), i) for i in range(200)] + [("edge", 0, 1), ("edge", 100, 2), ("edge", 101, 3), ("edge", 101, 0), ("edge", 202, 4)]
    rows += [("busy", None, -1), (None, None, -2)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, us long, id long").repartition(5)
    got = W.ttl_first(df, ["k"], "us", 100, ["id"]).collect()
    want = {(k, us, min(i for q, t, i in rows if (q, t) == (k, us))) for k, times in _chain(rows, 100).items() for us in times}
    assert {tuple(r) for r in got} == want | {("busy", None, -1), (None, None, -2)} and len(got) == len(want) + 2
    assert sorted(r.us for r in got if r.k == "edge") == [0, 101, 202]
    assert W.ttl_first(df.limit(0), ["k"], "us", 100, ["id"]).isEmpty()


def test_ttl_dedupe_goes_on_after_a_stop(spark, tmp_path):
    run = lambda s, root: O.run_ttl_dedupe(s.select("user_id", "us", "event_id"), ["user_id"], "us", 5_000_000, ["event_id"], root=root)
    parts, whole = _twice(spark, str(tmp_path), run)
    assert parts == whole and 5 < len(parts) < 120
    assert sorted(r.us for r in parts if r.user_id == 0) == _chain([(0, i * 400_000, i) for i in range(0, 120, 5)], 5_000_000)[0]


def test_ttl_entries_are_forgotten(spark, tmp_path):
    run = lambda s, root: O.run_ttl_dedupe(s.select(F.col("event_id").alias("k"), "us"), ["k"], "us", 1_000_000, ["k"], late_us=0, root=root)
    _twice(spark, str(tmp_path), run)
    assert spark.read.parquet(f"{tmp_path}/fresh/carry/0").count() < 6


def test_rounds_of_the_chain_get_smaller(spark, monkeypatch):
    """Doubling keeps the jumps that longer ones end at; it was all events a round."""
    rnd = random.Random(8)
    rows = [(k, us, i) for i, (k, us) in enumerate((k, us) for k in "ab" for us in rnd.sample(range(20_000), 2500))]
    df, sizes, plain = spark.createDataFrame(rows, "k string, us long, id long"), [], W.written

    def counted(d):
        out = plain(d)
        if "_to" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(W, "written", counted)
    got = W.ttl_first(df, ["k"], "us", 100, ["id"]).collect()
    assert sorted((r.k, r.us) for r in got) == sorted((k, us) for k, own in _chain(rows, 100).items() for us in own)
    assert sizes[5] < len(rows) / 4 and sum(sizes) < 3 * len(rows), sizes
