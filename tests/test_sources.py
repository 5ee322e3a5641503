"""File readers, sinks, batches, mosaics and multi-batch streams on small files."""

import gzip
import json
import struct
import tempfile
import zipfile
from pathlib import Path

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tilewater.operators import mosaic as M
from tilewater.operators import planning as P
from tilewater.sources import documents as D
from tilewater.sources import tiles as T
from tilewater.streaming import operators as O


@pytest.fixture()
def folder():
    return Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def test_dem_folder(spark, folder):
    a = np.array([[1, -32767, 3], [-32768, 5, 6]], dtype="<i2")
    bounds = {"left": -81.0, "bottom": 25.0, "right": -80.0, "top": 26.0}
    for name, meta in (("n25_w081_1arc_v3", {"shape": [2, 3], "bounds": bounds}), ("n26_w081_1arc_v3", {"height": 2, "width": 3, "bounds": bounds}),
                       ("n27_w081_1arc_v3", {"shape": [9, 9], "bounds": bounds})):
        (folder / f"{name}.zst").write_bytes(zstandard.compress(a.tobytes()))
        (folder / f"{name}.json").write_text(json.dumps(meta, indent=1))
    got = {r.tile_id: r for r in T.read_dem_tiles(spark, str(folder)).collect()}
    assert got["n25_w081_1arc_v3"]["values"] == got["n26_w081_1arc_v3"]["values"] == [1, None, 3, None, 5, 6]
    assert got["n27_w081_1arc_v3"].ok is False and got["n25_w081_1arc_v3"].bounds.top == 26.0


def test_hgt_folder(spark, folder):
    a = np.arange(9, dtype=">i2").reshape(3, 3).copy()
    a[0, 0] = -32768
    (folder / "N33W080.hgt.gz").write_bytes(gzip.compress(a.tobytes()))
    (folder / "N34W080.hgt.gz").write_bytes(b"broken")
    got = {r.name: r for r in T.read_hgt(spark, str(folder), side=3).collect()}
    assert np.frombuffer(got["N33W080"].data, "<i2").tolist() == [-32768, 1, 2, 3, 4, 5, 6, 7, 8]
    assert (got["N33W080"].ok, got["N34W080"].ok, got["N34W080"].data) == (True, False, None)
    cells = T.raster_cells(T.read_hgt(spark, str(folder), side=3), ["name"], 3).collect()
    assert len(cells) == 9 and {(r.row, r.col, r.v) for r in cells} >= {(0, 0, None), (0, 1, 1), (2, 2, 8)}
    assert T.raster_cells(T.read_hgt(spark, str(folder), side=3), ["name"], 3, nodata=False).count() == 8
    r = T.read_hgt(spark, str(folder), side=3, as_bytes=False).where("ok").first()
    assert r["values"][:3] == [None, 1, 2] and r.left == pytest.approx(-80 - 1 / 7200) and r.top == pytest.approx(34 + 1 / 7200)


def test_tile_dir_prefers_raw(spark, folder):
    raw, other = np.arange(4, dtype="<u2"), np.array([9, 9, 9, 65535], dtype="<u2")
    d = folder / "9" / "80"
    d.mkdir(parents=True)
    (d / "176.u16").write_bytes(raw.tobytes())
    (d / "176.u16.gz").write_bytes(gzip.compress(other.tobytes()))
    (d / "177.u16.gz").write_bytes(gzip.compress(other.tobytes()))
    (d / "178.u16").write_bytes(b"short")
    (d / "179.u16.gz").write_bytes(gzip.compress(other.tobytes())[:-9])
    (d / "180.u16").write_bytes(b"\xff" * 8)
    (d / "notes.txt").write_text("x")
    got = {r.y: (r.variant, r["values"]) for r in T.read_tile_dir(spark, str(folder), size=4).collect()}
    assert got == {176: ("u16", [0, 1, 2, 3]), 177: ("u16.gz", [9, 9, 9, None]), 178: ("u16", None), 179: ("u16.gz", None), 180: ("u16", [None] * 4)}
    status = {r.y: r.status for r in T.read_tile_dir(spark, str(folder), size=4).collect()}
    assert status == {176: "ok", 177: "ok", 178: "corrupt", 179: "corrupt", 180: "ok"}


def test_batch_bytes(spark):
    a, b = b"\x01\x00" * 2, b"\xff\xff" * 2
    d = spark.createDataFrame([(1, 1, 12, 70000, 5, bytearray(b)), (1, 0, 9, 80, 176, bytearray(a))], "batch int, pos int, z int, x int, y int, content binary")
    p = bytes(T.pack_tile_batch(d, "batch", "FMT2", tile_bytes=4).first().payload)
    assert p == b"FMT2" + struct.pack("<BH", 1, 2) + struct.pack("<BII", 9, 80, 176) + struct.pack("<BII", 12, 70000, 5) + a + b
    back = T.unpack_tile_batch(T.pack_tile_batch(d, "batch", "FMT2", tile_bytes=4), "batch", tile_bytes=4).orderBy("pos").collect()
    assert [(r.z, r.x, r.y, bytes(r.content)) for r in back] == [(9, 80, 176, a), (12, 70000, 5, b)]
    bad = spark.createDataFrame([(1, bytearray(p[:-1])), (2, bytearray(b"NOPE" + p[4:]))], "batch int, payload binary")
    assert T.unpack_tile_batch(bad, "batch", tile_bytes=4).count() == 0


def test_batch_limits(spark):
    many = spark.range(25).select(F.lit(1).alias("batch"), F.col("id").cast("int").alias("pos"), F.lit(9).alias("z"), F.lit(1).alias("x"), F.lit(1).alias("y"), F.lit(b"ab").alias("content"))
    with pytest.raises(Exception, match="batch cannot exceed"):
        T.pack_tile_batch(many, "batch", tile_bytes=2).collect()
    with pytest.raises(Exception, match="unexpected tile byte length"):
        T.pack_tile_batch(many.limit(2), "batch", tile_bytes=4).collect()


def test_sink_skips_existing(spark, folder):
    d = spark.createDataFrame([("hand", "v1", 9, 1, 1, bytearray(b"aa"), False), ("hand", "v1", 9, 1, 2, bytearray(b"bb"), True)],
                              "layer string, dataset_version string, z int, x int, y int, content binary, empty boolean")
    path = str(folder / "out")
    T.sink_tiles(d, path)
    T.sink_tiles(d, path, skip_empty=False)
    r = spark.read.parquet(path)
    assert sorted((x.y, x.data_status) for x in r.collect()) == [(1, "ok"), (2, "source-nodata")]


def test_sink_reads_only_the_folders_named(spark, folder):
    """Another version and another zoom are not listed for the comparison, and tiles of them are not taken for held."""
    make = lambda v, z: spark.range(40).select(F.lit("hand").alias("layer"), F.lit(v).alias("dataset_version"), F.lit(z).alias("z"), F.col("id").cast("int").alias("x"),
                                               F.lit(1).alias("y"), F.lit(b"ab").alias("content"), F.lit(False).alias("empty"))
    path = str(folder / "out")
    assert T.held_tiles(spark, path) is None
    T.sink_tiles(make("v1", 9).unionByName(make("v1", 10)), path)
    within = (F.col("layer") == "hand") & (F.col("dataset_version") == "v2") & (F.col("z") == 9)
    T.sink_tiles(make("v2", 9), path, within=within)
    T.sink_tiles(make("v2", 9), path, within=within)
    assert T.held_tiles(spark, path).count() == 120 and T.held_tiles(spark, path, within).count() == 40
    plan = T.held_tiles(spark, path, within)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "content" not in plan
    files = [p for p in (folder / "out").rglob("*.parquet")]
    assert len(files) == 3  # forty small tiles of a zoom are one file


def test_archives_on_disk(spark, folder):
    with zipfile.ZipFile(folder / "010700.zip", "w") as z:
        z.writestr("010700/010700.tif", b"elev")
        z.writestr("010700/010700hand.tif", b"hand")
    with zipfile.ZipFile(folder / "010800.zip", "w") as z:
        z.writestr("010800.tif", b"bare")
    a = spark.createDataFrame([(h, str(folder / f"{h}.zip")) for h in ("010700", "010800", "019900")], "huc string, path string")
    got = {(r.huc, r.role): (r.member, r.bytes) for r in T.archive_members(a).collect()}
    assert got[("010700", "hand")] == ("010700/010700hand.tif", 4) and got[("010800", "elevation")] == ("010800.tif", 4)
    assert {r.huc: r.ready for r in T.readiness_split(a).collect()} == {"010700": True, "010800": False, "019900": False}
    out = folder / "extracted"
    out.mkdir()
    assert {r.huc: r.status.split(":")[0] for r in T.extract_members(a, str(out)).collect()} == {"010700": "completed", "010800": "completed", "019900": "failed"}
    assert (out / "010700-elevation.tif").read_bytes() == b"elev"


def test_har_and_progress_files(spark, folder):
    e = {"time": 1.5, "request": {"url": "https://a.example/x"}, "response": {"status": 200, "bodySize": -1, "headersSize": 10, "headers": [{"name": "Cache-Control", "value": "no-store"}],
                                                                          "content": {"size": 7, "mimeType": "text/html"}}}
    (folder / "a.har").write_text(json.dumps({"log": {"entries": [e, e]}}, indent=1))
    r = D.read_har(spark, str(folder / "a.har")).collect()
    assert [(x.entry, x.cache, x.encoding, x.body_size) for x in r] == [(0, "no-store", "(none)", -1), (1, "no-store", "(none)", -1)]
    (folder / "p.jsonl").write_text("\n".join(json.dumps(x) for x in (
        {"ts": "2026-01-01T00:00:00", "event": "start", "huc": "010700"}, {"ts": "2026-01-01T00:00:09", "event": "completed", "huc": "010700"})) + "\nnot json\n")
    got = P.latest_progress(D.read_progress(spark, str(folder / "p.jsonl"))).collect()
    assert [(x.huc, x.event, x.events) for x in got] == [("010700", "completed", 2)]


def test_invalid_manifest_is_ignored(spark, folder):
    region = {"id": "a", "bbox": [-87.0, 33.0, -86.0, 34.0], "crs": "EPSG:5070", "url": "x.tif"}
    doc = lambda **kw: json.dumps({"schema_version": 1, "dataset_version": "v1", "layers": {"hand": {"encoding": "uint16-decimeters", "nodata": 65535, "regions": [region]}}} | kw)
    (folder / "good.json").write_text(doc())
    (folder / "nolayers.json").write_text(doc(layers={}))
    (folder / "broken.json").write_text("{")
    (folder / "nodata.json").write_text(doc(layers={"hand": {"encoding": "uint16-decimeters", "nodata": 0, "regions": [region]}}))
    got = D.read_manifests(spark, str(folder)).collect()
    assert len(got) == 1 and got[0].path.endswith("good.json")


def test_resize_keeps_constants_and_gaps():
    a = np.full((8, 8), 12.0)
    a[0, 0] = np.nan
    out = M.resize_masked(a, 5, 3)
    assert out.shape == (5, 3) and np.allclose(out, 12.0)
    assert np.allclose(M.resize_weights(0, 8, 8, 8)[2], np.eye(8), atol=1e-12)
    assert np.isnan(M.resize_masked(np.full((4, 4), np.nan), 2, 2)).all()


def test_mosaic_order_and_gaps(spark):
    h = T.HALF_PIXEL_DEG
    row = lambda lat, lon, v: (lat, lon, lon - h, lat - h, lon + 1 + h, lat + 1 + h, 16, 16, bytearray(np.full((16, 16), v, dtype="<i2").tobytes()))
    src = spark.createDataFrame([row(33, -87, 100), row(33, -88, 200), row(34, -87, -32768), row(34, -88, 0)],
                                "lat int, lon int, left double, bottom double, right double, top double, height int, width int, data binary")
    tiles = spark.createDataFrame([(8, 66, 102), (8, 0, 0)], "z int, x int, y int")
    cells = M.blob_cells(M.mosaic_tiles(tiles, src, size=16), 16).collect()
    assert {c.v for c in cells} == {100, 200} and {(c.x, c.y) for c in cells} == {(66, 102)}
    assert len({(c.row, c.col) for c in cells}) == len(cells)


def test_mosaic_of_several_sources_of_a_square(spark):
    """The query against one pass over all embeddings in plain Python: sources of a square fill what earlier ones leave out."""
    from tilewater.functions import addressing as A
    from tilewater.plans import file_queries
    from tilewater.sources.tables import Tables

    t = Tables(spark, "/root/testdata/sf0.1")
    got = {(r.z, r.x, r.y, r.row, r.col): r.v for r in M.blob_cells(file_queries._mosaic(t), 8).collect()}
    z = F.lit(9)
    tiles = t.points().select(z.alias("z"), A.tile_x(F.col("lon"), z).alias("x"), A.tile_y(F.col("lat"), z).alias("y")).distinct()
    tiles = [(r.z, r.x, r.y, (r.b.left, r.b.bottom, r.b.right, r.b.top)) for r in tiles.withColumn("b", A.tile_bounds(F.col("x"), F.col("y"), F.col("z"))).collect()]
    h, want, used = T.HALF_PIXEL_DEG, {}, set()
    rasters = [(25 + r.vec_id % 20, -110 + r.vec_id // 20 % 40, r) for r in file_queries._rasters(t).collect()]
    assert len(rasters) > 800
    for lat, lon, r in sorted(rasters, key=lambda s: (s[0] * 1000 + s[1], s[2].vec_id)):
        src = np.array([np.nan if v is None else v for v in r["values"]], np.float32).reshape(8, 8)
        for z9, x, y, b in tiles:
            if lat <= b[3] - 1e-12 and lat + 1 >= b[1] + 1e-12 and lon <= b[2] - 1e-12 and lon + 1 >= b[0] + 1e-12:
                p = M.patch(src, (lon - h, lat - h, lon + 1 + h, lat + 1 + h), b, 8)
                for i, j in zip(*np.nonzero(np.isfinite(p[2]))) if p else ():
                    key = (z9, x, y, int(i) + p[0], int(j) + p[1])
                    if key not in want:
                        want[key] = int(p[2][i, j])
                        used.add(r.vec_id)
    assert got == want and max(used) >= 800


def _split(spark, folder, rows, schema, parts):
    """Write the rows as several parquet files, oldest first."""
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * step:(i + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_streams_carry_over_batches(spark, folder):
    rows = [(i % 3, i * 400_000, i) for i in range(90)]
    s = _split(spark, folder / "rate", rows, "k int, us long, id int", 4)
    got = {(r.k, r.us): r.in_window for r in O.run_rate_log(s.select("k", "us"), "k", "us", 2, 3_000_000).collect()}
    assert len(got) == 90
    for (k, us), n in got.items():
        assert n == sum(1 for kk, t, _ in rows if kk == k and us - 3_000_000 < t <= us)
    pan = [(1, i, i, 10, 500 + i, 300) for i in range(12)]
    s = _split(spark, folder / "pan", pan, "user long, us long, event_id long, z int, x int, y int", 5)
    got = sorted((r.event_id, r.next_x) for r in O.run_pan_prediction(s, "user", ["us", "event_id"]).collect())
    assert got == [(i, 501 + i) for i in range(2, 12)]


def test_late_rows_are_dropped(spark, folder):
    base = 1_700_000_000_000_000
    hour = 3_600_000_000
    rows = [(base + i * hour, -86.8, 33.5) for i in range(6)] + [(base, -86.8, 33.5)]
    s = _split(spark, folder / "late", rows, "us long, lon double, lat double", 7).withColumn("at", F.timestamp_micros("us"))
    got = O.run_append(O.viewport_counts(s, 7), "late").collect()
    assert sum(r.events for r in got) == 5  # the repeated first hour came too late, the last hour is still open


@pytest.mark.parametrize("height, width", [(7, 50), (40, 33), (90, 120)])
def test_resize_against_whole_weight_matrices(height, width):
    r = np.random.default_rng(height)
    v = r.integers(0, 500, (40, 33)).astype(np.float32)
    for holes in (False, True):
        if holes:
            v[r.random(v.shape) < 0.2] = np.nan

        def weights(src, dst):
            scale = src / dst
            t = (np.arange(src)[None, :] + 0.5 - (np.arange(dst) + 0.5)[:, None] * scale) / max(scale, 1.0)
            w = np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)
            return w / w.sum(axis=1, keepdims=True)

        ky, kx, mask = weights(40, height), weights(33, width), np.isfinite(v)
        num, den = ky @ np.nan_to_num(v) @ kx.T, ky @ mask @ kx.T
        known = den > 1e-6
        got = M.resize_masked(v, height, width)
        assert got.shape == (height, width) and (np.isfinite(got) == known).all()
        assert np.allclose(got[known], num[known] / den[known], rtol=1e-5, atol=1e-3)


def test_patches_merge_in_order_whatever_their_batches(spark):
    r = np.random.default_rng(2)
    rows, want = [], {}
    for tile in range(5):
        canvas = np.full((8, 8), M.NODATA)
        parts = []
        for rank in range(30):
            r0, c0 = r.integers(0, 6, 2)
            h, w = r.integers(1, 9 - r0), r.integers(1, 9 - c0)
            v = np.where(r.random((h, w)) < 0.3, M.NODATA, r.integers(-500, 9000, (h, w)))
            parts.append((5, tile, 1, int(rank // 7), rank, int(r0), int(c0), int(h), int(w), bytearray(v.astype("<i2").tobytes())))
            under = canvas[r0:r0 + h, c0:c0 + w]
            under[under == M.NODATA] = v[under == M.NODATA]
        want[tile] = canvas
        rows += parts
    whole = np.full((8, 8), 7)
    rows += [(5, 9, 1, 0, 1, 0, 0, 8, 8, bytearray(whole.astype("<i2").tobytes())), (5, 9, 1, 0, 2, 0, 0, 8, 8, bytearray((whole * 2).astype("<i2").tobytes()))]
    want[9] = whole
    df = spark.createDataFrame(rows, "z int, x int, y int, square int, rank long, r0 int, c0 int, h int, w int, data binary").repartition(6)
    got = {t.x: np.frombuffer(t.data, dtype="<i2").reshape(8, 8) for t in M.merged(df, 8).collect()}
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)


def test_pixels_come_from_tile_rows(spark):
    from tilewater.operators import joins as J

    data = (np.arange(64) - 20).astype("<i2")
    data[5] = -32768
    tiles = spark.createDataFrame([(3, 1, 2, bytearray(data.tobytes())), (4, 0, 0, b"")], "z int, x int, y int, data binary")
    points = spark.createDataFrame([(i, -134.9 + 5.6 * (i % 8), 66.0 - 3.0 * (i // 8)) for i in range(64)] + [(99, 100.0, 0.0)], "id int, lon double, lat double")
    out = J.sample_points(points, tiles, 3, 8)
    for p in out.collect():
        hit = (p.x, p.y) == (1, 2)
        want = int(data[p.row * 8 + p.col]) if hit else None
        assert p.tile_found == hit and p.v == (None if want == -32768 else want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Aggregate" not in plan
    codes = spark.createDataFrame([(3, 1, 2, bytearray(np.full(64, 40000, "<u2").tobytes()))], "z int, x int, y int, data binary")
    assert {p.v for p in J.sample_points(points, codes, 3, 8, nodata=65535).collect()} == {40000, None}
