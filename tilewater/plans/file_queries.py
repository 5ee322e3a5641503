"""Queries for binary sources and sinks. The bytes are derived from the tables by Spark, then read back."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.operators.generators import tile_pixel_centers
from tilewater.operators.mosaic import blob_cells, mosaic_tiles
from tilewater.plans import sqltext as S
from tilewater.plans.products import build_pyramid, render_regions
from tilewater.plans.raster_queries import _round
from tilewater.plans.registry import query
from tilewater.session import spread, written
from tilewater.sources import tiles as T
from tilewater.streaming.sinks import shared_folder

C = F.col


def _rasters(t):
    """8x8 rasters as arrays, NODATA NULL; codes are non-negative so that they also fit a uint16 tile."""
    k = C("vec_id")
    vals = F.transform("embedding", lambda e, i: F.when((i + k) % 13 != 0, F.floor(e.cast("double") * 2000.0).cast("int")))
    return t.read("embeddings").select("vec_id", F.lit(8).alias("height"), F.lit(8).alias("width"), vals.alias("values"))


def _cells(df, keys):
    # outer, as Spark would else test `values` for rows first and decode each tile twice
    return df.select(*keys, F.posexplode_outer("values").alias("_k", "v")).where("_k IS NOT NULL").select(
        *keys, F.floor(C("_k") / 8).cast("int").alias("row"), (C("_k") % 8).cast("int").alias("col"), "v")


@query("dem_compress_job", "", """
    SELECT label, count(*) AS tiles, count(*) * 128 AS original_size, count(*) AS verified, true AS smaller FROM embeddings GROUP BY label""")
def _(t):
    labels = t.read("embeddings").select("vec_id", "label")
    c = T.compress_dem(_rasters(t).join(labels, "vec_id"), ["vec_id", "label"])
    return T.compress_summary(c, ["label"]).select("label", "tiles", "original_size", "verified", (C("ratio") > 0.5).alias("smaller"))


@query("scan_dem_tiles", "fx_tile_cells", """
    SELECT vec_id, row, col, v, cast(-100 + vec_id % 30 AS double) AS lon_left FROM fx_tile_cells""")
def _(t):
    k = C("vec_id")
    blobs = written(T.compress_dem(_rasters(t), ["vec_id"]).select("vec_id", "content"))  # packed and unpacked by one Python a task
    edge = F.struct((F.lit(-100.0) + k % 30).alias("left"), F.lit(30.0).alias("bottom"), (F.lit(-99.0) + k % 30).alias("right"), F.lit(31.0).alias("top"))
    new = F.to_json(F.struct(F.array(F.lit(8), F.lit(8)).alias("shape"), edge.alias("bounds")))
    old = F.to_json(F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), edge.alias("bounds")))
    d = T.decode_dem(blobs.withColumn("sidecar", F.when(k % 2 == 0, new).otherwise(old)), ["vec_id"])
    return _cells(d.select("vec_id", C("bounds.left").alias("lon_left"), "values"), ["vec_id", "lon_left"])


@query("scan_hgt", "fx_tile_cells", """
    SELECT vec_id, row, col, v, round(vec_id % 50 - 1 / 7200e0, 9) AS bottom, round(-60 - vec_id % 40 + 1 + 1 / 7200e0, 9) AS east FROM fx_tile_cells""")
def _(t):
    @F.pandas_udf("binary")
    def as_hgt(values: pd.Series) -> pd.Series:  # big-endian copies of little-endian rasters
        return pd.Series([gzip.compress(np.frombuffer(b, dtype="<i2").astype(">i2").tobytes()) for b in values])

    k = C("vec_id")
    files = _rasters(t).select("vec_id", (k % 50).cast("int").alias("lat"), (F.lit(-60) - k % 40).cast("int").alias("lon"), as_hgt(T.pack_i16(C("values"))).alias("content"))
    d = T.decode_hgt(files, ["vec_id"], side=8)
    return T.raster_cells(d, ["vec_id", "bottom", "right"], 8).select("vec_id", "row", "col", "v", F.round("bottom", 9).alias("bottom"), F.round("right", 9).alias("east"))


_U16 = "cast(65535 AS integer)"


def _u16(t):
    return _rasters(t).withColumn("values", F.transform("values", lambda v: v + 4000))


@query("scan_tile_dir", "fx_tile_cells", """
    SELECT cast(9 AS integer) AS z, cast(vec_id AS integer) AS x, cast(vec_id % 300 AS integer) AS y, CASE WHEN vec_id % 3 = 2 THEN 'u16.gz' ELSE 'u16' END AS variant, row, col,
           v + 4000 + CASE WHEN vec_id % 3 = 2 THEN 1 ELSE 0 END AS v FROM fx_tile_cells""")
def _(t):
    # every tile has a gzip copy; two of three also have the raw file, which must win
    k = C("vec_id")
    base = F.concat(F.lit("/tiles/9/"), k.cast("string"), F.lit("/"), (k % 300).cast("string"))
    raw = T.encode_u16(_u16(t).where(k % 3 != 2), ["vec_id"]).select(F.concat(base, F.lit(".u16")).alias("path"), "content")
    gz = T.encode_u16(_u16(t).withColumn("values", F.transform("values", lambda v: v + 1)), ["vec_id"], compress=True) \
        .select(F.concat(base, F.lit(".u16.gz")).alias("path"), "content")
    files = raw.unionByName(gz)
    best = T.best_variants(files.select("path"))
    return _cells(T.decode_u16(files.join(best, "path"), ["z", "x", "y", "variant"], size=64), ["z", "x", "y", "variant"])


@query("scan_tile_dir_status", "", """
    SELECT CASE WHEN vec_id % 5 = 1 THEN 'u16.gz' ELSE 'u16' END AS variant, CASE WHEN vec_id % 5 IN (1, 2) THEN 'corrupt' ELSE 'ok' END AS status, count(*) AS tiles,
           cast(count(*) FILTER (vec_id % 5 = 3) AS bigint) AS blank FROM embeddings GROUP BY ALL""")
def _(t):
    # of five tiles one is broken gzip, one cut short and one whole but without data
    k = C("vec_id")
    values = F.when(k % 5 == 3, F.transform("values", lambda v: F.lit(None).cast("int"))).otherwise(C("values"))
    enc = T.encode_u16(_u16(t).withColumn("values", values), ["vec_id"])
    body = F.when(k % 5 == 1, F.lit("no gzip").cast("binary")).when(k % 5 == 2, F.substring("content", 1, 100)).otherwise(C("content"))
    name = F.concat(F.lit("/tiles/9/"), k.cast("string"), F.lit("/1.u16"), F.when(k % 5 == 1, ".gz").otherwise(""))
    files = enc.select(name.alias("path"), body.alias("content"))
    d = T.decode_u16(files.join(T.best_variants(files.select("path")), "path"), ["variant"], size=64)
    blank = F.coalesce(F.forall("values", lambda v: v.isNull()), F.lit(False))
    return d.groupBy("variant", "status").agg(F.count("*").alias("tiles"), F.count_if(blank).alias("blank"))


@query("pack_tile_batch", "", """
    SELECT cast(floor(vec_id / 20) AS bigint) AS batch, cast(count(*) AS integer) AS tiles, cast(7 + count(*) * (9 + 128) AS integer) AS bytes FROM embeddings GROUP BY 1""")
def _(t):
    return _packed(t).select("batch", "tiles", F.length("payload").alias("bytes"))


def _packed(t, fmt="FMT2"):
    k = C("vec_id")
    enc = T.encode_u16(_u16(t), ["vec_id"]).select(
        F.floor(k / 20).alias("batch"), (k % 20).cast("int").alias("pos"), F.lit(9).alias("z"), (k * 7 % 512).cast("int").alias("x"), (k % 300).cast("int").alias("y"), "content")
    return T.pack_tile_batch(enc, "batch", fmt, tile_bytes=128)


@query("unpack_tile_batch", "fx_tile_cells", """
    SELECT cast(floor(vec_id / 20) AS bigint) AS batch, cast(vec_id % 20 AS integer) AS pos, cast(9 AS integer) AS z, cast(vec_id * 7 % 512 AS integer) AS x,
           cast(vec_id % 300 AS integer) AS y, row, col, v + 4000 AS v FROM fx_tile_cells""")
def _(t):
    u = written(T.unpack_tile_batch(written(_packed(t, "FMB1")), "batch", tile_bytes=128)).withColumn("variant", F.lit("u16"))  # one Python a task
    keys = ["batch", "pos", "z", "x", "y"]
    return _cells(T.decode_u16(u, keys, size=64), keys)


@query("sink_tiles", "", """
    SELECT cast(8 + vec_id % 4 AS integer) AS z, count(*) AS tiles, cast(sum(128) AS bigint) AS bytes, count(DISTINCT vec_id) AS distinct_tiles
    FROM embeddings WHERE vec_id % 17 <> 0 GROUP BY 1""")
def _(t):
    k = C("vec_id")
    enc = T.encode_u16(_u16(t), ["vec_id"]).select(F.lit("hand").alias("layer"), F.lit("v1").alias("dataset_version"), (8 + k % 4).cast("int").alias("z"),
                                                    k.cast("int").alias("x"), (k % 300).cast("int").alias("y"), "content", (k % 17 == 0).alias("empty"))
    path = shared_folder(t.spark, "tiles")
    T.sink_tiles(enc.where(k % 2 == 0), path)
    T.sink_tiles(enc, path)  # the tiles of the first run are skipped
    r = t.spark.read.parquet(path)
    return r.groupBy("z").agg(F.count("*").alias("tiles"), F.sum("raw_bytes").alias("bytes"), F.count_distinct("x").alias("distinct_tiles"))


def _zips(t):
    """One small archive per customer: both members, the elevation one only, the bare name, or garbage."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            blobs = []
            for huc, path, pos in zip(pdf["huc"], pdf["path"], pdf["pos"]):
                if pos % 11 == 10:
                    blobs.append(b"not a zip")
                    continue
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                    folder = "" if pos % 5 == 4 else f"{huc}/"
                    z.writestr(f"{folder}{huc}.tif", f"elevation {path}".encode() * 3)
                    if pos % 4 != 3:
                        z.writestr(f"{folder}{huc}hand.tif", f"hand {path}".encode())
                blobs.append(buf.getvalue())
            yield pd.DataFrame({"huc": pdf["huc"], "path": pdf["path"], "content": blobs})

    # an archive is much work for few bytes
    return spread(t.archives().select("huc", "path", "pos"), "pos").mapInPandas(run, "huc string, path string, content binary")


_MEM = """m AS (SELECT huc, path, pos, CASE WHEN pos % 5 = 4 THEN '' ELSE huc || '/' END AS folder, pos % 11 <> 10 AS good, pos % 4 <> 3 AS paired FROM fx_archives)"""


@query("archive_checksum", "fx_archives", f"""
    WITH {_MEM} SELECT path, 'elevation' AS role, CASE WHEN good THEN folder || huc || '.tif' END AS member, CASE WHEN good THEN cast(3 * length('elevation ' || path) AS bigint) END AS bytes,
        CASE WHEN good THEN sha256(repeat('elevation ' || path, 3)) END AS sha256 FROM m
    UNION ALL SELECT path, 'hand', CASE WHEN good AND paired THEN folder || huc || 'hand.tif' END, CASE WHEN good AND paired THEN cast(length('hand ' || path) AS bigint) END,
        CASE WHEN good AND paired THEN sha256('hand ' || path) END FROM m""")
def _(t):
    return T.archive_members(_zips(t)).select("path", "role", "member", "bytes", "sha256")


@query("extract_archive_members", "fx_archives", f"""
    WITH {_MEM} SELECT huc, CASE WHEN good THEN folder || huc || '.tif' END AS member, CASE WHEN good THEN repeat('elevation ' || path, 3) END AS body, good AS completed FROM m""")
def _(t):
    e = T.extract_members(_zips(t))
    return e.select("huc", "member", C("content").cast("string").alias("body"), (C("status") == "completed").alias("completed"))


@query("readiness_split", "fx_archives", f"""
    WITH {_MEM} SELECT huc, path, good AND paired AS ready, CASE WHEN NOT good THEN 'File is not a zip file' WHEN NOT paired THEN 'hand member not found' END AS reason FROM m""")
def _(t):
    return T.readiness_split(_zips(t))


def _heights(t):
    """Every embedding as a source over a degree square."""
    k = C("vec_id")
    lat, lon = (F.lit(25) + k % 20).cast("int"), (F.lit(-110) + F.floor(k / 20) % 40).cast("int")
    h = T.HALF_PIXEL_DEG
    return _rasters(t).withColumns({"lat": lat, "lon": lon}).select(
        "vec_id", "lat", "lon", (C("lon") - h).alias("left"), (C("lat") - h).alias("bottom"), (C("lon") + 1 + h).alias("right"), (C("lat") + 1 + h).alias("top"), "height", "width",
        T.pack_i16(C("values")).alias("data"))


def _mosaic(t):
    z = F.lit(9)
    tiles = t.points().select(z.alias("z"), A.tile_x(C("lon"), z).alias("x"), A.tile_y(C("lat"), z).alias("y"))
    return mosaic_tiles(tiles, _heights(t), size=8, order="vec_id")


_H = f"{T.HALF_PIXEL_DEG!r}e0"


def _axis(a: str, low: str, high: str, tile_low: str, tile_high: str) -> str:
    """First and last source cell (s0, s1) and tile cell (d0, d1) that 8 source and 8 tile cells share on one axis."""
    lo, hi = f"greatest({low}, {tile_low})", f"least({high}, {tile_high})"
    share = lambda e: f"(({e}) - ({tile_low})) / (({tile_high}) - ({tile_low}))"
    cell = lambda e: S.i32(f"trunc((({e}) - ({low})) / (({high}) - ({low})) * 8)")
    end = f"CASE WHEN abs({share(hi)} - 1e0) < 1e-10 THEN 8 ELSE floor({share(hi)} * 8) END"
    clip = lambda e: S.i32(f"greatest(0, least(8, {e}))")
    return f"{lo} < {hi} AS {a}on, {cell(lo)} AS {a}s0, {cell(hi)} AS {a}s1, {clip(f'floor({share(lo)} * 8)')} AS {a}d0, {clip(end)} AS {a}d1"


def _mosaic_sql(tiles: str) -> str:
    """`cells` (z, x, y, row, col, v): tiles (a relation of z, x, y) over the sources of `_heights`, written out step by step."""
    sinc = lambda q: f"sin(pi() * ({q})) / (pi() * ({q}))"
    return f"""
         tl AS ({tiles}),
         tb AS (SELECT z, x, y, {S.top('y', 'z')} AS tt, {S.top('y + 1', 'z')} AS tbo, {S.left('x', 'z')} AS tlf, {S.left('x + 1', 'z')} AS tr FROM tl),
         so AS (SELECT vec_id, lat, lon, lon - {_H} AS l, lat - {_H} AS b, lon + 1 + {_H} AS r, lat + 1 + {_H} AS t FROM (
                 SELECT DISTINCT vec_id, cast(25 + vec_id % 20 AS integer) AS lat, cast(-110 + floor(vec_id / 20) % 40 AS integer) AS lon FROM fx_tile_cells)),
         pa AS (SELECT z, x, y, vec_id, lat * 1000 + lon AS square, {_axis('y', '-t', '-b', '-tt', '-tbo')}, {_axis('x', 'l', 'r', 'tlf', 'tr')}
                FROM tb JOIN so ON lat <= tt - 1e-12 AND lat + 1 >= tbo + 1e-12 AND lon <= tr - 1e-12 AND lon + 1 >= tlf + 1e-12),
         pp AS (SELECT * FROM pa WHERE yon AND xon AND ys1 > ys0 AND xs1 > xs0 AND yd1 > yd0 AND xd1 > xd0),
         pc AS (SELECT z, x, y, pp.vec_id, c.row - ys0 AS i, c.col - xs0 AS j, c.v,
                       avg(CASE WHEN c.v = 0 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY z, x, y, pp.vec_id) AS zeros
                FROM pp JOIN (SELECT vec_id, row, col, v FROM fx_tile_cells) c ON c.vec_id = pp.vec_id AND c.row >= ys0 AND c.row < ys1 AND c.col >= xs0 AND c.col < xs1),
         pv AS (SELECT z, x, y, vec_id, i, j, CASE WHEN v BETWEEN -500 AND 9000 AND NOT (v = 0 AND zeros >= 0.90) THEN cast(v AS double) END AS v FROM pc),
         ns AS (SELECT unnest(range(1, 9)) AS n), ms AS (SELECT unnest(range(1, 9)) AS m), ds AS (SELECT unnest(range(0, 8)) AS d), js AS (SELECT unnest(range(0, 8)) AS i),
         wq AS (SELECT n, m, d, i, (i + 0.5e0 - (d + 0.5e0) * (cast(n AS double) / m)) / greatest(cast(n AS double) / m, 1e0) AS q FROM ns, ms, ds, js WHERE d < m AND i < n),
         w0 AS (SELECT n, m, d, i, CASE WHEN q = 0 THEN 1e0 WHEN abs(q) < 3 THEN {sinc('q')} * {sinc('q / 3')} ELSE 0e0 END AS w FROM wq),
         wt AS (SELECT n, m, d, i, w / sum(w) OVER (PARTITION BY n, m, d) AS w FROM w0),
         rs AS (SELECT p.z, p.x, p.y, p.vec_id, p.square, p.yd0 + ky.d AS row, p.xd0 + kx.d AS col, sum(ky.w * kx.w * v.v) AS num,
                       sum(CASE WHEN v.v IS NOT NULL THEN ky.w * kx.w END) AS den
                FROM pp p JOIN pv v ON v.z = p.z AND v.x = p.x AND v.y = p.y AND v.vec_id = p.vec_id
                JOIN wt ky ON ky.n = ys1 - ys0 AND ky.m = yd1 - yd0 AND ky.i = v.i JOIN wt kx ON kx.n = xs1 - xs0 AND kx.m = xd1 - xd0 AND kx.i = v.j
                WHERE ys1 - ys0 <> yd1 - yd0 OR xs1 - xs0 <> xd1 - xd0 GROUP BY ALL),
         al AS (SELECT z, x, y, vec_id, square, row, col, CASE WHEN den > 1e-6 THEN {S.i32('trunc(cast(num / den AS float))')} END AS v FROM rs
                UNION ALL SELECT p.z, p.x, p.y, p.vec_id, p.square, p.yd0 + v.i, p.xd0 + v.j, {S.i32('v.v')} FROM pp p
                JOIN pv v ON v.z = p.z AND v.x = p.x AND v.y = p.y AND v.vec_id = p.vec_id WHERE ys1 - ys0 = yd1 - yd0 AND xs1 - xs0 = xd1 - xd0),
         rk AS (SELECT *, row_number() OVER (PARTITION BY z, x, y, row, col ORDER BY square, vec_id) AS nth FROM al WHERE v BETWEEN -500 AND 9000),
         cells AS (SELECT z, x, y, row, col, v FROM rk WHERE nth = 1)"""


_TILES9 = f"SELECT DISTINCT 9 AS z, {S.tx('lon', '9')} AS x, {S.ty('lat', '9')} AS y FROM fx_points"


def _listed(df, value):
    """z, x, y, number of cells, their sum and a hash of all of them in order."""
    cells = df.groupBy("z", "x", "y")
    one = F.struct((C("row") * 8 + C("col")).alias("at"), C(value).alias("v"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda c: F.concat_ws(":", c["at"].cast("string"), c["v"].cast("string"))), ",")
    return cells.agg(F.count("*").alias("cells"), F.sum(value).alias("total"), F.sha2(text, 256).alias("listing"))


def _listed_sql(value: str, source: str = "cells") -> str:
    return f"""SELECT z, x, y, count(*) AS cells, cast(sum({value}) AS bigint) AS total,
        sha256(string_agg(cast(row * 8 + col AS varchar) || ':' || cast({value} AS varchar), ',' ORDER BY row, col)) AS listing FROM {source} GROUP BY z, x, y"""


@query("mosaic_tiles", "fx_points fx_tile_cells", f"WITH {_mosaic_sql(_TILES9)} {_listed_sql('v')}")
def _(t):
    return _listed(blob_cells(_mosaic(t), 8), "v")


_COVER = " UNION ALL ".join(f"""SELECT {z} AS z, x, unnest(range(y0, y1 + 1)) AS y FROM (
    SELECT unnest(range({S.i32(f"floor({S.wx('west', str(z))})")}, {S.i32(f"floor({S.wx('east', str(z))})")} + 1)) AS x,
           {S.i32(f"floor({S.wy('north', str(z))})")} AS y0, {S.i32(f"floor({S.wy('south', str(z))})")} AS y1 FROM fx_regions)""" for z in (6, 7))


@query("build_pyramid", "fx_regions fx_tile_cells", f"""
    WITH {_mosaic_sql(f"SELECT DISTINCT z, cast(x AS integer) AS x, cast(y AS integer) AS y FROM ({_COVER})")},
         codes AS (SELECT z, x, y, row, col, {S.i32('floor(cast((v + 500) / 9500e0 * 65534 AS float))')} AS code FROM cells)
    {_listed_sql('code', 'codes')}""")
def _(t):
    path = shared_folder(t.spark, "pyramid")
    sources = _heights(t)
    boxes = t.regions().select("west", "south", "east", "north", "priority")
    for some in (boxes.where("priority % 2 = 0"), boxes):  # the second run writes what the first left out
        build_pyramid(some.drop("priority"), sources, 6, 7, path, "elevation", "v1", size=8, order="vec_id")
    tiles = T.decode_u16(t.spark.read.parquet(path).withColumn("variant", F.lit("u16")), ["z", "x", "y"], size=64)
    return _listed(_cells(tiles, ["z", "x", "y"]).where("v IS NOT NULL"), "v")


@query("render_regions", "fx_requests fx_regions fx_grid", f"""
    WITH tl AS (SELECT DISTINCT {S.tx('lon', '5')} AS x, {S.ty('lat', '5')} AS y FROM fx_points),
         px AS (SELECT x, y, row, col, (x + (col + 0.5e0) / 8) / 32e0 * 360e0 - 180e0 AS lon,
                       degrees(2e0 * atan(exp((1e0 - (y + (row + 0.5e0) / 8) / 16e0) * pi())) - pi() / 2e0) AS lat
                FROM tl, (SELECT unnest(range(8)) AS row) r, (SELECT unnest(range(8)) AS col) c),
         hit AS (SELECT px.x, px.y, px.row, px.col, id, priority, {S.i32('floor((north - lat) / 0.05e0)')} AS sr, {S.i32('floor((lon - west) / 0.1e0)')} AS sc
                 FROM px JOIN fx_regions ON lon >= west AND lon < east AND lat >= south AND lat < north),
         src AS (SELECT n.id, cast(floor(g.row / 25) AS integer) AS sr, g.col AS sc, g.v FROM fx_grid g JOIN fx_regions n ON n.priority = g.row % 25),
         al AS (SELECT hit.*, src.v, row_number() OVER (PARTITION BY x, y, row, col ORDER BY CASE WHEN src.v IS NULL THEN 1 ELSE 0 END, priority) AS nth
                FROM hit LEFT JOIN src ON src.id = hit.id AND src.sr = hit.sr AND src.sc = hit.sc)
    SELECT x, y, cast(row AS integer) AS row, cast(col AS integer) AS col, v, CASE WHEN v IS NOT NULL THEN priority END AS from_priority FROM al WHERE nth = 1""")
def _(t):
    z = F.lit(5)
    tiles = t.points().select(z.alias("z"), A.tile_x(C("lon"), z).alias("x"), A.tile_y(C("lat"), z).alias("y")).distinct()
    ll = A.mercator_to_lonlat(C("cx"), C("cy"))
    pixels = tile_pixel_centers(tiles, 8).withColumn("_l", ll).select("z", "x", "y", "row", "col", C("_l.lon").alias("lon"), C("_l.lat").alias("lat"))
    regions = t.regions().withColumns({"dx": F.lit(0.1), "dy": F.lit(0.05)})
    names = t.regions().select("id", C("priority").alias("_p"))
    cells = t.grid().select(C("row"), "col", "v").join(names, C("row") % 25 == C("_p")).select("id", F.floor(C("row") / 25).cast("int").alias("row"), "col", "v")
    return render_regions(pixels, regions, cells).drop("z")
