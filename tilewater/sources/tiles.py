"""Binary raster sources and sinks. Python only unpacks bytes, batch by batch; everything around it is DataFrame work.

Every decoder takes a DataFrame with the bytes in a column, so a folder of files (`binaryFile`) and bytes that Spark
derived go through the same code. Archives may be larger than a `binaryFile` row can be; those functions also
take a path column and stream the members.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

# Fixed values.
NODATA, NODATA_OLD = -32768, -32767
TILE_BYTES = 131072
MAX_BATCH_TILES = 24
HALF_PIXEL_DEG = 1.0 / 7200.0
SENT = 1 << 22  # bytes of tiles that a task holds before it hands them on

SIDECAR_DDL = "struct<shape:array<int>,height:int,width:int,bounds:struct<left:double,bottom:double,right:double,top:double>>"


def _stem(path):
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]+)?$", 1)


def pack_i16(values):
    """array<int> (NULL = NODATA) -> little-endian int16 bytes, the compact form for moving rasters through joins."""
    @F.pandas_udf("binary")
    def pack(v: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(a).astype("<i2").tobytes() for a in v])

    return pack(F.transform(values, lambda v: F.coalesce(v, F.lit(NODATA))))


def unpack_i16(data):
    """Little-endian int16 bytes -> array<int>, NODATA NULL; NULL for NULL."""
    @F.pandas_udf("array<int>")
    def unpack(blobs: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else np.frombuffer(b, dtype="<i2").astype(np.int32) for b in blobs])

    return F.transform(unpack(data), lambda v: F.when(v != NODATA, v))


def raster_cells(rasters: DataFrame, keys: list[str], width: int, nodata: bool = True) -> DataFrame:
    """Cells (keys, row, col, v) of rasters kept as little-endian int16 bytes in `data`; NODATA is NULL, or left out without `nodata`.

    A raster becomes columns at once; a batch in flight holds the cells of one raster.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blob = batch.column("data")[i].as_py()
                v = np.frombuffer(blob or b"", dtype="<i2").astype(np.int32)
                at = np.arange(len(v)) if nodata else np.flatnonzero(v != NODATA)
                same = [pa.array([batch.column(k)[i].as_py()], batch.column(k).type).take(pa.array(np.zeros(len(at), np.int64))) for k in keys]
                cells = [(at // width).astype(np.int32), (at % width).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*same, *map(pa.array, cells), pa.array(v[at], mask=v[at] == NODATA)], names=[*keys, "row", "col", "v"])

    types = dict(rasters.dtypes)
    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "row int, col int, v int"
    return rasters.select(*keys, "data").mapInArrow(run, schema)


def codes_of_heights(data):
    """Little-endian int16 metres -> little-endian uint16 elevation codes (form v1 of `values.encode_elevation`), 65535 where none is."""
    @F.pandas_udf("binary")
    def encode(blobs: pd.Series) -> pd.Series:
        out = []
        for b in blobs:
            v = np.frombuffer(b, dtype="<i2").astype(np.float64)
            code = np.floor(((v + 500) / 9500.0 * 65534).astype(np.float32))
            out.append(np.where((v >= -500) & (v <= 9000), code, 65535).astype("<u2").tobytes())
        return pd.Series(out)

    return encode(data)


# ---- compressed elevation tiles -----------------------------------------------------------------

def decode_dem(tiles: DataFrame, keep: list[str], as_bytes: bool = False) -> DataFrame:
    """`content` (zstd int16) + `sidecar` (JSON) -> height, width, bounds, values; both NODATA sentinels become NULL.

    A frame whose size does not match its sidecar gives NULL values and `ok` = false. `as_bytes` keeps the
    raster as little-endian int16 bytes (`data`, old sentinel folded in) instead of an array.
    """
    meta = F.from_json("sidecar", SIDECAR_DDL)
    m = tiles.withColumn("_m", meta).withColumn("height", F.coalesce(F.get("_m.shape", F.lit(0)), C("_m.height"))) \
        .withColumn("width", F.coalesce(F.get("_m.shape", F.lit(1)), C("_m.width"))).select(*keep, "height", "width", C("_m.bounds").alias("bounds"), "content")

    @F.pandas_udf("binary" if as_bytes else "array<int>")
    def unpack(content: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        out = []
        for blob, h, w in zip(content, height, width):
            try:
                raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=int(h) * int(w) * 2)
                cells = np.frombuffer(raw, dtype="<i2") if len(raw) == int(h) * int(w) * 2 else None
            except (zstandard.ZstdError, TypeError, ValueError):
                cells = None
            if cells is not None:
                cells = np.where(cells == NODATA_OLD, NODATA, cells).astype("<i2").tobytes() if as_bytes else cells.astype(np.int32)
            out.append(cells)
        return pd.Series(out)

    if as_bytes:
        return m.withColumn("data", unpack("content", "height", "width")).withColumn("ok", C("data").isNotNull()).drop("content")
    v = m.withColumn("_v", unpack("content", "height", "width")).drop("content")
    clean = F.transform("_v", lambda x: F.when(~x.isin(NODATA, NODATA_OLD), x))
    return v.withColumn("ok", C("_v").isNotNull()).withColumn("values", clean).drop("_v")


def read_dem_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """Folder of `.zst` rasters with `.json` sidecars of the same stem."""
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(folder).select(_stem(C("path")).alias("tile_id"), "content")
    notes = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json") \
        .select(_stem(F.input_file_name()).alias("tile_id"), C("value").alias("sidecar"))
    return decode_dem(blobs.join(notes, "tile_id"), ["tile_id"])


def compress_dem(tiles: DataFrame, keep: list[str], level: int = 3) -> DataFrame:
    """`values` (array<int>, NULL = NODATA), height, width -> zstd content, sizes, ratio and a round-trip check."""
    schema = ", ".join(f"{n} {t}" for n, t in tiles.select(*keep).dtypes) + \
        ", content binary, original_size bigint, compressed_size bigint, ratio double, verified boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, reader = zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()
        for pdf in batches:
            blobs, sizes, good = [], [], []
            for vals in pdf["values"]:
                raw = np.asarray(vals).astype("<i2").tobytes()
                blob = packer.compress(raw)
                blobs.append(blob)
                sizes.append(len(raw))
                good.append(reader.decompress(blob, max_output_size=len(raw)) == raw)
            out = pdf[keep].copy()
            out["content"], out["original_size"] = blobs, sizes
            out["compressed_size"] = [len(b) for b in blobs]
            out["ratio"] = out["original_size"] / out["compressed_size"]
            out["verified"] = good
            yield out

    whole = F.transform("values", lambda v: F.coalesce(v, F.lit(NODATA))).alias("values")
    return tiles.select(*keep, whole).mapInPandas(run, schema)


def compress_summary(compressed: DataFrame, keys: list[str]) -> DataFrame:
    return compressed.groupBy(*keys).agg(
        F.count("*").alias("tiles"), F.sum("original_size").alias("original_size"), F.sum("compressed_size").alias("compressed_size"),
        (F.sum("original_size") / F.sum("compressed_size")).alias("ratio"), F.count_if("verified").alias("verified"))


# ---- big-endian height files ----------------------------------------------------------------------

def decode_hgt(files: DataFrame, keep: list[str], side: int = 3601, as_bytes: bool = True) -> DataFrame:
    """gzip big-endian int16 `content` of a degree tile at integer (lat, lon) -> raster, half-pixel aligned bounds and `ok`.

    The raster stays little-endian int16 bytes (`data`, the old sentinel folded in), as joins and blocks want it; without `as_bytes` it is
    an array (`values`, NODATA NULL), which for a whole degree tile is 13 million elements. Broken gzip or a wrong length gives NULL and `ok` = false.
    """
    @F.pandas_udf("binary")
    def unpack(content: pd.Series) -> pd.Series:
        out = []
        for blob in content:
            try:
                raw = gzip.decompress(blob)
                v = np.frombuffer(raw, dtype=">i2") if len(raw) == side * side * 2 else None
            except (OSError, EOFError, TypeError, zlib.error):
                v = None
            out.append(None if v is None else np.where(v == NODATA_OLD, NODATA, v).astype("<i2").tobytes())
        return pd.Series(out)

    h = HALF_PIXEL_DEG
    d = files.select(
        *keep, (C("lon") - h).alias("left"), (C("lat") - h).alias("bottom"), (C("lon") + 1 + h).alias("right"), (C("lat") + 1 + h).alias("top"),
        unpack("content").alias("data")).withColumn("ok", C("data").isNotNull())
    return d if as_bytes else d.withColumn("values", unpack_i16("data")).drop("data")


def read_hgt(spark: SparkSession, folder: str, side: int = 3601, as_bytes: bool = True) -> DataFrame:
    from tilewater.functions.addressing import parse_degree_tile_id

    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt.gz").load(folder)
    name = F.regexp_extract("path", r"([^/.]+)\.hgt\.gz$", 1)
    f = f.select(name.alias("name"), "content").withColumn("_p", parse_degree_tile_id(C("name"))).select("name", "_p.lat", "_p.lon", "content")
    return decode_hgt(f, ["name"], side, as_bytes)


# ---- web tiles ------------------------------------------------------------------------------------

# Variants of a stored tile, best first. Brotli needs a codec that may be missing.
VARIANTS = ("u16", "u16.gz", "u16.br")
TILE_PATH = r"/(\d+)/(\d+)/(\d+)\.(u16(?:\.gz|\.br)?)$"


def tile_address(files: DataFrame, path: str = "path") -> DataFrame:
    """Parse z, x, y and the variant of each tile file path; other files drop out."""
    part = lambda i: F.regexp_extract(path, TILE_PATH, i)
    rank = F.array_position(F.array(*[F.lit(v) for v in VARIANTS]), C("variant"))
    return files.where(C(path).rlike(TILE_PATH)).withColumn("variant", part(4)).withColumn("rank", rank) \
        .withColumns({n: part(i).cast("int") for i, n in enumerate(("z", "x", "y"), 1)})


def best_variants(files: DataFrame, path: str = "path") -> DataFrame:
    """Path of the best variant per tile; looks at names only, so no content is read or shuffled."""
    return tile_address(files, path).groupBy("z", "x", "y").agg(F.min_by(F.struct(path, "variant"), "rank").alias("_b")).select("z", "x", "y", "_b.*")


#: what became of a stored tile: read, broken (codec error or wrong length), or in a codec that the workers lack
TILE_OK, TILE_CORRUPT, TILE_NO_CODEC = "ok", "corrupt", "no-codec"


def decode_u16(tiles: DataFrame, keep: list[str], size: int = 65536) -> DataFrame:
    """`content` + `variant` -> `values` (array<int>, NODATA NULL) and `status`.

    A tile that cannot be read has NULL values and a status that says why, so it is never taken for a tile of NODATA, whose values are an
    array of NULLs.
    """
    @F.pandas_udf("status string, codes array<int>")
    def unpack(content: pd.Series, variant: pd.Series) -> pd.DataFrame:
        status, codes = [], []
        for blob, v in zip(content, variant):
            try:
                if v == "u16.gz":
                    blob = gzip.decompress(blob)
                elif v == "u16.br":
                    import brotli  # optional codec

                    blob = brotli.decompress(blob)
                found = np.frombuffer(blob, dtype="<u2").astype(np.int32) if len(blob) == size * 2 else None
                status.append(TILE_CORRUPT if found is None else TILE_OK)
            except ImportError:
                found = None
                status.append(TILE_NO_CODEC)
            except (OSError, EOFError, TypeError, zlib.error):
                found = None
                status.append(TILE_CORRUPT)
            codes.append(found)
        return pd.DataFrame({"status": status, "codes": codes})

    d = tiles.select(*keep, unpack("content", "variant").alias("_d"))
    return d.select(*keep, F.transform("_d.codes", lambda x: F.when(x != 65535, x)).alias("values"), C("_d.status").alias("status"))


def read_tile_dir(spark: SparkSession, folder: str, size: int = 65536) -> DataFrame:
    """`{z}/{x}/{y}.u16[.gz|.br]` tree -> one row per tile with its values and status (see `decode_u16`)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    best = best_variants(files.select("path"))
    return decode_u16(files.select("path", "content").join(best, "path"), ["z", "x", "y", "variant"], size)


def encode_u16(tiles: DataFrame, keep: list[str], compress: bool = False) -> DataFrame:
    """`values` (array<int>, NULL = NODATA) -> little-endian uint16 `content`, optionally gzip."""
    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        blobs = [np.asarray(vals).astype("<u2").tobytes() for vals in values]
        return pd.Series([gzip.compress(b, 1, mtime=0) if compress else b for b in blobs])

    return tiles.select(*keep, pack(F.transform("values", lambda v: F.coalesce(v, F.lit(65535)))).alias("content"))


def held_tiles(spark: SparkSession, path: str, within=None) -> DataFrame | None:
    """Keys of the tiles that the target holds, or None before the first write.

    `within` is a condition on layer, dataset_version and z, the folders of the target: only those that it names are listed and read, and of
    them the two key columns.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    held = spark.read.parquet(path)
    return (held if within is None else held.where(within)).select("layer", "dataset_version", "z", "x", "y")


def sink_tiles(tiles: DataFrame, path: str, skip_empty: bool = True, within=None) -> None:
    """Append tiles (layer, dataset_version, z, x, y, content, empty) that the target does not hold yet, with their metadata.

    Tiles given twice are written once (the smallest content). `within` (see `held_tiles`) must cover all `tiles`; a run over some zooms of a
    version then looks at no others. Files follow bytes: rows are rebalanced by layer, version and zoom, so adaptive execution cuts a big zoom and joins
    small ones at spark.sql.adaptive.advisoryPartitionSizeInBytes, however many tiles there are.
    """
    key = ["layer", "dataset_version", "z", "x", "y"]
    status = F.when(C("empty"), "source-nodata").otherwise("ok")
    new = tiles.withColumn("data_status", status).withColumn("raw_bytes", F.length("content")).withColumn("encoding", F.lit("identity"))
    if skip_empty:
        new = new.where(~C("empty"))
    held = held_tiles(tiles.sparkSession, path, within)
    if held is not None:
        new = new.join(held, key, "left_anti")
    rest = [c for c in new.columns if c not in key]
    new = new.groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
    new.drop("empty").hint("rebalance", "layer", "dataset_version", "z").write.mode("append").partitionBy("layer", "dataset_version", "z").parquet(path)


# ---- tile batches ---------------------------------------------------------------------------------

# Batch formats, magic -> (header layout per tile, bytes per tile header).
BATCH_FORMATS = {"FMB1": ("<BHH", 5), "FMT2": ("<BII", 9)}


def pack_tile_batch(tiles: DataFrame, batch: str, fmt: str = "FMT2", tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(batch, pos, z, x, y, content) -> one payload per batch; a batch holds at most 24 tiles of equal size.

    Oversized batches and wrong tile lengths are errors. Each batch reaches one call, bounded by the format.
    """
    layout, _ = BATCH_FORMATS[fmt]
    kind = dict(tiles.dtypes)[batch]
    checked = tiles.withColumn("_len", F.when(F.length("content") == tile_bytes, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("unexpected tile byte length "), F.length("content").cast("string"))).cast("boolean"))).where("_len")
    sized = checked.groupBy(batch).agg(F.count("*").alias("_n")).withColumn("_ok", F.when(C("_n") <= MAX_BATCH_TILES, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"batch cannot exceed {MAX_BATCH_TILES} tiles")).cast("boolean")))
    ok = checked.join(sized.where("_ok").select(batch), batch)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        head = b"".join(struct.pack(layout, int(z), int(x), int(y)) for z, x, y in zip(pdf["z"], pdf["x"], pdf["y"]))
        body = b"".join(pdf["content"])
        payload = fmt.encode() + struct.pack("<BH", 1, len(pdf)) + head + body
        return pd.DataFrame({batch: [pdf[batch].iloc[0]], "tiles": [len(pdf)], "payload": [payload]})

    return ok.select(batch, "pos", "z", "x", "y", "content").groupBy(batch).applyInPandas(run, f"{batch} {kind}, tiles int, payload binary")


def unpack_tile_batch(batches: DataFrame, batch: str, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """Payload -> tiles; a payload with a wrong magic, version or length gives no rows."""
    kind = dict(batches.dtypes)[batch]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows, held = [], 0
            for key, blob in zip(pdf[batch], pdf["payload"]):
                known = BATCH_FORMATS.get(blob[:4].decode("latin-1"))
                if known is None or len(blob) < 7:
                    continue
                version, n = struct.unpack_from("<BH", blob, 4)
                layout, width = known
                body = 7 + n * width
                if version != 1 or len(blob) != body + n * tile_bytes:
                    continue
                for i in range(n):
                    z, x, y = struct.unpack_from(layout, blob, 7 + i * width)
                    rows.append((key, i, z, x, y, blob[body + i * tile_bytes: body + (i + 1) * tile_bytes]))
                held += len(blob)
                if held >= SENT:  # or a batch of payloads would be held a second time as tiles
                    yield pd.DataFrame(rows, columns=[batch, "pos", "z", "x", "y", "content"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=[batch, "pos", "z", "x", "y", "content"])

    return batches.select(batch, "payload").mapInPandas(run, f"{batch} {kind}, pos int, z int, x int, y int, content binary")


# ---- archives -------------------------------------------------------------------------------------

def _open(path, content):
    return zipfile.ZipFile(io.BytesIO(content) if content is not None else path)


def _find(names: set[str], unit: str, filename: str) -> str | None:
    """Member `unit/filename`, else the only member that ends so, else the bare name."""
    if f"{unit}/{filename}" in names:
        return f"{unit}/{filename}"
    tail = [n for n in names if n.endswith(f"/{filename}")]
    if len(tail) == 1:
        return tail[0]
    return filename if filename in names and not tail else None


def _source_columns(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select("huc", C("path") if "path" in have else F.lit(None).cast("string").alias("path"),
                     C("content") if "content" in have else F.lit(None).cast("binary").alias("content"))


def archive_members(archives: DataFrame, checksum: bool = True) -> DataFrame:
    """The elevation and the height member of each archive: name, bytes, SHA-256 (streamed), or the error.

    One archive per row and call; members are read in one-megabyte pieces, so archive size does not matter.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for huc, path, content in zip(pdf["huc"], pdf["path"], pdf["content"]):
                wanted = (("hand", f"{huc}hand.tif"), ("elevation", f"{huc}.tif"))
                try:
                    archive = _open(path, content)  # once for both members
                except (OSError, zipfile.BadZipFile, TypeError) as exc:
                    rows += [(huc, path, role, None, None, None, str(exc)) for role, _ in wanted]
                    continue
                with archive as z:
                    names = set(z.namelist())
                    for role, filename in wanted:
                        try:
                            name = _find(names, huc, filename)
                            if name is None:
                                rows.append((huc, path, role, None, None, None, f"{role} member not found"))
                                continue
                            digest = None
                            if checksum:
                                sha = hashlib.sha256()
                                with z.open(name) as src:
                                    while piece := src.read(1 << 20):
                                        sha.update(piece)
                                digest = sha.hexdigest()
                            rows.append((huc, path, role, name, z.getinfo(name).file_size, digest, None))
                        except (OSError, zipfile.BadZipFile, TypeError) as exc:
                            rows.append((huc, path, role, None, None, None, str(exc)))
            yield pd.DataFrame(rows, columns=["huc", "path", "role", "member", "bytes", "sha256", "error"])

    schema = "huc string, path string, role string, member string, bytes bigint, sha256 string, error string"
    return _source_columns(archives).mapInPandas(run, schema)


def extract_members(archives: DataFrame, target: str | None = None) -> DataFrame:
    """Pull the elevation member of each archive. With `target`, it is streamed to `target/<huc>-elevation.tif` and its
    size reported; without, the bytes come back as a column (for members that fit a row)."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import shutil

        for pdf in parts:
            rows = []
            for huc, path, content in zip(pdf["huc"], pdf["path"], pdf["content"]):
                try:
                    with _open(path, content) as z:
                        name = _find(set(z.namelist()), huc, f"{huc}.tif")
                        if name is None:
                            rows.append((huc, None, None, None, "missing"))
                            continue
                        size = z.getinfo(name).file_size
                        if target is None:
                            rows.append((huc, name, size, z.read(name), "completed"))
                            continue
                        final = os.path.join(target, f"{huc}-elevation.tif")
                        part = f"{final}.{os.getpid()}.tmp"
                        with z.open(name) as src, open(part, "wb") as dst:
                            shutil.copyfileobj(src, dst, 8 << 20)
                        os.replace(part, final)
                        rows.append((huc, name, size, None, "completed"))
                except (OSError, zipfile.BadZipFile, TypeError) as exc:
                    rows.append((huc, None, None, None, f"failed: {exc}"))
            yield pd.DataFrame(rows, columns=["huc", "member", "bytes", "content", "status"])

    return _source_columns(archives).mapInPandas(run, "huc string, member string, bytes bigint, content binary, status string")


def readiness_split(archives: DataFrame) -> DataFrame:
    """Ready when both members are present; otherwise the first reason. One row per (huc, path)."""
    m = archive_members(archives, checksum=False)
    return m.groupBy("huc", "path").agg((F.count("error") == 0).alias("ready"), F.min_by("error", F.when(C("error").isNotNull(), C("role"))).alias("reason"))
