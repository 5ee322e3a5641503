"""Web tiles from degree rasters: overlap windows, mask-aware resampling, patches of bytes merged in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.operators.joins import tile_source_overlap

C = F.col

# NODATA of 16-bit rasters, heights that count, share of zeros that makes a patch open water.
NODATA, LOWEST, HIGHEST, OCEAN = -32768, -500, 9000, 0.90
#: a source meets at most 4 ** NEST tiles of a zoom in one row; rows of a resize that one matrix product makes
NEST, STRIP = 5, 16


def resize_weights(first: int, last: int, src: int, dst: int, lobes: int = 3) -> tuple[int, int, np.ndarray]:
    """Windowed-sinc weights of result rows first..last: the source rows low..high they look at and a matrix over those.

    The window widens when shrinking, rows sum to one.
    """
    scale = src / dst
    width = max(scale, 1.0)
    centers = (np.arange(first, last) + 0.5) * scale
    low, high = max(0, int(centers[0] - lobes * width)), min(src, int(centers[-1] + lobes * width) + 2)
    t = (np.arange(low, high)[None, :] + 0.5 - centers[:, None]) / width
    w = np.where(np.abs(t) < lobes, np.sinc(t) * np.sinc(t / lobes), 0.0)
    return low, high, w / w.sum(axis=1, keepdims=True)


def _along(values: np.ndarray, n: int, bad: np.ndarray | None = None) -> np.ndarray:
    """Rows resized to n, a strip of result rows at a time from the source rows under its windows; `bad` cells count as 0."""
    out = np.empty((n, values.shape[1]))
    for first in range(0, n, STRIP):
        low, high, w = resize_weights(first, min(first + STRIP, n), len(values), n)
        rows = values[low:high].astype(np.float64)
        if bad is not None:
            rows[bad[low:high]] = 0.0
        out[first:first + STRIP] = w @ rows
    return out


def resize_masked(values: np.ndarray, height: int, width: int, bad: np.ndarray | None = None) -> np.ndarray:
    """Resize with `bad` cells (NaN if not given) as missing: value times mask and mask are resized apart and divided, so gaps do not bleed.

    The quotient is rounded to single precision, so that a constant stays that constant when it is truncated later.
    """
    bad = ~np.isfinite(values) if bad is None else bad
    holes = bool(bad.any())
    both = lambda v, without: _along(np.ascontiguousarray(_along(v, height, without).T), width).T
    num = both(values, bad if holes else None)
    if not holes:
        return num.astype(np.float32)
    den = both(~bad, None)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(den > 1e-6, num / den, np.nan).astype(np.float32)


def axis_map(low: float, high: float, cells: int, tile_low, tile_high, size: int) -> np.ndarray:
    """On one axis, for each of many tiles: first and last source cell, first and last tile cell of what they share (rows of four).

    Axes run in the direction of the cells; without overlap the ranges are empty.
    """
    tile_low, tile_high = np.asarray(tile_low, dtype=np.float64), np.asarray(tile_high, dtype=np.float64)
    a, b = np.maximum(low, tile_low), np.minimum(high, tile_high)
    source = [np.trunc((e - low) / (high - low) * cells) for e in (a, b)]
    share = [(e - tile_low) / (tile_high - tile_low) for e in (a, b)]
    tile = [np.floor(share[0] * size), np.where(np.abs(share[1] - 1.0) < 1e-10, size, np.floor(share[1] * size))]
    out = np.stack([*source, *np.clip(tile, 0, size)], axis=-1).astype(np.int64)
    return np.where((a < b)[..., None], out, 0)


def cut_out(src: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray | None:
    """What a source shows in the tile cells of two axis maps: whole metres, NaN missing; None if they are empty.

    Heights beyond LOWEST and HIGHEST (so both NODATA values, and NaN) are missing, zeros too where they make up OCEAN of the window.
    """
    (y0, y1, r0, r1), (x0, x1, c0, c1) = ys.tolist(), xs.tolist()
    if y1 <= y0 or x1 <= x0 or r1 <= r0 or c1 <= c0:
        return None
    part = src[y0:y1, x0:x1]
    bad = ~((part >= LOWEST) & (part <= HIGHEST))
    if part.size - np.count_nonzero(part) >= OCEAN * part.size:
        bad |= part == 0
    if part.shape == (r1 - r0, c1 - c0):
        return np.where(bad, np.nan, np.trunc(part)).astype(np.float32)
    part = np.trunc(resize_masked(part, r1 - r0, c1 - c0, bad))
    part[(part < LOWEST) | (part > HIGHEST)] = np.nan
    return part


def patch(src: np.ndarray, sb, tb, size: int) -> tuple[int, int, np.ndarray] | None:
    """One source in one tile: first row, first column, heights. `sb` and `tb` are (left, bottom, right, top)."""
    ys = axis_map(-sb[3], -sb[1], src.shape[0], -tb[3], -tb[1], size)
    xs = axis_map(sb[0], sb[2], src.shape[1], tb[0], tb[2], size)
    part = cut_out(src, ys, xs)
    return None if part is None else (int(ys[2]), int(xs[2]), part)


def patches(tiles: DataFrame, sources: DataFrame, size: int, order: str | None) -> DataFrame:
    """z, x, y, square, rank, r0, c0, h, w, data: bytes of every source in every tile it shows something in.

    A source meets the tiles over its degree square in lists of at most 4 ** NEST of a zoom, so a raster is moved and decoded once for each list.
    """
    pairs = tile_source_overlap(tiles.select("z", "x", "y").distinct(), sources.select("lat", "lon").distinct())
    up = lambda c: F.shiftright(C(c), NEST)
    box = F.struct("x", "y", C("_t.left").alias("left"), C("_t.bottom").alias("bottom"), C("_t.right").alias("right"), C("_t.top").alias("top"))
    wanted = pairs.withColumn("_t", A.tile_bounds(C("x"), C("y"), C("z"))) \
        .groupBy("lat", "lon", "z", up("x").alias("_px"), up("y").alias("_py")).agg(F.collect_list(box).alias("wanted")).drop("_px", "_py")
    rank = C(order).cast("long") if order else F.lit(0).cast("long")
    work = sources.join(wanted, ["lat", "lon"]).select(
        "z", (C("lat") * 1000 + C("lon")).cast("int").alias("square"), rank.alias("rank"), "left", "bottom", "right", "top", "height", "width", "data", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i].as_py() for n in batch.schema.names if n != "wanted"}
                want = batch.column("wanted")[i].values
                x, y, left, bottom, right, top = (want.field(k).to_numpy() for k in range(6))
                src = np.frombuffer(r["data"], dtype="<i2").reshape(r["height"], r["width"])
                ys = axis_map(-r["top"], -r["bottom"], r["height"], -top, -bottom, size)
                xs = axis_map(r["left"], r["right"], r["width"], left, right, size)
                for k in range(len(x)):  # one patch at a time
                    part = cut_out(src, ys[k], xs[k])
                    if part is None or not np.isfinite(part).any():
                        continue
                    data = np.where(np.isfinite(part), part, NODATA).astype("<i2").tobytes()
                    one = [r["z"], x[k], y[k], r["square"], r["rank"], ys[k][2], xs[k][2], *part.shape, data]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, _PATCH.types)], schema=_PATCH)

    return work.mapInArrow(run, "z int, x int, y int, square int, rank long, r0 int, c0 int, h int, w int, data binary")


_PATCH = pa.schema([(n, pa.int64() if n == "rank" else pa.binary() if n == "data" else pa.int32())
                    for n in ("z", "x", "y", "square", "rank", "r0", "c0", "h", "w", "data")])
_TILE = pa.schema([("z", pa.int32()), ("x", pa.int32()), ("y", pa.int32()), ("data", pa.binary())])


def merged(parts: DataFrame, size: int) -> DataFrame:
    """Patches -> one row per tile (z, x, y, data: size * size little-endian int16): of each cell the first height in (square, rank) order.

    Patches of a tile come in order and are laid on one canvas, one at a time, so memory does not grow with their number; a tile that is full
    looks at no further ones, and a patch that fills its tile alone is passed through.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, canvas, holes = None, None, 0

        def flush() -> pa.RecordBatch:
            data = canvas if isinstance(canvas, bytes) else canvas.tobytes()
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, data), _TILE.types)], schema=_TILE)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("z", "x", "y"))))
            places = list(zip(*(batch.column(c).to_pylist() for c in ("r0", "c0", "h", "w"))))
            for i, (at, (r0, c0, h, w)) in enumerate(zip(keys, places)):
                if at != key:
                    if key is not None:
                        yield flush()
                    key, canvas, holes = at, np.full((size, size), NODATA, dtype="<i2"), size * size
                if not holes:
                    continue
                data = batch.column("data")[i].as_py()
                part = np.frombuffer(data, dtype="<i2").reshape(h, w)
                if part.size == size * size and holes == part.size and (part != NODATA).all():
                    canvas, holes = data, 0
                    continue
                under = canvas[r0:r0 + h, c0:c0 + w]
                new = (under == NODATA) & (part != NODATA)
                under[new] = part[new]
                holes -= int(new.sum())
        if key is not None:
            yield flush()

    dealt = parts.repartition("z", "x", "y").sortWithinPartitions("z", "x", "y", "square", "rank")
    return dealt.mapInArrow(run, "z int, x int, y int, data binary")


def mosaic_tiles(tiles: DataFrame, sources: DataFrame, size: int = 256, order: str | None = None) -> DataFrame:
    """z, x, y, data (size * size little-endian int16) of every requested tile in which some source has a height.

    `sources`: lat, lon (south-west degree corner), left, bottom, right, top, height, width, data (little-endian int16 bytes).
    The first source in (lat, lon, `order`) order shows, `order` being a whole number that ranks sources of one square.
    """
    return merged(patches(tiles, sources, size, order), size)


def blob_cells(tiles: DataFrame, size: int) -> DataFrame:
    """Cells (z, x, y, row, col, v) of tile rows, NODATA left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                v = np.frombuffer(batch.column("data")[i].as_py(), dtype="<i2")
                at = np.flatnonzero(v != NODATA)
                key = [np.full(len(at), batch.column(c)[i].as_py(), np.int32) for c in ("z", "x", "y")]
                cols = [*key, (at // size).astype(np.int32), (at % size).astype(np.int32), v[at].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["z", "x", "y", "row", "col", "v"])

    return tiles.select("z", "x", "y", "data").mapInArrow(run, "z int, x int, y int, row int, col int, v int")
