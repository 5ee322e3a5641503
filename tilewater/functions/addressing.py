"""Web-Mercator tile addressing as column expressions.

Everything here stays inside whole-stage code generation: no UDFs, no joins.
`ln(tan p + 1/cos p)` is used for the inverse Gudermannian because it gives the same tile on every engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tiling scheme.
MAX_LAT = 85.05112878
HALF_WORLD_M = 20037508.342789244
TILE_SIZE = 256


def scale_of(z: Column) -> Column:
    """Tiles per side at zoom `z`, as a double."""
    return F.pow(F.lit(2.0), z)


def world_x(lon: Column, z: Column) -> Column:
    """Fractional tile column."""
    return (lon + 180.0) / 360.0 * scale_of(z)


def world_y(lat: Column, z: Column) -> Column:
    """Fractional tile row."""
    p = F.radians(lat)
    return (1.0 - F.ln(F.tan(p) + 1.0 / F.cos(p)) / math.pi) / 2.0 * scale_of(z)


def clip_lat(lat: Column) -> Column:
    return F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))


def clip_lon(lon: Column) -> Column:
    return F.greatest(F.lit(-180.0), F.least(F.lit(180.0), lon))


def _clamp_index(v: Column, z: Column) -> Column:
    return F.greatest(F.lit(0), F.least(scale_of(z).cast("int") - 1, v))


def tile_x(lon: Column, z: Column) -> Column:
    """Tile column, truncated and not clamped."""
    return world_x(lon, z).cast("int")


def tile_y(lat: Column, z: Column) -> Column:
    """Tile row, truncated and not clamped."""
    return world_y(lat, z).cast("int")


def tile_x_floor(lon: Column, z: Column, clamp: bool = True) -> Column:
    v = F.floor(world_x(lon, z)).cast("int")
    return _clamp_index(v, z) if clamp else v


def tile_y_floor(lat: Column, z: Column, clamp: bool = True) -> Column:
    v = F.floor(world_y(clip_lat(lat), z)).cast("int")
    return _clamp_index(v, z) if clamp else v


def _pixel(world: Column) -> Column:
    raw = ((world - F.floor(world)) * TILE_SIZE).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(TILE_SIZE - 1), raw))


def tile_pixel(lon: Column, lat: Column, z: Column) -> Column:
    """struct<x,y,px,py>: tile and the pixel inside it; latitude is clipped, the tile index is not."""
    wx, wy = world_x(lon, z), world_y(clip_lat(lat), z)
    return F.struct(
        F.floor(wx).cast("int").alias("x"), F.floor(wy).cast("int").alias("y"),
        _pixel(wx).alias("px"), _pixel(wy).alias("py"),
    )


def _edge_lat(y: Column, z: Column) -> Column:
    t = F.lit(math.pi) * (1.0 - 2.0 * y / scale_of(z))
    return F.degrees(F.atan(F.sinh(t)))


def tile_bounds(x: Column, y: Column, z: Column) -> Column:
    """struct<top,bottom,left,right> in degrees."""
    n = scale_of(z)
    return F.struct(
        _edge_lat(y, z).alias("top"), _edge_lat(y + 1, z).alias("bottom"),
        (x / n * 360.0 - 180.0).alias("left"), ((x + 1) / n * 360.0 - 180.0).alias("right"),
    )


def tile_mercator_bounds(x: Column, y: Column, z: Column) -> Column:
    """struct<minx,miny,maxx,maxy> in EPSG:3857 metres."""
    span = F.lit(2.0 * HALF_WORLD_M) / scale_of(z)
    minx = x * span - HALF_WORLD_M
    maxy = F.lit(HALF_WORLD_M) - y * span
    return F.struct(minx.alias("minx"), (maxy - span).alias("miny"), (minx + span).alias("maxx"), maxy.alias("maxy"))


def mercator_to_lonlat(mx: Column, my: Column) -> Column:
    lat = F.degrees(2.0 * F.atan(F.exp(my / HALF_WORLD_M * math.pi)) - math.pi / 2.0)
    return F.struct((mx / HALF_WORLD_M * 180.0).alias("lon"), lat.alias("lat"))


def lonlat_to_mercator(lon: Column, lat: Column) -> Column:
    my = F.ln(F.tan((clip_lat(lat) + 90.0) * math.pi / 360.0)) / math.pi * HALF_WORLD_M
    return F.struct((lon * HALF_WORLD_M / 180.0).alias("mx"), my.alias("my"))


def tile_bbox_lonlat(x: Column, y: Column, z: Column) -> Column:
    """struct<west,south,east,north>: tile corners through Mercator metres."""
    b = tile_mercator_bounds(x, y, z)
    lo, hi = mercator_to_lonlat(b["minx"], b["miny"]), mercator_to_lonlat(b["maxx"], b["maxy"])
    return F.struct(
        lo["lon"].alias("west"), lo["lat"].alias("south"), hi["lon"].alias("east"), hi["lat"].alias("north"),
    )


# ---- degree tiles ---------------------------------------------------------------------------

def degree_tile_id(lat: Column, lon: Column, version: int = 3) -> Column:
    """Identifier of the 1-degree source tile whose south-west corner is (lat, lon)."""
    return F.concat(
        F.when(lat >= 0, "n").otherwise("s"), F.lpad(F.abs(lat).cast("string"), 2, "0"), F.lit("_"),
        F.when(lon >= 0, "e").otherwise("w"), F.lpad(F.abs(lon).cast("string"), 3, "0"), F.lit(f"_1arc_v{version}"),
    )


def compact_degree_id(lat: Column, lon: Column) -> Column:
    """Same tile in the compact upper-case spelling, e.g. N33W080."""
    return F.concat(
        F.when(lat >= 0, "N").otherwise("S"), F.lpad(F.abs(lat).cast("string"), 2, "0"),
        F.when(lon >= 0, "E").otherwise("W"), F.lpad(F.abs(lon).cast("string"), 3, "0"),
    )


# The long and the compact spelling of a degree-tile name.
DEGREE_ID_PATTERN = (r"^([ns])(\d{1,2})_([ew])(\d{3})_1arc_v\d+.*$"
                     r"|^([ns])(\d{2})([ew])(\d{3})$")


def parse_degree_tile_id(name: Column) -> Column:
    """struct<lat,lon>, NULL fields when the name is neither spelling."""
    parts = F.split(F.regexp_replace(F.lower(name), DEGREE_ID_PATTERN, "$1$5\u0001$2$6\u0001$3$7\u0001$4$8"), "\u0001")
    sign = lambda i, negative: F.when(F.get(parts, F.lit(i)) == negative, -1).otherwise(1)
    value = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return F.struct((value(1) * sign(0, "s")).alias("lat"), (value(3) * sign(2, "w")).alias("lon"))


# ---- tile families and validity ---------------------------------------------------------------

def ancestor(v: Column, levels: Column | int) -> Column:
    """Index of the ancestor tile `levels` zooms up."""
    return F.floor(v / F.pow(F.lit(2.0), F.lit(levels) if isinstance(levels, int) else levels)).cast("int")


def wrap_x(x: Column, z: Column) -> Column:
    return F.pmod(x, scale_of(z).cast("int"))


def clamp_y(y: Column, z: Column) -> Column:
    return _clamp_index(y, z)


def tile_key(z: Column, x: Column, y: Column, sep: str = "/") -> Column:
    return F.concat_ws(sep, z.cast("string"), x.cast("string"), y.cast("string"))


def tile_valid(z: Column, x: Column, y: Column, zmin: int, zmax: int) -> Column:
    n = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.least(z, F.lit(30)), F.lit(0)))
    return z.between(zmin, zmax) & (x >= 0) & (x < n) & (y >= 0) & (y < n)


# Multipliers of the shard hash.
SHARD_PRIMES = (73_856_093, 19_349_663, 83_492_791)


def tile_shard(z: Column, x: Column, y: Column, shards: int) -> Column:
    """Stable shard number of a tile; also usable as a `repartition` key."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    pz, px, py = (v.cast("bigint") * p for v, p in zip((z, x, y), SHARD_PRIMES))
    return F.pmod(pz.bitwiseXOR(px).bitwiseXOR(py), F.lit(shards)).cast("int")


# ---- boxes ------------------------------------------------------------------------------------

def bbox_valid(west: Column, south: Column, east: Column, north: Column) -> Column:
    return (west >= -180) & (west < east) & (east <= 180) & (south >= -90) & (south < north) & (north <= 90)


def bbox_contains(west: Column, south: Column, east: Column, north: Column, lon: Column, lat: Column) -> Column:
    """Half-open: the west and south edges belong to the box."""
    return (lon >= west) & (lon < east) & (lat >= south) & (lat < north)


def bbox_intersects(a: tuple, b: tuple) -> Column:
    """Open-interval intersection of two (west, south, east, north) tuples of columns."""
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


# ---- grids ------------------------------------------------------------------------------------

def grid_estimate(width: Column, height: Column, resolution: float) -> Column:
    """struct<columns,rows,cells,raw_bytes> of a two-byte grid; halves round to even."""
    cols = F.greatest(F.lit(1), F.rint(width / resolution).cast("bigint"))
    rows = F.greatest(F.lit(1), F.rint(height / resolution).cast("bigint"))
    return F.struct(cols.alias("columns"), rows.alias("rows"), (cols * rows).alias("cells"),
                    (cols * rows * 2).alias("raw_bytes"))


def affine_index(origin: Column | float, step: float, coord: Column) -> Column:
    """Index of the cell that holds `coord` on a regular axis."""
    return F.floor((coord - origin) / step).cast("int")
