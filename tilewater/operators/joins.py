"""Joins of points, tiles, regions and rasters.

Range predicates are rewritten to equi-joins on exploded grid cells plus a residual filter, so no plan falls back
to a nested loop and no side is broadcast on faith: Spark picks broadcast or shuffle from sizes it measured, and AQE
splits hot cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.functions.geodesy import haversine_km_atan
from tilewater.operators import drainage as D
from tilewater.operators.ordered import Ordered
from tilewater.session import cut, written

C = F.col


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a global aggregate to every row; an aggregate without keys is exactly one row."""
    return df.crossJoin(F.broadcast(one_row))


def sample_points(points: DataFrame, tiles: DataFrame, zoom: int, tile_px: int = 256, nodata: int = -32768) -> DataFrame:
    """Value of the tile pixel under each point. `tiles`: z, x, y (once each), data (tile_px * tile_px little-endian 16-bit values).

    Adds x, y, row, col, `v` (NULL when the pixel is `nodata` or the tile is absent) and `tile_found`. One equi-join on the tile address;
    the two bytes of the pixel are cut out of the row that the join finds, so a raster is neither taken apart nor aggregated.
    """
    p = A.tile_pixel(C("lon"), C("lat"), F.lit(zoom))
    step = A.TILE_SIZE // tile_px
    located = points.withColumn("_p", p).select(
        *points.columns, F.lit(zoom).cast("int").alias("z"), C("_p.x").alias("x"), C("_p.y").alias("y"),
        F.floor(C("_p.py") / step).cast("int").alias("row"), F.floor(C("_p.px") / step).cast("int").alias("col"),
    )
    rasters = tiles.where(C("z") == zoom).select(C("z").cast("int").alias("z"), "x", "y", C("data").alias("_data"))
    hit = located.join(rasters, ["z", "x", "y"], "left")
    code = pixel_at(C("_data"), C("row") * tile_px + C("col"), signed=nodata < 0)
    return hit.select(*points.columns, "x", "y", "row", "col", F.nullif(code, F.lit(nodata)).alias("v"), C("_data").isNotNull().alias("tile_found"))


def pixel_at(data: Column, at: Column, signed: bool) -> Column:
    """Little-endian 16-bit value number `at` of a binary column; NULL beyond its end."""
    pair = F.hex(F.substring(data, at * 2 + 1, F.lit(2)))
    code = F.conv(F.concat(F.substring(pair, 3, 2), F.substring(pair, 1, 2)), 16, 10).cast("int")
    return F.when(code >= 32768, code - 65536).otherwise(code) if signed else code


def explode_cells(df: DataFrame, west: str, south: str, east: str, north: str, size: float) -> DataFrame:
    """One row per grid cell of `size` degrees that the box touches (columns _cx, _cy)."""
    f = lambda c: F.floor(C(c) / size).cast("int")
    return df.withColumn("_cx", F.explode(F.sequence(f(west), f(east)))) \
             .withColumn("_cy", F.explode(F.sequence(f(south), f(north))))


def _child_cells(df: DataFrame, west: str, south: str, east: str, north: str, size: float) -> DataFrame:
    """The cells of `size` that the box touches inside each (_cx, _cy) of four times that size."""
    span = lambda low, high, at: (F.greatest(F.floor(C(low) / size).cast("int"), C(at) * 4), F.least(F.floor(C(high) / size).cast("int"), C(at) * 4 + 3))
    (x0, x1), (y0, y1) = span(west, east, "_cx"), span(south, north, "_cy")
    return df.where((x0 <= x1) & (y0 <= y1)).withColumn("_nx", F.explode(F.sequence(x0, x1))).withColumn("_ny", F.explode(F.sequence(y0, y1))) \
        .drop("_cx", "_cy").withColumnsRenamed({"_nx": "_cx", "_ny": "_cy"})


def region_grid(regions: DataFrame, cell: float, bound: int, depth: int) -> list[tuple[float, DataFrame, DataFrame | None]]:
    """Regions on a grid that is finer where they crowd: (cell size, regions by cell, cells split further) per level.

    A cell crossed by the edges of more than `bound` regions is split into 4 x 4; regions that cover it whole stay with it, the others go on to
    the parts they touch. So at any place a region is in exactly one cell of one level, and a level costs what crowds there. Boxes with NULLs or
    their sides exchanged hold nothing. `depth` ends the splitting where many corners fall on one spot; it bounds the levels, not the result.
    """
    box, at, out, size = ("west", "south", "east", "north"), ["_cx", "_cy"], [], cell
    here = explode_cells(regions.where("west <= east AND south <= north"), *box, size)
    for level in range(depth + 1):
        covers = (C("west") <= C("_cx") * size) & (C("east") >= (C("_cx") + 1) * size) & (C("south") <= C("_cy") * size) & (C("north") >= (C("_cy") + 1) * size)
        crowded = None
        if level < depth:
            crowded = cut(here.where(~covers).groupBy(*at).agg(F.count("*").alias("_n")).where(C("_n") > bound).select(*at))
        if crowded is None or crowded.isEmpty():
            return [*out, (size, here, None)]
        marked = here.join(crowded.withColumn("_split", F.lit(True)), at, "left")
        out.append((size, marked.where(C("_split").isNull() | covers).drop("_split"), crowded))
        here = _child_cells(marked.where(C("_split") & ~covers).drop("_split"), *box, size / 4)
        size /= 4
    return out


# Regions whose edges may cross one grid cell, and the most often a cell is split.
CROWD, DEPTH = 256, 6


def point_regions(points: DataFrame, regions: DataFrame, cell: float = 4.0, bound: int = CROWD, depth: int = DEPTH) -> DataFrame:
    """Every (point, region) with the point inside the half-open region box. Dense regions are met on finer cells (`region_grid`)."""
    grid = region_grid(regions, cell, bound, depth)
    placed = None
    for i, (_, here, _) in enumerate(grid):
        level = here.withColumn("_lv", F.lit(i))
        placed = level if placed is None else placed.unionByName(level)
    own = F.array(*[F.struct(F.lit(i).alias("_lv"), F.floor(C("lon") / size).cast("int").alias("_cx"), F.floor(C("lat") / size).cast("int").alias("_cy"))
                    for i, (size, _, _) in enumerate(grid)])
    keyed = points.select("*", F.explode(own).alias("_own")).select(*points.columns, "_own.*")
    j = keyed.join(placed, ["_lv", "_cx", "_cy"])
    return j.where(A.bbox_contains(C("west"), C("south"), C("east"), C("north"), C("lon"), C("lat"))).drop("_lv", "_cx", "_cy")


def first_region(points: DataFrame, regions: DataFrame, key: str, cell: float = 4.0) -> DataFrame:
    """First region in priority order for each point key."""
    return point_regions(points, regions, cell).groupBy(key).agg(
        F.min_by("id", "priority").alias("region"), F.min("priority").alias("priority"))


def tile_regions(tiles: DataFrame, regions: DataFrame, cell: float = 4.0, bound: int = CROWD, depth: int = DEPTH) -> DataFrame:
    """Every (tile, region) whose open boxes intersect. Tiles carry z, x, y; one row per pair. A tile follows `region_grid` down only where it is split."""
    box = ("t_west", "t_south", "t_east", "t_north")
    here = explode_cells(tiles.withColumn("_b", A.tile_bbox_lonlat(C("x"), C("y"), C("z"))).select(
        *tiles.columns, *[C(f"_b.{b[2:]}").alias(b) for b in box]), *box, cell)
    hit = A.bbox_intersects((C("west"), C("south"), C("east"), C("north")), tuple(C(b) for b in box))
    found = None
    for size, placed, crowded in region_grid(regions, cell, bound, depth):
        # A pair meets in every shared cell; keep the meeting in the cell that holds the overlap's south-west corner.
        home = (C("_cx") == F.floor(F.greatest("west", "t_west") / size)) & (C("_cy") == F.floor(F.greatest("south", "t_south") / size))
        met = here.join(placed, ["_cx", "_cy"]).where(hit & home).drop("_cx", "_cy")
        found = met if found is None else found.unionByName(met)
        if crowded is not None:
            here = _child_cells(here.join(crowded, ["_cx", "_cy"]), *box, size / 4)
    return found


# Fixed value: how much overlap, in degrees, a source must have with a tile to count.
OVERLAP_EPS = 1e-12


def degree_candidates(df: DataFrame, top: Column, bottom: Column, left: Column, right: Column) -> DataFrame:
    """Candidate 1-degree corners (lat, lon) for a box; the ceiling row and column are included."""
    eps = OVERLAP_EPS
    span = lambda lo, hi: F.sequence(F.floor(lo - eps).cast("int"), F.ceil(hi - eps).cast("int"))
    return df.withColumn("lat", F.explode(span(bottom, top))).withColumn("lon", F.explode(span(left, right)))


def tile_source_overlap(tiles: DataFrame, sources: DataFrame) -> DataFrame:
    """(tile, degree source) pairs that overlap by more than the tolerance; equi-join on computed degree keys."""
    boxed = tiles.withColumn("_b", A.tile_bounds(C("x"), C("y"), C("z")))
    b = lambda f: C(f"_b.{f}")
    cand = degree_candidates(boxed, b("top"), b("bottom"), b("left"), b("right"))
    eps = OVERLAP_EPS
    real = (C("lat") <= b("top") - eps) & (C("lat") + 1 >= b("bottom") + eps) & \
           (C("lon") <= b("right") - eps) & (C("lon") + 1 >= b("left") + eps)
    return cand.where(real).join(sources, ["lat", "lon"]).drop("_b")


def nearest_on_axis(df: DataFrame, value: str, axis: DataFrame, idx: str, coord: str, bucket: float) -> DataFrame:
    """Add `idx`: the axis entry nearest to `value`, ties to the lower one; values outside go to the end entries.

    `axis` holds a dense 0-based index with ascending coordinates. Each entry owns the interval between the midpoints to
    its neighbours; intervals are exploded to buckets of width `bucket`, so the lookup is an equi-join at any axis size.
    """
    a = axis.select(C(idx).alias("_i"), C(coord).alias("_c"))
    below = a.select((C("_i") + 1).alias("_i"), C("_c").alias("_below"))
    above = a.select((C("_i") - 1).alias("_i"), C("_c").alias("_above"))
    own = a.join(below, "_i", "left").join(above, "_i", "left").select(
        C("_i").alias(idx), ((C("_below") + C("_c")) / 2.0).alias("_lo"), ((C("_c") + C("_above")) / 2.0).alias("_hi"),
        C("_c"))
    b = lambda c: F.floor(c / bucket).cast("int")
    own = own.withColumn("_k", F.explode(F.sequence(b(F.coalesce("_lo", "_c")), b(F.coalesce("_hi", "_c")))))
    ends = axis.agg(F.min(coord).alias("_min"), F.max(coord).alias("_max"))  # one row
    keyed = with_row(df, ends).withColumn("_v", F.greatest("_min", F.least("_max", C(value)))).withColumn("_k", b(C("_v")))
    inside = (C("_lo").isNull() | (C("_v") > C("_lo"))) & (C("_hi").isNull() | (C("_v") <= C("_hi")))
    return keyed.join(own, "_k").where(inside).drop("_k", "_v", "_lo", "_hi", "_c", "_min", "_max")


def sample_with_fallback(points: DataFrame, regions: DataFrame, source_values: DataFrame, cached: DataFrame,
                         key: str) -> DataFrame:
    """First region in priority order that has a value; a cached tile only where some source failed.

    `source_values`: (key, priority, v, failed); `cached`: (key, cached_v) - present when a tile covers the point.
    """
    tried = point_regions(points, regions).select(key, "priority", "id").join(source_values, [key, "priority"], "left")
    usable = C("v").isNotNull() & ~F.coalesce("failed", F.lit(True))
    first = tried.groupBy(key).agg(
        F.min_by(F.when(usable, F.struct(C("v"), C("id"))), F.when(usable, C("priority"))).alias("_hit"),
        F.min_by("id", "priority").alias("_first_id"),
        F.max(F.coalesce("failed", F.lit(True))).alias("_any_failed"))
    j = points.select(key).join(first, key, "left").join(cached, key, "left")
    direct, fall = C("_hit").isNotNull(), C("_any_failed") & C("cached_v").isNotNull()
    return j.select(
        key,
        F.when(direct, C("_hit.v")).when(fall, C("cached_v")).alias("v"),
        F.when(direct, C("_hit.id")).when(fall, C("_first_id")).alias("region"),
        F.when(direct, "source").when(fall, "cache").when(C("_first_id").isNull(), "outside").otherwise("no-data").alias("origin"),
    )


def coverage_gaps(expected: DataFrame, features: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tiles that carry vector features but no elevation."""
    on = ["z", "x", "y"]
    return expected.join(features, on, "left_semi").join(tiles, on, "left_anti")


def missing_sources(gaps: DataFrame, present: DataFrame) -> DataFrame:
    """For every gap tile, the candidate degree sources that are not present."""
    boxed = gaps.withColumn("_b", A.tile_bounds(C("x"), C("y"), C("z")))
    b = lambda f: C(f"_b.{f}")
    cand = degree_candidates(boxed, b("top"), b("bottom"), b("left"), b("right")).drop("_b")
    return cand.join(present, ["lat", "lon"], "left_anti").withColumn("source_id", A.degree_tile_id(C("lat"), C("lon")))


def raster_pair(a: DataFrame, b: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Cell-by-cell pairing of two rasters on the same grid (columns a, b)."""
    return a.select(*keys, C(value).alias("a")).join(b.select(*keys, C(value).alias("b")), keys, "full")


# Degrees of the first grid and of the finest one (about a metre, where rounding of distances begins to count).
FIRST_CELL, LAST_CELL = 15.0, 5e-6


def far_pairs(places: DataFrame, top: int, key: str = "id", pairs_per_place: int = 8) -> DataFrame:
    """The `top` most distant ordered pairs of places (key, lon, lat), without forming all pairs.

    Places are counted per grid cell. For two cells the distance of any two members lies within centre distance
    plus or minus both cell radii, so the cell pairs that surely hold `top` pairs give a floor and every cell pair whose
    ceiling is under that floor is dropped. Survivors are split into 8 x 8 finer cells, and places outside of them leave, until the pairs of
    places in surviving cells are at most `pairs_per_place` times the places (or a million); only those are compared. So dense towns
    are split further and thin tables stop early. Of places at one and the same spot only the first `top` keys can appear in the
    answer, so copies beyond that are left out first. Exact: nothing is dropped that could reach the answer. Places without a
    coordinate are in no pair.
    """
    def cell(size: float) -> Column:
        return F.struct(F.floor((C("lat") + 90.0) / size).alias("r"), F.floor((C("lon") + 180.0) / size).alias("c"))

    side = lambda df, tag: df.select(*[C(c).alias(c + tag) for c in df.columns])
    whole = places.select(C(key).alias("_id"), "lon", "lat").where("lon IS NOT NULL AND lat IS NOT NULL")
    named = cut(Ordered(whole, ["lon", "lat"], ["_id"]).running_total(F.lit(1), "_k").result().where(C("_k") <= top).select("_id", "lon", "lat"))
    enough = max(1_000_000, pairs_per_place * named.count())
    size, survivors = FIRST_CELL, None
    while True:
        # eight is a power of two, so a cell lies in the one whose numbers are its own shifted by three bits, exactly
        up = F.struct(F.shiftright("_c.r", 3).alias("r"), F.shiftright("_c.c", 3).alias("c"))
        counts = named.groupBy(cell(size).alias("_c")).agg(F.count("*").alias("_n")).withColumn("_up", up)
        if survivors is None:
            # the first grid has a fixed number of cells, whatever the table size
            every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n // size) + 1)).cast("array<bigint>"))
            pairs = side(counts, "a").withColumn("_r", every(180)).withColumn("_l", every(360)) \
                .withColumn("_cb", F.struct(C("_r").alias("r"), C("_l").alias("c"))).join(side(counts, "b"), "_cb")
        else:
            pairs = survivors.join(side(counts, "a"), "_upa").join(side(counts, "b"), "_upb")
        center = lambda c: ((C(f"{c}.c") + 0.5) * size - 180.0, (C(f"{c}.r") + 0.5) * size - 90.0)
        (lon_a, lat_a), (lon_b, lat_b) = center("_ca"), center("_cb")
        reach = 2.0 * 0.7072 * size * 111.2 + 0.001  # both cell radii in km, rounded up, and a metre for rounding
        step = min(1.0, reach / 8)
        pairs = pairs.withColumn("_km", haversine_km_atan(lon_a, lat_a, lon_b, lat_b)) \
            .withColumn("_m", F.when(C("_ca") == C("_cb"), C("_na") * (C("_na") - 1)).otherwise(C("_na") * C("_nb"))).where("_m > 0")
        pairs = cut(pairs.select("_ca", "_cb", "_km", "_m"))
        # floor: the largest distance step that `top` pairs surely reach; the steps keep the ladder short
        ladder = pairs.groupBy(F.floor((C("_km") - reach) / step).alias("_step")).agg(F.sum("_m").alias("_m"))
        down = Ordered(ladder.withColumn("_rank", -C("_step")), [], ["_rank"]).running_total("_m", "_upto").result()
        floor_km = down.where(C("_upto") >= top).agg((F.max("_step") * step).alias("_floor"))
        kept = cut(with_row(pairs, floor_km).where(C("_floor").isNull() | (C("_km") + reach >= C("_floor"))).select("_ca", "_cb", "_m"))
        left = kept.agg(F.sum("_m").alias("_m")).first()["_m"] or 0
        inside = kept.select(C("_ca").alias("_c")).distinct()  # pairs come in both orders, so one side names all cells
        named = cut(named.withColumn("_c", cell(size)).join(inside, "_c", "left_semi"))
        if left <= enough or size / 8 < LAST_CELL:
            break
        survivors, named, size = kept.select(C("_ca").alias("_upa"), C("_cb").alias("_upb")), named.drop("_c"), size / 8
    a, b = side(named, "a"), side(named, "b")
    exact = kept.join(a, "_ca").join(b, "_cb").where(C("_ida") != C("_idb"))
    km = haversine_km_atan(C("lona"), C("lata"), C("lonb"), C("latb"))
    return exact.select(C("_ida").alias("from_id"), C("_idb").alias("to_id"), km.alias("km")) \
        .orderBy(F.desc("km"), "from_id", "to_id").limit(top)


def named_pairs(pairs: DataFrame, places: DataFrame, key: str = "id") -> DataFrame:
    """Distances of requested (from_id, to_id) pairs; `known` is false when either id is not in the catalogue."""
    end = lambda tag: places.select(C(key).alias(f"{tag}_id"), C("lon").alias(f"{tag}_lon"), C("lat").alias(f"{tag}_lat"))
    j = pairs.join(end("from"), "from_id", "left").join(end("to"), "to_id", "left")
    km = haversine_km_atan(C("from_lon"), C("from_lat"), C("to_lon"), C("to_lat"))
    return j.select("from_id", "to_id", km.alias("km"), (C("from_lon").isNotNull() & C("to_lon").isNotNull()).alias("known"))


def catalog_lookup(requests: DataFrame, catalog: DataFrame, on: list[str]) -> DataFrame:
    """Case-insensitive key lookup."""
    low = lambda df: df.select("*", *[F.lower(c).alias(f"_k_{c}") for c in on])
    return low(requests).drop(*on).join(low(catalog), [f"_k_{c}" for c in on]).drop(*[f"_k_{c}" for c in on])


def related_places(catalog: DataFrame, key: str, related: str, columns: list[str]) -> DataFrame:
    """Existing related entries of every entry, in list order (column `rank`); unknown keys drop out."""
    listed = catalog.select(C(key), F.posexplode(related).alias("rank", "_other")).withColumn("_o", F.lower("_other"))
    other = catalog.select(F.lower(key).alias("_o"), *[C(c).alias(f"related_{c}") for c in columns])
    return listed.join(other, "_o").drop("_o", "_other")


def select_flowlines(lines: DataFrame, min_order: int) -> DataFrame:
    """Named or high-order lines inside the network; the network rule is dropped when nothing would remain."""
    named = C("name").isNotNull() | (F.coalesce("stream_order", F.lit(0)) >= min_order)
    network = F.coalesce("in_network", F.lit(0)) == 1
    chosen = lines.where(named).withColumn("_net", network)
    any_net = chosen.agg(F.coalesce(F.bool_or("_net"), F.lit(False)).alias("_any"))
    return with_row(chosen, any_net).where(C("_net") | ~C("_any")).drop("_net", "_any") \
        .withColumn("label", F.coalesce("name", "ftype", F.lit("Mapped drainage")))


def neighbor_any(cells: DataFrame, masks: dict[str, Column], block: int = 256) -> DataFrame:
    """For each mask: is it set in any of the 8 neighbours? Outside the grid counts as not set. (row, col) is unique.

    All masks travel as bits of one layer in blocks, which send only their border cells to each other; no cell is fanned out.
    """
    bits = F.lit(0)
    for i, m in enumerate(masks.values()):
        bits = bits + F.when(m, 1 << i).otherwise(0)
    names = list(masks)

    def near(b: dict) -> dict[str, bytes]:
        z = np.nan_to_num(D._padded(b, "_bits", block, 0.0)).astype(np.int64)
        found = np.zeros((block, block), dtype=np.int64)
        for dr, dc in D.STEPS.values():
            found |= z[1 + dr:block + 1 + dr, 1 + dc:block + 1 + dc]
        return {n: ((found >> i) & 1).astype(bool).tobytes() for i, n in enumerate(names)}

    packed = D.to_blocks(cells.select("row", "col", bits.cast("double").alias("_bits")), block, {"_bits": "real"})
    flagged = D._add(D._with_ring(written(packed), block, "_bits"), near, names)
    found = D.to_cells(flagged, block, {"_bits": "real", **{n: "flag" for n in names}}, where="_bits").drop("_bits")
    return cells.join(found.hint("merge"), ["row", "col"])  # packed blocks look small, their cells are not


def tile_edge_alignment(cells: DataFrame, last_col: int, tolerance: int = 5) -> DataFrame:
    """Share of valid cell pairs within tolerance across each vertical tile border."""
    right_edge = cells.where(C("col") == last_col).select("z", "y", "row", C("x"), C("v").alias("_a"))
    left_edge = cells.where(C("col") == 0).select("z", "y", "row", (C("x") - 1).alias("x"), C("v").alias("_b"))
    pairs = right_edge.join(left_edge, ["z", "x", "y", "row"]).where("_a IS NOT NULL AND _b IS NOT NULL")
    near = F.count_if(F.abs(C("_a") - C("_b")) <= tolerance)
    return pairs.groupBy("z", "x", "y").agg(F.count("*").alias("pairs"), (near / F.count("*")).alias("aligned")) \
        .withColumn("passed", C("aligned") >= 0.9)
