"""Row generators: covers, neighbourhoods, prefetch lists, line samples. All are `explode` over `sequence`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.functions import geodesy as G
from tilewater.operators.ordered import Ordered

C = F.col


def tile_pixel_centers(tiles: DataFrame, size: int = 256) -> DataFrame:
    """Mercator coordinates (cx, cy) of every pixel centre of every tile."""
    span = F.lit(2.0 * A.HALF_WORLD_M) / A.scale_of(C("z"))
    idx = F.sequence(F.lit(0), F.lit(size - 1))
    return tiles.withColumn("row", F.explode(idx)).withColumn("col", F.explode(idx)) \
        .withColumn("cx", C("x") * span - A.HALF_WORLD_M + (C("col") + 0.5) * span / size) \
        .withColumn("cy", F.lit(A.HALF_WORLD_M) - C("y") * span - (C("row") + 0.5) * span / size)


def bbox_tile_cover(boxes: DataFrame, zmin: int, zmax: int, margin: int = 0) -> DataFrame:
    """Inclusive tile cover of (west, south, east, north) boxes for zmin..zmax, clamped to the map unless grown."""
    z = C("z")
    ranged = boxes.withColumn("z", F.explode(F.sequence(F.lit(zmin), F.lit(zmax))))
    if margin:
        x0, x1 = A.tile_x(C("west"), z), A.tile_x(C("east"), z)
        y0, y1 = A.tile_y(C("north"), z), A.tile_y(C("south"), z)
        lo = lambda a, b: F.greatest(F.lit(0), F.least(a, b) - margin)
        hi = lambda a, b: F.greatest(a, b) + margin
    else:
        west, east = A.clip_lon(C("west")), A.clip_lon(C("east"))
        x0, x1 = A.tile_x_floor(west, z), A.tile_x_floor(east, z)
        y0, y1 = A.tile_y_floor(C("north"), z), A.tile_y_floor(C("south"), z)
        lo, hi = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    return ranged.withColumn("x", F.explode(F.sequence(lo(x0, x1), hi(x0, x1)))) \
                 .withColumn("y", F.explode(F.sequence(lo(y0, y1), hi(y0, y1))))


def expected_degree_tiles(boxes: DataFrame) -> DataFrame:
    """Degree tiles whose square meets the box, from floor to floor; corner order does not matter."""
    span = lambda a, b: F.sequence(F.floor(F.least(a, b)).cast("int"), F.floor(F.greatest(a, b)).cast("int"))
    return boxes.withColumn("lat", F.explode(span(C("south"), C("north")))) \
                .withColumn("lon", F.explode(span(C("west"), C("east"))))


# Named source areas, as (lat range, lon range) of degree tiles, both ends included.
AREA_PRESETS = {
    "miami": ((25, 25), (-81, -80)),
    "new_orleans": ((29, 30), (-90, -90)),
    "houston": ((29, 30), (-95, -95)),
    "nyc": ((40, 41), (-74, -74)),
    "gulf_coast": ((25, 30), (-98, -82)),
}
# Named audit boxes (west, south, east, north).
BOX_PRESETS = {
    "conus": (-125.0, 24.0, -66.0, 50.0),
    "florida": (-88.0, 24.0, -79.0, 31.0),
    "miami": (-81.0, 25.0, -79.0, 26.5),
}


def _preset_array(presets: dict) -> Column:
    return F.array(*[
        F.struct(F.lit(name).alias("area"), *[F.lit(v).alias(n) for n, v in zip(("lat0", "lat1", "lon0", "lon1"), lats + lons)])
        for name, (lats, lons) in presets.items()])


def region_presets(tiles: DataFrame) -> DataFrame:
    """Tag (lat, lon) degree tiles with every named area that lists them."""
    p = C("p")
    return tiles.withColumn("p", F.explode(_preset_array(AREA_PRESETS))).where(
        C("lat").between(p["lat0"], p["lat1"]) & C("lon").between(p["lon0"], p["lon1"])
    ).select(*tiles.columns, p["area"].alias("area"))


def tile_neighborhood(tiles: DataFrame, radius: int) -> DataFrame:
    """The (2r+1)^2 tiles around each tile; x wraps, y is clamped; offsets kept as dx, dy."""
    d = F.sequence(F.lit(-radius), F.lit(radius))
    return tiles.withColumn("dy", F.explode(d)).withColumn("dx", F.explode(d)) \
        .withColumn("nx", A.wrap_x(C("x") + C("dx"), C("z"))).withColumn("ny", A.clamp_y(C("y") + C("dy"), C("z")))


# Prefetch rules.
PRELOAD_ZOOMS = (8, 14)
PRELOAD_LIMIT = 20
LEVEL_STEPS = (0.5, -0.5, 1.0, -1.0)
LEVEL_RANGE = (-10.0, 50.0)


def predict_tiles(requests: DataFrame, key: str, pan: Column | None = None) -> DataFrame:
    """Prefetch list per request: ring of 8, 4 children, parent, 4 water levels, then `pan` (struct<x,y>, may be NULL).

    The first 17 differ from each other and from the request by construction (other tile, or a level half a metre away),
    so only the pan tile can repeat: it does when it is the request itself or in the ring. The list never exceeds
    20 entries and is built inside the row, so nothing is shuffled.
    """
    z, x, y, w = C("z"), C("x"), C("y"), C("water_level_m")
    item = lambda cz, cx, cy, cw: F.struct(cz.cast("int").alias("pz"), cx.cast("int").alias("px"), cy.cast("int").alias("py"), cw.alias("pw"))
    tile = lambda cz, cx, cy, ok=F.lit(True): F.when(ok & A.tile_valid(cz, cx, cy, *PRELOAD_ZOOMS), item(cz, cx, cy, w))
    items = [tile(z, x + dx, y + dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]
    items += [tile(z + 1, x * 2 + dx, y * 2 + dy, z < PRELOAD_ZOOMS[1]) for dx in (0, 1) for dy in (0, 1)]
    items += [tile(z - 1, A.ancestor(x, 1), A.ancestor(y, 1), z > PRELOAD_ZOOMS[0])]
    # water-level variants keep the tile as requested, valid zoom or not
    items += [F.when((w + s).between(*LEVEL_RANGE), item(z, x, y, w + s)) for s in LEVEL_STEPS]
    if pan is not None:
        far = F.greatest(F.abs(pan["x"] - x), F.abs(pan["y"] - y)) > 1
        items.append(tile(z, pan["x"], pan["y"], pan.isNotNull() & far))
    return requests.select(key, F.posexplode(F.array_compact(F.array(*items))).alias("rank", "p")) \
        .where(C("rank") < PRELOAD_LIMIT).select(key, "rank", "p.pz", "p.px", "p.py", "p.pw")


# Viewport prefetch rules.
MAX_PREFETCH = 24
STAGE_ZOOM = 7
FAR_KM, NEAR_KM, ZOOM_DELTA, REFINE_DELTA = 250.0, 75.0, 2.25, 0.35


def _located(views: DataFrame, width: int, height: int) -> DataFrame:
    """Add z, the viewport's tile range (_x0.._x1, _y0.._y1), its centre in tiles (_cx, _cy) and the tiles per side (_n)."""
    w, h = max(256, width), max(256, height)
    edge = lambda c, off: F.floor((C(f"_w.{c}") + off) / 256.0).cast("int")
    return views.withColumn("z", F.greatest(F.lit(0), F.floor(C("zoom")).cast("int"))) \
        .withColumn("_w", G.world_pixel(C("lon"), C("lat"), C("z"))).withColumns({
            "_x0": edge("wx", -w / 2.0), "_x1": edge("wx", w / 2.0 - 1.0), "_y0": edge("wy", -h / 2.0), "_y1": edge("wy", h / 2.0 - 1.0),
            "_cx": C("_w.wx") / 256.0, "_cy": C("_w.wy") / 256.0, "_n": A.scale_of(C("z")).cast("int")})


def _viewport_array(padding: int) -> Column:
    """Sorted array<struct<distance,y,x,z,visible>> of the tiles that a located viewport, grown by `padding`, touches.

    A view touches a bounded number of tiles, so the list is built and sorted inside its row: no explode, no shuffle.
    """
    xs, ys = F.sequence(C("_x0") - padding, C("_x1") + padding), F.sequence(C("_y0") - padding, C("_y1") + padding)
    core = lambda tx, ty: (tx >= C("_x0")) & (tx <= C("_x1")) & (ty >= C("_y0")) & (ty <= C("_y1"))
    tile = lambda tx, ty: F.struct(F.hypot(tx - C("_cx"), ty - C("_cy")).alias("distance"), ty.alias("y"), F.pmod(tx, C("_n")).alias("x"),
                                   C("z").alias("z"), (core(tx, ty) if padding else F.lit(True)).alias("visible"))
    rows = F.filter(ys, lambda ty: (ty >= 0) & (ty < C("_n")))
    return F.array_sort(F.flatten(F.transform(rows, lambda ty: F.transform(xs, lambda tx: tile(tx, ty)))))


def _listed(df: DataFrame, key: str, tiles: Column) -> DataFrame:
    return df.select(key, F.posexplode(tiles).alias("rank", "t")).select(key, "rank", "t.z", "t.x", "t.y", "t.distance")


def viewport_tiles(views: DataFrame, key: str, width: int, height: int, padding: int = 0, limit: int = MAX_PREFETCH) -> DataFrame:
    """The `limit` nearest tiles a viewport touches in (distance, y, x) order. `views` carries lon, lat, zoom (double)."""
    return _listed(_located(views, width, height), key, F.slice(_viewport_array(padding), 1, max(1, limit)))


def viewport_ring(views: DataFrame, key: str, width: int, height: int, limit: int = MAX_PREFETCH) -> DataFrame:
    """Tiles of the viewport grown by one that are not visible, nearest first."""
    count = (C("_x1") - C("_x0") + 1) * (C("_y1") - C("_y0") + 1)
    # the index range tells visible tiles apart unless a row of tiles wraps onto itself or the visible list was cut
    plain = (C("_n") >= C("_x1") - C("_x0") + 3) & (count <= limit * 3)
    d = _located(views, width, height).withColumn("_plain", plain).withColumn("_more", F.slice(_viewport_array(1), 1, limit * 4)) \
        .withColumn("_seen", F.when(~C("_plain"), F.slice(_viewport_array(0), 1, limit * 3)))
    listed = lambda t: F.exists("_seen", lambda s: (s["x"] == t["x"]) & (s["y"] == t["y"]))
    ring = F.when(C("_plain"), F.filter("_more", lambda t: ~t["visible"])).otherwise(F.filter("_more", lambda t: ~listed(t)))
    return _listed(d, key, F.slice(ring, 1, limit))


def jump_decision(df: DataFrame) -> DataFrame:
    """Distance / zoom-change rule. Needs lon, lat, zoom (from) and to_lon, to_lat, to_zoom."""
    km = G.haversine_km(C("lon"), C("lat"), C("to_lon"), C("to_lat"))
    delta = F.abs(C("to_zoom") - C("zoom"))
    staged = (C("distance_km") >= FAR_KM) | ((C("distance_km") >= NEAR_KM) & (C("zoom_delta") >= ZOOM_DELTA))
    stage = F.greatest(F.lit(0), F.least(F.lit(STAGE_ZOOM), F.floor(C("to_zoom")).cast("int")))
    return df.withColumn("distance_km", km).withColumn("zoom_delta", delta).withColumn("staged", staged) \
        .withColumn("stage_zoom", stage).withColumn("refine", C("to_zoom") - C("stage_zoom") > REFINE_DELTA)


def jump_plan(df: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Prefetch list at the stage zoom for every jump that is staged."""
    staged = jump_decision(df).where("staged").select(
        key, C("to_lon").alias("lon"), C("to_lat").alias("lat"), C("stage_zoom").cast("double").alias("zoom"))
    return viewport_tiles(staged, key, width, height)


def cells_from_tile(tiles: DataFrame, values: str, width: int) -> DataFrame:
    """Array column -> (row, col, v)."""
    keep = [c for c in tiles.columns if c != values]
    return tiles.select(*keep, F.posexplode(values).alias("_k", "v")).select(
        *keep, F.floor(C("_k") / width).cast("int").alias("row"), (C("_k") % width).cast("int").alias("col"), "v")


def line_sample_points(lines: DataFrame, key: str, points: str, spacing: float) -> DataFrame:
    """Evenly spaced points along polylines given as array<struct<x,y>>; at least the two ends. `key` names one line each.

    Segments become rows, lengths run along a line by `Ordered`, and a segment makes the samples between its start and its end itself, so the
    work is linear in vertices and samples and one long line is spread over many tasks. Lines without length have no samples.
    """
    ends = F.zip_with(
        F.slice(C(points), 1, F.size(points) - 1), F.slice(C(points), 2, F.size(points) - 1),
        lambda a, b: F.struct(a["x"].alias("_x0"), a["y"].alias("_y0"), b["x"].alias("_x1"), b["y"].alias("_y1")))
    segments = lines.where(F.size(points) >= 2).select(key, F.posexplode(ends).alias("_i", "_s")).select(
        key, "_i", "_s.*", F.hypot(C("_s._x1") - C("_s._x0"), C("_s._y1") - C("_s._y0")).alias("_len")).where("_len > 0")
    run = Ordered(segments, [key], ["_i"]).running_total("_len", "_hi").previous(["_hi"], "_before").result()
    whole = run.groupBy(key).agg(F.max_by("_hi", "_i").alias("_total"), F.max("_i").alias("_last")) \
        .withColumn("_n", F.greatest(F.lit(2), F.floor(C("_total") / spacing).cast("int") + 1))
    at = lambda k: C("_total") * k / (C("_n") - 1)
    # sample numbers around the segment's share; the distance itself then decides, by the same expression in both neighbours
    first = F.greatest(F.lit(0), F.floor(C("_lo") / C("_total") * (C("_n") - 1)).cast("int") - 1)
    last = F.when(C("_i") == C("_last"), C("_n") - 1).otherwise(F.least(C("_n") - 1, F.ceil(C("_hi") / C("_total") * (C("_n") - 1)).cast("int") + 1))
    owned = (C("_d") >= C("_lo")) & ((C("_d") < C("_hi")) | (C("_i") == C("_last")))
    samples = run.withColumn("_lo", F.coalesce("_before._hi", F.lit(0.0))).join(whole, key).withColumn("k", F.explode(F.sequence(first, last))) \
        .withColumn("_d", at(C("k"))).where(owned).withColumn("_f", (C("_d") - C("_lo")) / C("_len"))
    return samples.select(key, "k", (C("_x0") + (C("_x1") - C("_x0")) * C("_f")).alias("x"), (C("_y0") + (C("_y1") - C("_y0")) * C("_f")).alias("y"))


# The job stages of a region build, in order.
BUILD_STAGES = ("download_verify_inputs", "compute_hand", "write_source_cog", "precompute_cache", "qa_metrics")


def build_plan_rows(regions: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Region x stage job rows; a literal array per row instead of a cross join."""
    chosen = regions.where(C("id").isin(wanted)) if wanted is not None else regions
    return chosen.select("*", F.posexplode(F.array(*[F.lit(s) for s in BUILD_STAGES])).alias("step", "stage"))
