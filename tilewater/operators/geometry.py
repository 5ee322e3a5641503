"""Polygons on rasters: scan-line rasterising, ring roles, clipping, line-polygon intersection.

Polygons are rows of rings (array<struct<x,y>>, closed). Rasterising works edge by edge: an edge is exploded over the
rows it crosses and the crossings of a row are paired in x order, so the cost follows the outline and the filled
cells, never polygons times cells. Coordinates are in cell units: cell (row, col) covers [col, col+1) x [row, row+1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewater.operators.joins import explode_cells, with_row
from tilewater.session import written

C = F.col


def edges(rings: DataFrame, points: str = "pts") -> DataFrame:
    """One row per ring edge (x0, y0, x1, y1); the ring columns are kept."""
    keep = [c for c in rings.columns if c != points]
    pair = F.zip_with(F.slice(C(points), 1, F.size(points) - 1), F.slice(C(points), 2, F.size(points) - 1),
                      lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))
    return rings.select(*keep, F.explode(pair).alias("_e")).select(*keep, "_e.*")


def _x_at(y: Column) -> Column:
    return C("x0") + (y - C("y0")) * (C("x1") - C("x0")) / (C("y1") - C("y0"))


def outlines(rings: DataFrame) -> DataFrame:
    """Rings that bound an area: at least four points, the first one repeated at the end."""
    return rings.where(F.size("pts") >= 4)


def polygon_spans(rings: DataFrame, key: str, all_touched: bool = False) -> DataFrame:
    """Runs of cells (key, row, c0, c1) whose centres lie in the polygon, over all its rings (even-odd, so holes and islands work).

    `all_touched` adds every cell an edge meets; then runs may overlap (see `apart`). Rings of fewer than four points are left out.
    """
    e = edges(outlines(rings).select(key, "pts"))
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    # centre of row r is r + 0.5; an edge owns the centres in [low, high)
    first, last = F.ceil(low - 0.5).cast("int"), (F.ceil(high - 0.5) - 1).cast("int")
    crossed = e.withColumn("_f", first).withColumn("_l", last).where("_f <= _l") \
        .withColumn("row", F.explode(F.sequence("_f", "_l"))).select(key, "row", _x_at(C("row") + 0.5).alias("x"))
    w = Window.partitionBy(key, "row").orderBy("x")  # the crossings of one row of one outline
    pairs = crossed.withColumn("_n", F.row_number().over(w)).withColumn("_to", F.lead("x").over(w)).where("_n % 2 = 1 AND _to IS NOT NULL")
    inner = pairs.select(key, "row", F.ceil(C("x") - 0.5).cast("int").alias("c0"), (F.ceil(C("_to") - 0.5) - 1).cast("int").alias("c1")).where("c0 <= c1")
    if not all_touched:
        return inner
    rows = e.withColumn("row", F.explode(F.sequence(F.floor(low).cast("int"), F.floor(high).cast("int"))))
    flat = C("y0") == C("y1")
    ya, yb = F.greatest(low, C("row").cast("double")), F.least(high, C("row") + 1.0)
    xa, xb = F.when(flat, C("x0")).otherwise(_x_at(ya)), F.when(flat, C("x1")).otherwise(_x_at(yb))
    touched = rows.select(key, "row", F.floor(F.least(xa, xb)).cast("int").alias("c0"), F.floor(F.greatest(xa, xb)).cast("int").alias("c1"))
    return inner.unionByName(touched)


def apart(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, c0, c1) cut back to what no earlier run of the same keys holds, so that no cell is told twice."""
    before = Window.partitionBy(*keys).orderBy("c0", "c1").rowsBetween(Window.unboundedPreceding, -1)
    start = F.greatest(C("c0"), F.max("c1").over(before) + 1)  # greatest passes over the NULL of the first run
    return spans.select(*keys, start.alias("c0"), "c1").where("c0 <= c1")


def _cells(spans: DataFrame, keys: list[str]) -> DataFrame:
    return spans.select(*keys, F.explode(F.sequence("c0", "c1")).alias("col"))


def polygon_cells(rings: DataFrame, key: str, all_touched: bool = False) -> DataFrame:
    """Cells (key, row, col) of `polygon_spans`, each once. Runs are parted before they become cells, so cells are never shuffled."""
    spans = polygon_spans(rings, key, all_touched)
    return _cells(apart(spans, [key, "row"]) if all_touched else spans, [key, "row"])


def covered_cells(rings: DataFrame, key: str, all_touched: bool = False) -> DataFrame:
    """Cells (row, col) of any polygon, each once."""
    return _cells(apart(polygon_spans(rings, key, all_touched), ["row"]), ["row"])


def signed_area(points: Column) -> Column:
    """Shoelace area of a closed ring; negative when clockwise."""
    pairs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1),
                       lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v) / 2.0


def _crossings(points: Column, y: Column) -> Column:
    """x of the ring's crossings with a horizontal line. `y` must be a stored column: it is looked up for every vertex."""
    xs = F.zip_with(F.slice(points, 1, F.size(points) - 1), F.slice(points, 2, F.size(points) - 1), lambda a, b: F.when(
        ((a["y"] <= y) & (y < b["y"])) | ((b["y"] <= y) & (y < a["y"])), a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"])))
    return F.filter(xs, lambda v: v.isNotNull())


def middle(points: Column) -> Column:
    """Mid height of a ring."""
    ys = F.transform(points, lambda p: p["y"])
    return (F.array_min(ys) + F.array_max(ys)) / 2.0


def point_in_ring(points: Column, x: Column, y: Column) -> Column:
    return F.size(F.filter(_crossings(points, y), lambda v: v > x)) % 2 == 1


def polygon_rings(rings: DataFrame, feature: str, cell: float = 8.0) -> DataFrame:
    """Role of each ring (feature, pos, pts): clockwise rings are outers, others are holes of the first outer that holds them.

    Rings of fewer than four points drop out. Without any outer all rings are outers. A hole outside every outer is
    `loose`. Candidates meet on grid cells of the outer's box, so holes are not paired with all outers.
    """
    # measured once and written, as roles, outers and holes each read it
    sized = written(rings.select(feature, "pos", "pts").withColumn("area", signed_area(C("pts"))))
    any_outer = sized.groupBy(feature).agg(F.bool_or((F.size("pts") >= 4) & (C("area") < 0)).alias("_any"))
    j = sized.join(any_outer, feature).where(~C("_any") | (F.size("pts") >= 4)).withColumn("_outer", ~C("_any") | (C("area") < 0))
    xs, ys = F.transform("pts", lambda p: p["x"]), F.transform("pts", lambda p: p["y"])
    outers = j.where("_outer").select(feature, "pos", "area", "pts", F.array_min(xs).alias("west"), F.array_max(xs).alias("east"),
                                      F.array_min(ys).alias("south"), F.array_max(ys).alias("north"))
    # a point inside each hole: middle of the first span on the line through its mid height
    level = written(j.where(~C("_outer")).select(feature, "pos", "area", "pts", middle(C("pts")).alias("_py")))
    spans = written(level.select(feature, "pos", "area", "_py", F.sort_array(_crossings(C("pts"), C("_py"))).alias("_xs")))
    holes = spans.select(feature, C("pos").alias("hole_pos"), C("area").alias("hole_area"), ((F.get("_xs", F.lit(0)) + F.get("_xs", F.lit(1))) / 2.0).alias("_px"), "_py") \
        .withColumn("_cx", F.floor(C("_px") / cell).cast("int")).withColumn("_cy", F.floor(C("_py") / cell).cast("int"))
    gridded = explode_cells(outers, "west", "south", "east", "north", cell)
    boxed = C("_px").between(C("west"), C("east")) & C("_py").between(C("south"), C("north"))
    owner = holes.join(gridded, [feature, "_cx", "_cy"]).where(boxed).where(point_in_ring(C("pts"), C("_px"), C("_py"))) \
        .groupBy(feature, "hole_pos").agg(F.min("pos").alias("outer_pos"))
    owned = holes.join(owner, [feature, "hole_pos"], "left").select(
        feature, C("hole_pos").alias("pos"), F.when(C("outer_pos").isNull(), "loose").otherwise("hole").alias("role"), "outer_pos", C("hole_area").alias("area"))
    return outers.select(feature, "pos", F.lit("outer").alias("role"), C("pos").alias("outer_pos"), "area").unionByName(owned)


def clip_to_polygon(cells: DataFrame, rings: DataFrame, key: str) -> DataFrame:
    """Cells the polygons touch, re-based so that the used extent starts at (0, 0)."""
    kept = cells.join(covered_cells(rings, key, all_touched=True), ["row", "col"], "left_semi")
    origin = kept.agg(F.min("row").alias("_r0"), F.min("col").alias("_c0"))
    return with_row(kept, origin).withColumn("row", C("row") - C("_r0")).withColumn("col", C("col") - C("_c0")).drop("_r0", "_c0")


def lines_meeting(lines: DataFrame, line: str, rings: DataFrame, key: str, cell: float = 8.0) -> DataFrame:
    """Ids of the lines (array<struct<x,y>> `pts`) that meet any polygon; all ids when none does.

    A line meets a polygon when a segment crosses an edge or its first vertex lies inside. Segments and edges meet on
    grid cells, each distinct one once; the vertex test takes the distinct polygons whose box holds the vertex and counts their edges to its right.
    Tables of distinct shapes pack well and look small to Spark, so joins are merged and nothing passes through the driver.
    """
    box = lambda d: d.withColumn("west", F.least("x0", "x1")).withColumn("east", F.greatest("x0", "x1")) \
        .withColumn("south", F.least("y0", "y1")).withColumn("north", F.greatest("y0", "y1"))
    e = box(edges(outlines(rings).select(key, "pts")))
    s = edges(lines.select(line, "pts"))
    ren = lambda d, p: d.select(*[C(c).alias(p + c) if c in ("x0", "y0", "x1", "y1") else C(c) for c in d.columns]).drop("west", "east", "south", "north")
    at = ["x0", "y0", "x1", "y1"]
    # equal segments, edges, first vertices and outlines are met once, however many lines and polygons have them
    a = ren(explode_cells(box(s.select(*at).distinct()), "west", "south", "east", "north", cell), "s")
    b = ren(explode_cells(box(e.select(*at).distinct()), "west", "south", "east", "north", cell), "e")
    side = lambda px, py, qx, qy, rx, ry: (C(qx) - C(px)) * (C(ry) - C(py)) - (C(qy) - C(py)) * (C(rx) - C(px))
    d1, d2 = side("ex0", "ey0", "ex1", "ey1", "sx0", "sy0"), side("ex0", "ey0", "ex1", "ey1", "sx1", "sy1")
    d3, d4 = side("sx0", "sy0", "sx1", "sy1", "ex0", "ey0"), side("sx0", "sy0", "sx1", "sy1", "ex1", "ey1")
    crossed = written(a.join(b.hint("merge"), ["_cx", "_cy"]).where((d1 * d2 <= 0) & (d3 * d4 <= 0)).select(*[C("s" + c).alias(c) for c in at]).distinct())
    crossing = s.join(crossed.hint("merge"), at, "left_semi").select(line)
    first = lines.select(line, C("pts")[0]["x"].alias("_px"), C("pts")[0]["y"].alias("_py"))
    start = first.select("_px", "_py").distinct() \
        .withColumn("_cx", F.floor(C("_px") / cell).cast("int")).withColumn("_cy", F.floor(C("_py") / cell).cast("int"))
    # an outline is known by its box and 128 bits of its edges; edges told twice cancel out, as they do in the parity
    bits = [F.bit_xor(F.xxhash64(F.lit(i), *at)).alias(f"_h{i}") for i in range(2)]
    outline = e.groupBy(key).agg(F.min("west").alias("west"), F.max("east").alias("east"), F.min("south").alias("south"), F.max("north").alias("north"), *bits)
    outline = written(outline.groupBy("west", "east", "south", "north", "_h0", "_h1").agg(F.min(key).alias(key)))
    around = start.join(explode_cells(outline, "west", "south", "east", "north", cell).hint("merge"), ["_cx", "_cy"]) \
        .where(C("_px").between(C("west"), C("east")) & C("_py").between(C("south"), C("north"))).select(key, "_px", "_py", "_cy")
    bands = e.join(outline.select(key).hint("merge"), key, "left_semi").withColumn("_cy", F.explode(F.sequence(F.floor(C("south") / cell).cast("int"), F.floor(C("north") / cell).cast("int"))))
    over = (C("south") <= C("_py")) & (C("_py") < C("north")) & (_x_at(C("_py")) > C("_px"))
    inside = written(around.join(bands.hint("merge"), [key, "_cy"]).where(over) \
        .groupBy("_px", "_py", key).agg((F.count("*") % 2 == 1).alias("_in")).where("_in").select("_px", "_py").distinct())
    within = first.join(inside.hint("merge"), ["_px", "_py"], "left_semi").select(line)
    hit = crossing.unionByName(within).distinct()
    found = hit.agg((F.count("*") > 0).alias("_any"))
    flagged = lines.select(line).join(hit.withColumn("_hit", F.lit(True)).hint("merge"), line, "left")
    return with_row(flagged, found).where(C("_hit") | ~C("_any")).select(line)
