"""Queries for polygons on rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewater.operators import geometry as G
from tilewater.plans.registry import query
from tilewater.session import spread

C = F.col

# corner offsets of the test outline, in radii, clockwise or not as the sign of the ring area says
_CORNERS = ((-1.0, -0.8), (-0.5, 1.0), (1.0, 0.7), (0.9, -1.0), (-1.0, -0.8))


def _center():
    k = C("c_custkey")
    return (k * 37 % 140) + 5.3, (k * 91 % 90) + 5.2, (k % 4) + 2.37


def _ring(scale, corners, dx=0.0):
    cx, cy, r = _center()
    return F.array(*[F.struct((cx + r * (x * scale + dx)).alias("x"), (cy + r * (y * scale)).alias("y")) for x, y in corners])


def _rings(t):
    """One outline per customer, a hole in every third, and a ring that is too short in every seventh."""
    k = C("c_custkey")
    ring = lambda pos, pts: F.struct(F.lit(pos).alias("pos"), pts.alias("pts"))
    all_rings = F.array_compact(F.array(
        ring(0, _ring(1.0, _CORNERS)), F.when(k % 3 == 0, ring(1, _ring(0.4, _CORNERS[::-1]))),
        F.when(k % 5 == 0, ring(2, _ring(0.3, _CORNERS, dx=3.0))), F.when(k % 6 == 0, ring(3, _ring(0.1, _CORNERS[::-1], dx=3.0))),
        F.when(k % 4 == 0, ring(4, _ring(0.1, _CORNERS[::-1], dx=9.0))), F.when(k % 7 == 0, ring(5, _ring(0.2, _CORNERS[:3])))))
    return spread(t.read("customer").select("c_custkey"), "c_custkey").select(k.alias("id"), F.explode(all_rings).alias("r")).select("id", "r.pos", "r.pts")


_P = ("p AS (SELECT c_custkey AS id, (c_custkey * 37 % 140) + 5.3e0 AS cx, (c_custkey * 91 % 90) + 5.2e0 AS cy, (c_custkey % 4) + 2.37e0 AS r FROM customer)")
_E = """k(i, ux, uy, vx, vy) AS (VALUES (0, -1e0, -0.8e0, -0.5e0, 1e0), (1, -0.5e0, 1e0, 1e0, 0.7e0), (2, 1e0, 0.7e0, 0.9e0, -1e0), (3, 0.9e0, -1e0, -1e0, -0.8e0)),
    e AS (SELECT id, cx + r * (ux * s + dx) AS x0, cy + r * (uy * s) AS y0, cx + r * (vx * s + dx) AS x1, cy + r * (vy * s) AS y1
          FROM p, k, (VALUES (1e0, 0e0, 1), (0.4e0, 0e0, 3), (0.3e0, 3e0, 5), (0.1e0, 3e0, 6), (0.1e0, 9e0, 4)) q(s, dx, every) WHERE id % every = 0)"""
_BOXC = """bx AS (SELECT id, row, cast(unnest(range(cast(floor(cx - r) AS bigint) - 1, cast(ceil(cx + 9.2e0 * r) AS bigint) + 1)) AS integer) AS col
        FROM (SELECT *, cast(unnest(range(cast(floor(cy - r) AS bigint) - 1, cast(ceil(cy + r) AS bigint) + 1)) AS integer) AS row FROM p))"""
_IN = """ic AS (SELECT b.id, row, col FROM bx b JOIN e ON e.id = b.id AND ((y0 <= row + 0.5e0 AND row + 0.5e0 < y1) OR (y1 <= row + 0.5e0 AND row + 0.5e0 < y0))
           AND x0 + (row + 0.5e0 - y0) * (x1 - x0) / (y1 - y0) > col + 0.5e0 GROUP BY b.id, row, col HAVING count(*) % 2 = 1)"""
_TC = """tc AS (SELECT DISTINCT b.id, row, col FROM bx b JOIN e ON e.id = b.id
           AND greatest(least((col - x0) / (x1 - x0), (col + 1 - x0) / (x1 - x0)), least((row - y0) / (y1 - y0), (row + 1 - y0) / (y1 - y0)), 0e0)
            <= least(greatest((col - x0) / (x1 - x0), (col + 1 - x0) / (x1 - x0)), greatest((row - y0) / (y1 - y0), (row + 1 - y0) / (y1 - y0)), 1e0))"""


@query("polygon_cells", "", f"WITH {_P}, {_E}, {_BOXC}, {_IN} SELECT id, row, col FROM ic")
def _(t):
    return G.polygon_cells(_rings(t), "id")


@query("polygon_cells_touched", "", f"WITH {_P}, {_E}, {_BOXC}, {_IN}, {_TC} SELECT id, row, col FROM ic UNION SELECT id, row, col FROM tc")
def _(t):
    return G.polygon_cells(_rings(t), "id", all_touched=True)


_AREA = "(-0.5e0 * abs(sh) * r * r * sc * sc)"


@query("polygon_rings", "", """
    WITH c(i, x, y) AS (VALUES (0, -1e0, -0.8e0), (1, -0.5e0, 1e0), (2, 1e0, 0.7e0), (3, 0.9e0, -1e0), (4, -1e0, -0.8e0)),
    sh AS (SELECT sum(a.x * b.y - b.x * a.y) / 2e0 AS base FROM c a JOIN c b ON b.i = a.i + 1),
    p AS (SELECT c_custkey AS id, (c_custkey % 4) + 2.37e0 AS r FROM customer),
    q(pos, sc, sgn, role, outer_pos, every) AS (VALUES (0, 1e0, 1e0, 'outer', 0, 1), (1, 0.4e0, -1e0, 'hole', 0, 3), (2, 0.3e0, 1e0, 'outer', 2, 5), (3, 0.1e0, -1e0, 'hole', 2, 6), (4, 0.1e0, -1e0, 'loose', NULL, 4))
    SELECT id, pos, CASE WHEN pos = 3 AND id % 5 <> 0 THEN 'loose' ELSE role END AS role, CASE WHEN pos = 3 AND id % 5 <> 0 THEN NULL ELSE outer_pos END AS outer_pos,
           round(base * sgn * r * r * sc * sc, 6) AS area FROM p, q, sh WHERE id % every = 0""")
def _(t):
    return G.polygon_rings(_rings(t), "id").select("id", "pos", "role", "outer_pos", F.round("area", 6).alias("area"))


@query("clip_to_polygon", "fx_grid", f"""
    WITH {_P}, {_E}, {_BOXC}, {_IN}, {_TC}, u AS (SELECT id, row, col FROM ic UNION SELECT id, row, col FROM tc),
    w AS (SELECT DISTINCT row, col FROM u), kept AS (SELECT g.* FROM fx_grid g JOIN w ON w.row = g.row AND w.col = g.col)
    SELECT row - (SELECT min(row) FROM kept) AS row, col - (SELECT min(col) FROM kept) AS col, v FROM kept""")
def _(t):
    return G.clip_to_polygon(t.grid().select("row", "col", "v"), _rings(t), "id").select("row", "col", "v")


_LN = """l AS (SELECT p_partkey AS line_id, p_partkey * 53 % 150 + 0.11e0 AS ax, p_partkey * 29 % 100 + 0.17e0 AS ay, p_partkey * 53 % 150 + p_partkey % 5 + 0.71e0 AS bx_, p_partkey * 29 % 100 + p_partkey % 7 - 2.5e0 AS by_ FROM part)"""


@query("lines_meeting", "", f"""
    WITH {_P}, {_E}, {_LN}, g AS (SELECT * FROM e),
    x AS (SELECT DISTINCT line_id FROM l JOIN g ON ((x1 - x0) * (ay - y0) - (y1 - y0) * (ax - x0)) * ((x1 - x0) * (by_ - y0) - (y1 - y0) * (bx_ - x0)) <= 0
          AND ((bx_ - ax) * (y0 - ay) - (by_ - ay) * (x0 - ax)) * ((bx_ - ax) * (y1 - ay) - (by_ - ay) * (x1 - ax)) <= 0),
    n AS (SELECT DISTINCT line_id FROM (SELECT line_id, id FROM l JOIN g ON ((y0 <= ay AND ay < y1) OR (y1 <= ay AND ay < y0)) AND x0 + (ay - y0) * (x1 - x0) / (y1 - y0) > ax
          GROUP BY line_id, id HAVING count(*) % 2 = 1))
    SELECT line_id FROM x UNION SELECT line_id FROM n""")
def _(t):
    k = C("p_partkey")
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ax, ay = k * 53 % 150 + 0.11, k * 29 % 100 + 0.17
    lines = t.read("part").select(k.alias("line_id"), F.array(p(ax, ay), p(k * 53 % 150 + k % 5 + 0.71, k * 29 % 100 + k % 7 - 2.5)).alias("pts"))
    return G.lines_meeting(lines, "line_id", _rings(t), "id")


_CMP = "threshold_ft * 0.3048e0 * 10e0"


@query("compare_to_polygons", "fx_grid", f"""
    WITH {_P}, {_E}, {_BOXC}, {_IN}, {_TC}, w AS (SELECT row, col FROM ic UNION SELECT row, col FROM tc),
    f(threshold_ft) AS (VALUES (30e0), (150e0), (600e0)), g AS (SELECT v, w.row IS NOT NULL AS m FROM fx_grid x LEFT JOIN w ON w.row = x.row AND w.col = x.col)
    SELECT threshold_ft, count(v) AS valid, count_if(v IS NOT NULL AND m) AS ref, count_if(v <= {_CMP}) AS hand, count_if(v <= {_CMP} AND m) AS tp,
           round(count_if(v <= {_CMP} AND m) / nullif(count_if(v <= {_CMP} OR (v IS NOT NULL AND m)), 0), 9) AS iou,
           round((count_if(v <= {_CMP} AND m) / nullif(count_if(v <= {_CMP}), 0)) / (count_if(v IS NOT NULL AND m) / count(v)), 9) AS precision_lift
    FROM g, f GROUP BY threshold_ft""")
def _(t):
    from tilewater.plans.products import compare_to_polygons

    m = compare_to_polygons(t.grid().select("row", "col", "v"), _rings(t), "id", (30, 150, 600))
    return m.select("threshold_ft", "valid", "ref", "hand", "tp", F.round("iou", 9).alias("iou"), F.round("precision_lift", 9).alias("precision_lift"))
