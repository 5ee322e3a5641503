"""Queries for resampling, neighbourhoods and drainage on cell tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilewater.functions import addressing as A
from tilewater.operators import basins as B
from tilewater.operators import drainage as D
from tilewater.operators import resample as Z
from tilewater.operators.generators import tile_pixel_centers
from tilewater.plans import sqltext as S
from tilewater.plans.raster_queries import _round
from tilewater.plans.registry import query
from tilewater.session import written

C = F.col
BLOCK = 64
_M = "20037508.342789244e0"
_SPAN = f"(2e0 * {_M} / pow(2e0, z))"


@query("resample_nearest", "fx_tile_cells fx_grid", f"""
    WITH p AS (SELECT vec_id, row, col, (-{_M} + x * {_SPAN} + (col + 0.5e0) * {_SPAN} / 8) / {_M} * 180e0 AS lon,
                      degrees(2e0 * atan(exp(({_M} - y * {_SPAN} - (row + 0.5e0) * {_SPAN} / 8) / {_M} * pi())) - pi() / 2e0) AS lat FROM fx_tile_cells),
         k AS (SELECT vec_id, row, col, {S.i32('floor((49.5e0 - lat) / 0.255e0)')} AS sr, {S.i32('floor((lon - -125e0) / 0.39e0)')} AS sc FROM p)
    SELECT vec_id, k.row, k.col, g.v FROM k JOIN fx_grid g ON g.row = sr AND g.col = sc WHERE g.v IS NOT NULL AND sr BETWEEN 0 AND 99 AND sc BETWEEN 0 AND 149""")
def _(t):
    tiles = t.read("embeddings").select(
        "vec_id", F.lit(9).alias("z"), (F.lit(80) + C("vec_id") % 80).cast("int").alias("x"), (F.lit(176) + F.floor(C("vec_id") / 80)).cast("int").alias("y"))
    px = tile_pixel_centers(tiles, size=8).withColumn("ll", A.mercator_to_lonlat(C("cx"), C("cy")))
    r = Z.resample_nearest(px.select("vec_id", "row", "col", "ll"), t.grid(), C("ll.lon"), C("ll.lat"), left=-125.0, top=49.5, dx=0.39, dy=0.255, height=100, width=150)
    return r.select("vec_id", "row", "col", "v")


@query("overview_pyramid", "fx_grid", f"""
    SELECT {S.i32('l')} AS level, {S.i32('row / pow(2, l)')} AS row, {S.i32('col / pow(2, l)')} AS col, v FROM fx_grid, range(1, 7) AS r(l)
    WHERE row % cast(pow(2, l) AS integer) = 0 AND col % cast(pow(2, l) AS integer) = 0""")
def _(t):
    return Z.overview_pyramid(t.grid().select("row", "col", "v"), 6).select("level", "row", "col", "v")


_N4 = """n AS (SELECT g.row, g.col, g.v, CASE WHEN l.row IS NULL THEN g.v ELSE l.v END AS l, CASE WHEN r.row IS NULL THEN g.v ELSE r.v END AS r,
    CASE WHEN u.row IS NULL THEN g.v ELSE u.v END AS u, CASE WHEN d.row IS NULL THEN g.v ELSE d.v END AS d FROM fx_grid g
    LEFT JOIN fx_grid l ON l.row = g.row AND l.col = g.col - 1 LEFT JOIN fx_grid r ON r.row = g.row AND r.col = g.col + 1
    LEFT JOIN fx_grid u ON u.row = g.row - 1 AND u.col = g.col LEFT JOIN fx_grid d ON d.row = g.row + 1 AND d.col = g.col)"""


@query("surface_gradient", "fx_grid", f"""
    WITH {_N4}, m AS (SELECT *, sqrt(pow(l - r, 2) + 2.8e0 * 2.8e0 + pow(u - d, 2)) AS len3, coalesce(l - r, 0) AS gx, coalesce(u - d, 0) AS gy FROM n)
    SELECT row, col, round((l - r) / len3, 9) AS nx, round(2.8e0 / len3, 9) AS ny, round((u - d) / len3, 9) AS nz,
           round(CASE WHEN sqrt(gx * gx + gy * gy) < 0.0001 THEN 0.72 ELSE gx / sqrt(gx * gx + gy * gy) END, 9) AS fx,
           round(CASE WHEN sqrt(gx * gx + gy * gy) < 0.0001 THEN 0.36 ELSE gy / sqrt(gx * gx + gy * gy) END, 9) AS fy FROM m""")
def _(t):
    return _round(Z.surface_gradient(t.grid().select("row", "col", C("v").cast("double").alias("v")), 2.8))


@query("relief_height", "fx_grid", """
    SELECT row, col, round((greatest(0e0, least(1e0, (v - 300) / 4000e0)) - 0.42e0) * 0.58e0 * 1.7e0, 9) AS height FROM fx_grid WHERE v IS NOT NULL""")
def _(t):
    return t.grid().where("v IS NOT NULL").select("row", "col", F.round(Z.relief_height(C("v"), F.lit(300), F.lit(4000.0), 1.7), 9).alias("height"))


@query("burn_streams", "fx_grid", "SELECT row, col, CASE WHEN stream_mask THEN v - 40e0 ELSE v * 1e0 END AS v FROM fx_grid")
def _(t):
    g = t.grid()
    return Z.burn_streams(g.select("row", "col", C("v").cast("double").alias("v")), g.where("stream_mask"), 40.0).select("row", "col", "v")


@query("banded_blocks", "fx_grid", f"""
    SELECT row, col, v, {S.i32('b')} AS band, floor(row / 30) = b AS interior FROM fx_grid, range(0, 100000) AS r(b)
    WHERE b BETWEEN greatest(0, floor((row - 5) / 30)) AND floor((row + 5) / 30)""")
def _(t):
    return Z.banded_blocks(t.grid().select("row", "col", "v"), 30, 5).select("row", "col", "v", "band", "interior")


def _d8_sql(burn: str, tag: str = "", grid: str = "fx_grid") -> str:
    return f"""
    z{tag} AS (SELECT row, col, CASE WHEN stream_mask THEN v - {burn} ELSE v * 1e0 END AS v, v * 1e0 AS e, stream_mask, ref_mask FROM {grid} WHERE v IS NOT NULL),
    st{tag}(dr, dc, dist, code) AS (VALUES (0, 1, 1e0, 1), (1, 1, sqrt(2e0), 2), (1, 0, 1e0, 4), (1, -1, sqrt(2e0), 8), (0, -1, 1e0, 16), (-1, -1, sqrt(2e0), 32), (-1, 0, 1e0, 64), (-1, 1, sqrt(2e0), 128)),
    op{tag} AS (SELECT z.row, z.col, dr, dc, code, row_number() OVER (PARTITION BY z.row, z.col ORDER BY (z.v - n.v) / dist DESC, code) AS k
           FROM z{tag} z, st{tag} st JOIN z{tag} n ON n.row = z.row + dr AND n.col = z.col + dc WHERE n.v < z.v),
    nx{tag} AS (SELECT row, col, row + dr AS to_row, col + dc AS to_col, code FROM op{tag} WHERE k = 1)"""


def _flow_sql(tag: str = "") -> str:
    return f"""
    pa{tag}(row, col, r, c, hop) AS (SELECT row, col, row, col, 0 FROM z{tag} UNION ALL SELECT p.row, p.col, n.to_row, n.to_col, hop + 1 FROM pa{tag} p JOIN nx{tag} n ON n.row = p.r AND n.col = p.c),
    ar{tag} AS (SELECT r AS row, c AS col, count(*) * 1e0 AS area FROM pa{tag} GROUP BY r, c)"""


def _hand_sql(threshold: int, tag: str = "", src: str = "") -> str:
    return f"""
    dr{tag} AS (SELECT z.row, z.col, stream_mask OR area >= {threshold} AS drain, e FROM z{src} z JOIN ar{src} a ON a.row = z.row AND a.col = z.col),
    ha{tag} AS (SELECT p.row, p.col, arg_min(d.e, hop) AS de FROM pa{src} p JOIN dr{tag} d ON d.row = p.r AND d.col = p.c WHERE d.drain GROUP BY p.row, p.col),
    hh{tag} AS (SELECT z.row, z.col, CASE WHEN z.e - de >= 0 THEN z.e - de END AS hand FROM z{src} z LEFT JOIN ha{tag} h ON h.row = z.row AND h.col = z.col)"""


def _burned(t, burn=40.0):
    return t.grid().select("row", "col", F.when(C("stream_mask"), C("v") - burn).otherwise(C("v").cast("double")).alias("v"))


@query("flow_direction_d8", "fx_grid", f"""
    WITH {_d8_sql('40e0')} SELECT z.row, z.col, coalesce(code, 0) AS dir FROM z LEFT JOIN nx ON nx.row = z.row AND nx.col = z.col""")
def _(t):
    return D.flow_direction_d8(_burned(t)).where("dir IS NOT NULL").select("row", "col", "dir")


@query("upstream_area", "fx_grid", f"WITH RECURSIVE {_d8_sql('40e0')}, {_flow_sql()} SELECT row, col, area FROM ar")
def _(t):
    return D.upstream_area_of_heights(_burned(t), "v", 1.0, BLOCK)


@query("drain_mask", "fx_grid", f"""
    WITH RECURSIVE {_d8_sql('40e0')}, {_flow_sql()} SELECT z.row, z.col, stream_mask OR area >= 12 AS drain FROM z JOIN ar ON ar.row = z.row AND ar.col = z.col""")
def _(t):
    # in block layout: a join of cells would be broadcast, as Spark takes the packed blocks for a small table
    b = D.drained_blocks(t.grid().select("row", "col", C("v").cast("double").alias("v"), "stream_mask"), 40.0, 12.0, 1.0, BLOCK)
    return D.to_cells(written(b), BLOCK, {"v": "real", "drain": "flag"}, where="v").select("row", "col", "drain")


@query("hand", "fx_grid", f"WITH RECURSIVE {_d8_sql('40e0')}, {_flow_sql()}, {_hand_sql(12)} SELECT row, col, hand FROM hh")
def _(t):
    v = D.hand_variant(t.grid().select("row", "col", C("v").cast("double").alias("v"), "stream_mask"), 40.0, 12.0, 1.0, BLOCK, None)
    return v.where("v IS NOT NULL").select("row", "col", "hand")


@query("fill_depressions", "fx_grid", """
    WITH RECURSIVE z AS (SELECT row, col, v * 1e0 AS v FROM fx_grid WHERE v IS NOT NULL),
    st(dr, dc) AS (VALUES (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)),
    n AS (SELECT z.row, z.col, z.v, n.row AS nr, n.col AS nc FROM z, st JOIN z n ON n.row = z.row + dr AND n.col = z.col + dc),
    l(row, col, w) USING KEY (row, col) AS (
        SELECT z.row, z.col, z.v FROM z LEFT JOIN n ON n.row = z.row AND n.col = z.col GROUP BY z.row, z.col, z.v HAVING count(nr) < 8
        UNION
        SELECT n.row, n.col, min(greatest(n.v, l.w)) FROM l JOIN n ON n.nr = l.row AND n.nc = l.col
        LEFT JOIN recurring.l AS old ON old.row = n.row AND old.col = n.col
        GROUP BY n.row, n.col, old.w HAVING old.w IS NULL OR min(greatest(n.v, l.w)) < old.w)
    SELECT z.row, z.col, z.v, l.w AS filled FROM z JOIN l ON l.row = z.row AND l.col = z.col""")
def _(t):
    return D.fill_depressions(t.grid().select("row", "col", "v"), 128)


_HS_FEET = (30, 150, 600)


def _variant_sql(i: int, burn: str, thr: int, src: str) -> str:
    lim = "threshold_ft * 0.3048e0 * 10e0"
    return f"""
    co{i} AS (SELECT h.row, h.col, CASE WHEN hand IS NOT NULL THEN least(65534, round_even(hand * 10, 0)) END AS code, d.drain, z.ref_mask
              FROM hh{i} h JOIN z{src} z ON z.row = h.row AND z.col = h.col JOIN dr{i} d ON d.row = h.row AND d.col = h.col),
    re{i} AS (SELECT {burn} AS burn_m, {thr}e0 AS min_area, threshold_ft, count(a.code) AS valid, count_if(a.code <= {lim}) AS hand, count_if(a.code <= {lim} AND a.ref_mask) AS tp,
              count_if(a.code IS NOT NULL AND a.ref_mask) AS ref, (SELECT count_if(drain) FROM co{i}) AS drain_cells,
              round(count_if(a.code <= {lim} AND b.code <= {lim}) / nullif(count_if(coalesce(a.code <= {lim}, false) OR coalesce(b.code <= {lim}, false)), 0), 9) AS jaccard
              FROM co{i} a JOIN co0 b ON b.row = a.row AND b.col = a.col, f GROUP BY threshold_ft)"""


@query("hand_sensitivity", "fx_grid", f"""
    WITH RECURSIVE f(threshold_ft) AS (VALUES (30e0), (150e0), (600e0)), {_d8_sql('40e0', 'a')}, {_flow_sql('a')}, {_d8_sql('5e0', 'b')}, {_flow_sql('b')},
    {_hand_sql(12, '0', 'a')}, {_hand_sql(30, '1', 'a')}, {_hand_sql(12, '2', 'b')}, {_variant_sql(0, '40e0', 12, 'a')}, {_variant_sql(1, '40e0', 30, 'a')}, {_variant_sql(2, '5e0', 12, 'b')},
    u AS (SELECT * FROM re0 UNION ALL SELECT * FROM re1 UNION ALL SELECT * FROM re2)
    SELECT burn_m, min_area, threshold_ft, valid, hand, tp, ref, drain_cells, jaccard, round(tp / nullif(hand + ref - tp, 0), 9) AS iou FROM u""")
def _(t):
    g = t.grid().select("row", "col", C("v").cast("double").alias("v"), "stream_mask", "ref_mask")
    r = B.hand_sensitivity(g, [(40.0, 12.0), (40.0, 30.0), (5.0, 12.0)], _HS_FEET, "ref_mask", 1.0, BLOCK)
    return _round(r.select("burn_m", "min_area", "threshold_ft", "valid", "hand", "tp", "ref", "drain_cells", "jaccard", "iou"))


def _basin_variant_sql(i: int, burn: str, thr: int, src: str) -> str:
    """As `_variant_sql`, by basin: in the twin the basins stand ten columns apart, so that none touches another."""
    lim = "threshold_ft * 0.3048e0 * 10e0"
    return f"""
    co{i} AS (SELECT h.row, h.col, cast(floor(h.col / 60) AS integer) AS basin, CASE WHEN hand IS NOT NULL THEN least(65534, round_even(hand * 10, 0)) END AS code, d.drain, z.ref_mask
              FROM hh{i} h JOIN z{src} z ON z.row = h.row AND z.col = h.col JOIN dr{i} d ON d.row = h.row AND d.col = h.col),
    re{i} AS (SELECT a.basin, {burn} AS burn_m, {thr}e0 AS min_area, threshold_ft, count(a.code) AS valid, count_if(a.code <= {lim}) AS hand, count_if(a.code <= {lim} AND a.ref_mask) AS tp,
              count_if(a.code IS NOT NULL AND a.ref_mask) AS ref, count_if(a.drain) AS drain_cells,
              round(count_if(a.code <= {lim} AND b.code <= {lim}) / nullif(count_if(coalesce(a.code <= {lim}, false) OR coalesce(b.code <= {lim}, false)), 0), 9) AS jaccard
              FROM co{i} a JOIN co0 b ON b.row = a.row AND b.col = a.col, f GROUP BY a.basin, threshold_ft)"""


@query("basin_sensitivity", "fx_grid", f"""
    WITH RECURSIVE f(threshold_ft) AS (VALUES (30e0), (150e0), (600e0)), gb AS (SELECT row, cast(col + floor(col / 50) * 10 AS integer) AS col, v, stream_mask, ref_mask FROM fx_grid),
    {_d8_sql('40e0', 'a', 'gb')}, {_flow_sql('a')}, {_d8_sql('5e0', 'b', 'gb')}, {_flow_sql('b')},
    {_hand_sql(12, '0', 'a')}, {_hand_sql(30, '1', 'a')}, {_hand_sql(12, '2', 'b')},
    {_basin_variant_sql(0, '40e0', 12, 'a')}, {_basin_variant_sql(1, '40e0', 30, 'a')}, {_basin_variant_sql(2, '5e0', 12, 'b')},
    u AS (SELECT * FROM re0 UNION ALL SELECT * FROM re1 UNION ALL SELECT * FROM re2)
    SELECT basin, burn_m, min_area, threshold_ft, valid, hand, tp, ref, drain_cells, jaccard, round(tp / nullif(hand + ref - tp, 0), 9) AS iou FROM u""")
def _(t):
    g = t.grid().select(F.floor(C("col") / 50).cast("int").alias("basin"), "row", "col", C("v").cast("double").alias("v"), "stream_mask", "ref_mask")
    r = B.hand_sensitivity(g, [(40.0, 12.0), (40.0, 30.0), (5.0, 12.0)], _HS_FEET, "ref_mask", 1.0, BLOCK, basin="basin")
    return _round(r.select("basin", "burn_m", "min_area", "threshold_ft", "valid", "hand", "tp", "ref", "drain_cells", "jaccard", "iou"))
