"""Queries for value encodings, flood classes and colours."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tilewater.functions import colors as K
from tilewater.functions import values as V
from tilewater.functions.text import fixed1
from tilewater.plans import sqltext as S
from tilewater.plans.registry import query

C = F.col

# Cells with heights that fall on every side of the class borders: h in metres, lvl the water level.
_CELLS = "SELECT row, col, v, v - 600 AS m, cast(v % 20 AS double) AS h, (col % 40) / 4e0 AS lvl FROM fx_grid"


def _cells(t):
    return t.grid().select("row", "col", "v", (C("v") - 600).alias("m"), (C("v") % 20).cast("double").alias("h"),
                           ((C("col") % 40) / 4.0).alias("lvl"))


_OK = "m IS NOT NULL AND m BETWEEN -500 AND 9000"


@query("encode_elevation", "fx_grid", f"""
    WITH c AS ({_CELLS})
    SELECT row, col, {S.i32(f"CASE WHEN {_OK} THEN floor(cast((m + 500) / 9500e0 * 65534 AS float)) ELSE 65535 END")} AS code_v1,
           {S.i32(f"CASE WHEN {_OK} THEN floor(cast(cast((cast(m AS float) + cast(500 AS float)) / 9500e0 AS float) * cast(65534 AS float) AS float)) ELSE 65535 END")} AS code_f32
    FROM c""")
def _(t):
    return _cells(t).select("row", "col", V.encode_elevation(C("m"), "v1").alias("code_v1"),
                            V.encode_elevation(C("m"), "f32").alias("code_f32"))


@query("decode_elevation", "fx_grid", """
    WITH c AS (SELECT row, col, CASE WHEN v IS NULL THEN 65535 ELSE (v * 13) % 65535 END AS code FROM fx_grid)
    SELECT row, col, CASE WHEN code <> 65535 THEN round(cast(cast(code AS float) / cast(65534 AS float) * cast(9500 AS float)
        - cast(500 AS float) AS double), 3) END AS metres FROM c""")
def _(t):
    code = F.when(C("v").isNull(), 65535).otherwise((C("v") * 13) % 65535)
    return t.grid().select("row", "col", code.alias("code")).select(
        "row", "col", F.round(V.decode_elevation(C("code")).cast("double"), 3).alias("metres"))


@query("encode_hand", "fx_grid", """
    SELECT row, col, cast(CASE WHEN v IS NULL OR v = 250 OR v < 100 THEN 65535
        ELSE least(65534, round_even(cast(cast((v - 100) / 8e0 AS float) * cast(10 AS float) AS float), 0)) END AS integer) AS code
    FROM fx_grid""")
def _(t):
    return t.grid().select("row", "col", V.encode_hand((C("v") - 100) / 8.0, source_nodata=(250 - 100) / 8.0).alias("code"))


@query("decode_hand", "fx_grid", """
    SELECT row, col, CASE WHEN v IS NOT NULL THEN round(cast(cast(v AS float) / cast(10 AS float) AS double), 4) END AS metres
    FROM fx_grid""")
def _(t):
    code = F.coalesce("v", F.lit(65535))
    return t.grid().select("row", "col", F.round(V.decode_hand(code).cast("double"), 4).alias("metres"))


@query("normalize_nodata", "fx_grid", """
    WITH c AS (SELECT row, col, CASE WHEN v IS NULL THEN -32768 WHEN v % 7 = 0 THEN -32767 ELSE v * 4 - 3000 END AS raw FROM fx_grid)
    SELECT row, col, CASE WHEN raw NOT IN (-32768, -32767) THEN raw END AS v,
           coalesce(CASE WHEN raw NOT IN (-32768, -32767) THEN raw BETWEEN -500 AND 9000 END, false) AS plausible
    FROM c""")
def _(t):
    raw = F.when(C("v").isNull(), -32768).when(C("v") % 7 == 0, -32767).otherwise(C("v") * 4 - 3000)
    c = t.grid().select("row", "col", raw.alias("raw"))
    n = V.normalize_nodata(C("raw"))
    return c.select("row", "col", n.alias("v"), F.coalesce(V.in_elevation_range(n), F.lit(False)).alias("plausible"))


_RISK = S.pick(("row % 11 = 0", "'unknown'"), ("h IS NULL", "'water'"), ("h - lvl < 0.5", "'very_high'"),
               ("h - lvl < 2", "'high'"), ("h - lvl < 5", "'moderate'"), other="'low'")
_SAY = lambda w: f"'{w} flood risk - ' || printf('%.1f', h - lvl) || 'm above water level (z11 sample)'"


@query("flood_risk_class", "fx_grid", f"""
    WITH c AS ({_CELLS.replace("(col % 40) / 4e0", "(col % 80) / 8e0")})
    SELECT row, col, {_RISK} AS risk,
           {S.pick(("row % 11 = 0", "'No elevation data available (z11 sample)'"),
                   ("h IS NULL", "'Open water / no land elevation at this point (z11 sample)'"),
                   ("h - lvl < 0.5", _SAY("Very high")), ("h - lvl < 2", _SAY("High")), ("h - lvl < 5", _SAY("Moderate")),
                   other=_SAY("Low"))} AS risk_text
    FROM c""")
def _(t):
    c = _cells(t).withColumn("lvl", (C("col") % 80) / 8.0)
    found = C("row") % 11 != 0
    return c.select("row", "col", V.flood_risk_class(C("h"), C("lvl"), found).alias("risk"),
                    V.flood_risk_text(C("h"), C("lvl"), found, 11).alias("risk_text"))


_LEVEL = S.pick(("h - lvl >= 5", "0e0"), ("h - lvl >= 2", "(5e0 - (h - lvl)) / 3e0 * 0.33e0"),
                ("h - lvl >= 0.5", "0.33e0 + (2e0 - (h - lvl)) / 1.5e0 * 0.33e0"),
                ("h - lvl >= -0.5", "0.66e0 + (0.5e0 - (h - lvl)) / 1e0 * 0.34e0"), other="1e0")


@query("flood_risk_level", "fx_grid", f"""
    WITH c AS ({_CELLS}) SELECT row, col, round({_LEVEL}, 9) AS risk FROM c WHERE h IS NOT NULL""")
def _(t):
    return _cells(t).where("h IS NOT NULL").select("row", "col", F.round(V.flood_risk_level(C("h"), C("lvl")), 9).alias("risk"))


def _rgba_sql(branches, last) -> str:
    """Branches of (condition, colour) or (condition, (colour a, colour b, t, nearest))."""
    out = []
    for i, n in enumerate("rgba"):
        def text(c):
            if len(c) == 4 and isinstance(c[0], tuple):
                a, b, tt, nearest = c
                mix = f"{a[i]}e0 * (1e0 - ({tt})) + {b[i]}e0 * ({tt})"
                return f"floor({mix} + 0.5e0)" if nearest else f"trunc({mix})"
            return str(c[i])
        out.append(S.i32(S.pick(*[(cond, text(c)) for cond, c in branches], other=text(last))) + f" AS {n}")
    return ", ".join(out)


def _spread(df, col):
    keys = [c for c in df.columns if c != col]
    return df.select(*keys, *[C(f"{col}.{n}").alias(n) for n in "rgba"])


# 77 steps keep the blend away from exact integers, where the last bit would decide a truncation
_T77 = "(v % 77 + 0.5e0) / 77e0"


@query("risk_to_rgba", "fx_grid", f"""
    WITH c AS (SELECT row, col, {_T77} AS t FROM fx_grid WHERE v IS NOT NULL)
    SELECT row, col, {_rgba_sql([("t <= 0.33e0", (K.SAFE, K.CAUTION, "t / 0.33e0", False)),
                                 ("t <= 0.66e0", (K.CAUTION, K.DANGER, "(t - 0.33e0) / 0.33e0", False))],
                                (K.DANGER, K.FLOODED, "(t - 0.66e0) / 0.34e0", False))} FROM c""")
def _(t):
    c = t.grid().where("v IS NOT NULL").select("row", "col", ((C("v") % 77 + 0.5) / 77.0).alias("t"))
    return _spread(c.select("row", "col", K.risk_to_rgba(C("t")).alias("k")), "k")


@query("flood_class_rgba", "fx_grid", f"""
    WITH c AS (SELECT row, col, coalesce(h, 0) AS h, lvl FROM ({_CELLS}))
    SELECT row, col, {_rgba_sql([("h < lvl + 0.5", K.FLOODED), ("h < lvl + 2", K.DANGER), ("h < lvl + 5", K.CAUTION)], K.SAFE)}
    FROM c""")
def _(t):
    return _spread(_cells(t).select("row", "col", K.flood_class_rgba(C("h"), C("lvl")).alias("k")), "k")


@query("topo_rgba", "fx_grid", f"""
    WITH c AS (SELECT row, col, coalesce(v - 100, 0) AS e FROM fx_grid)
    SELECT row, col, {_rgba_sql([("e < 0", K.CLEAR)] + [(f"e < {u}", c) for (_, c), (u, _) in zip(K.TOPO_BANDS, K.TOPO_BANDS[1:])],
                                K.TOPO_BANDS[-1][1])} FROM c""")
def _(t):
    return _spread(t.grid().select("row", "col", K.topo_rgba((C("v") - 100).cast("double")).alias("k")), "k")


_REL = "(h - lvl)"


@query("client_flood_rgba", "fx_grid", f"""
    WITH c AS (SELECT row, col, h + 0.0137e0 AS h, lvl FROM ({_CELLS}))
    SELECT row, col, {_rgba_sql([("h IS NULL", K.OPEN_WATER), (f"{_REL} >= 5", K.CLEAR),
        (f"{_REL} >= 2", (K.SAFE, K.CAUTION, f"(5e0 - {_REL}) / 3e0", True)),
        (f"{_REL} >= 0.5", (K.CAUTION, K.DANGER, f"(2e0 - {_REL}) / 1.5e0", True)),
        (f"{_REL} >= -0.5", (K.DANGER, K.FLOODED, f"(0.5e0 - {_REL})", True))], K.FLOODED)}
    FROM c""")
def _(t):
    c = _cells(t).withColumn("h", C("h") + 0.0137)
    return _spread(c.select("row", "col", K.client_flood_rgba(C("h"), C("lvl")).alias("k")), "k")


_DEN = f"{math.asinh(6500.0 / 120.0)!r}::double"
_RELIEF = [(math.asinh(m / 120.0) / math.asinh(6500.0 / 120.0), c) for m, c in K.RELIEF_STOPS]


def _ramp_sql(stops):
    return [(f"t <= {t1!r}::double", (c0, c1, f"(t - {t0!r}::double) / {max(1e-12, t1 - t0)!r}::double", True))
            for (t0, c0), (t1, c1) in zip(stops, stops[1:])]


@query("hypsometric_rgba", "fx_grid", f"""
    WITH c AS (SELECT row, col, v * 1.5e0 - 200.3e0 AS e FROM fx_grid),
         d AS (SELECT row, col, e, ln(least(6500e0, e) / 120e0 + sqrt(pow(least(6500e0, e) / 120e0, 2) + 1e0)) / {_DEN} AS t FROM c)
    SELECT row, col, {_rgba_sql([("e IS NULL OR e < 0", K.OCEAN)] + _ramp_sql(_RELIEF), _RELIEF[-1][1])} FROM d""")
def _(t):
    c = t.grid().select("row", "col", (C("v") * 1.5 - 200.3).alias("e"))
    return _spread(K.hypsometric_rgba(c, "e", "k").select("row", "col", "k"), "k")


@query("hand_depth_rgba", "fx_grid", f"""
    WITH c AS (SELECT row, col, v / 1e2 AS h, (col % 40) * 1.1e0 AS thr FROM fx_grid),
         d AS (SELECT row, col, h, thr, least(1e0, greatest(0e0, 1e0 - exp(-greatest(0e0, thr - h) / greatest(0.8e0, thr * 0.08e0)))) AS t FROM c)
    SELECT row, col, {_rgba_sql([("h IS NULL", K.HAND_NODATA), ("h > thr", K.CLEAR)] + _ramp_sql(K.HAND_STOPS), K.HAND_STOPS[-1][1])}
    FROM d""")
def _(t):
    c = t.grid().select("row", "col", (C("v") / 100.0).alias("h"), ((C("col") % 40) * 1.1).alias("thr"))
    return _spread(K.hand_depth_rgba(c, "h", "thr", "k", show_nodata=True).select("row", "col", "k"), "k")


@query("gray_scale_fixed", "fx_grid", f"""
    SELECT row, col, {S.i32('greatest(0e0, least(255e0, trunc((v - 600 + 500) / 4000e0 * 255)))')} AS gray
    FROM fx_grid WHERE v IS NOT NULL""")
def _(t):
    return _cells(t).where("m IS NOT NULL").select("row", "col", K.gray_scale_fixed(C("m")).alias("gray"))


@query("gray_scale_minmax", "fx_tile_cells", f"""
    WITH s AS (SELECT vec_id, min(v) AS lo, max(v) AS hi, count(*) - count(v) AS holes FROM fx_tile_cells GROUP BY vec_id)
    SELECT c.vec_id, row, col, {S.i32('CASE WHEN holes > 4 OR hi <= lo THEN 0 ELSE trunc((coalesce(v, lo) - lo) * 1e0 / (hi - lo) * 255) END')} AS gray
    FROM fx_tile_cells c JOIN s ON c.vec_id = s.vec_id""")
def _(t):
    from tilewater.operators.raster_stats import gray_scale_minmax

    return gray_scale_minmax(t.tile_cells(), ["vec_id"], max_holes=4).select("vec_id", "row", "col", "gray")


@query("legend_table", "fx_points", """
    WITH w AS (SELECT DISTINCT round(water_level_m, 2) AS lvl FROM fx_points),
         e(position, off_lo, off_hi, name, r, g, b, a) AS (VALUES (0, 5e0, NULL, 'Safe', 76, 175, 80, 120),
            (1, 2e0, 5e0, 'Caution', 255, 193, 7, 160), (2, 0.5e0, 2e0, 'Danger', 244, 67, 54, 200), (3, NULL, 0.5e0, 'Flooded', 33, 150, 243, 220))
    SELECT lvl, position, name || ' (' || CASE WHEN position = 0 THEN '>' || printf('%.1f', lvl + off_lo)
                WHEN position = 3 THEN '<' || printf('%.1f', lvl + off_hi)
                ELSE printf('%.1f', lvl + off_lo) || '-' || printf('%.1f', lvl + off_hi) END || 'm)' AS label,
           lvl + off_lo AS lower, lvl + off_hi AS upper, r, g, b, a FROM w, e""")
def _(t):
    w = t.points().select(F.round("water_level_m", 2).alias("lvl")).distinct()
    return w.select("lvl", F.explode(K.legend_classes(C("lvl"))).alias("e")).select("lvl", "e.*")


@query("water_level_key", "fx_requests", """
    SELECT event_id, printf('%.2f', round_even(water_level_m * 10, 0) / 10) || ':' || z || ':' || x || ':' || y AS cache_key
    FROM fx_requests""")
def _(t):
    return t.requests().select("event_id", V.water_level_key(C("water_level_m"), C("z"), C("x"), C("y")).alias("cache_key"))


@query("slider_water_level", "fx_points", """
    WITH s AS (SELECT event_id, (event_id % 1250) / 1e1 AS s FROM fx_points)
    SELECT event_id, floor(0.1e0 * pow(10e0, s / 25e0) * 10 + 0.5e0) / 10e0 AS level,
           round(25e0 * log10((s + 1e0) / 0.1e0), 8) AS slider FROM s""")
def _(t):
    s = t.points().select("event_id", ((C("event_id") % 1250) / 10.0).alias("s"))
    return s.select("event_id", V.slider_water_level(C("s")).alias("level"),
                    F.round(V.water_level_slider(C("s") + 1.0), 8).alias("slider"))


@query("water_level_label", "fx_points", """
    WITH s AS (SELECT event_id, pow(water_level_m, 3) * 20 AS w FROM fx_points)
    SELECT event_id, CASE WHEN w <= 0.5 THEN 'Puddle' WHEN w <= 3 THEN 'Street Flood' WHEN w <= 10 THEN 'Neighborhood'
               WHEN w <= 75 THEN 'City Flood' WHEN w <= 1000 THEN 'Mega Flood' ELSE 'Apocalypse' END AS label,
           CASE WHEN w <= 0.5 THEN 'vibe-normal' WHEN w <= 3 THEN 'vibe-concerning' WHEN w <= 10 THEN 'vibe-dangerous'
               WHEN w <= 1000 THEN 'vibe-extreme' ELSE 'vibe-apocalyptic' END AS mood FROM s""")
def _(t):
    w = t.points().select("event_id", (F.pow("water_level_m", F.lit(3.0)) * 20).alias("w"))
    return w.select("event_id", V.banded(C("w"), V.LEVEL_LABELS, V.LEVEL_LABEL_LAST).alias("label"),
                    V.banded(C("w"), V.LEVEL_MOODS, V.LEVEL_MOOD_LAST).alias("mood"))


@query("threshold_codes", "", f"""
    WITH f AS (SELECT DISTINCT l_quantity AS feet FROM lineitem)
    SELECT feet, feet * 0.3048e0 AS metres, {S.i32('round_even(feet * 0.3048e0 * 10e0, 0)')} AS code_round,
           {S.i32('floor(feet * 0.3048e0 * 10e0)')} AS code_exact FROM f""")
def _(t):
    f = t.read("lineitem").select(C("l_quantity").alias("feet")).distinct()
    return f.select("feet", (C("feet") * V.FEET_TO_M).alias("metres"), V.threshold_code(C("feet"), "round").alias("code_round"),
                    V.threshold_code(C("feet"), "exact").alias("code_exact"))


@query("height_units", "fx_grid", """
    SELECT row, col, v / 1e1 AS height_m, round(v / 1e1 * 3.28084e0, 6) AS height_ft FROM fx_grid WHERE v IS NOT NULL""")
def _(t):
    u = t.grid().where("v IS NOT NULL").select("row", "col", V.height_units(C("v") / 10.0).alias("u"))
    return u.select("row", "col", C("u.height_m").alias("height_m"), F.round("u.height_ft", 6).alias("height_ft"))


@query("tile_data_status", "fx_points fx_tile_cells", f"""
    WITH r AS (SELECT event_id, {S.tx('lon', '9')} AS x, {S.ty('lat', '9')} AS y FROM fx_points),
         s AS (SELECT x, y, bool_and(v IS NULL OR vec_id % 9 = 0) AS empty FROM fx_tile_cells GROUP BY x, y)
    SELECT event_id, CASE WHEN empty IS NULL THEN 'build-miss' WHEN empty THEN 'source-nodata' ELSE 'ok' END AS status,
           CASE WHEN empty IS NULL THEN 'build_miss' WHEN empty THEN 'source_nodata' ELSE 'hit' END AS cache
    FROM r LEFT JOIN s ON r.x = s.x AND r.y = s.y""")
def _(t):
    from tilewater.functions import addressing as A

    r = t.points().select("event_id", A.tile_x(C("lon"), F.lit(9)).alias("x"), A.tile_y(C("lat"), F.lit(9)).alias("y"))
    s = t.tile_cells().groupBy("x", "y").agg(F.bool_and(C("v").isNull() | (C("vec_id") % 9 == 0)).alias("empty"))
    d = V.tile_data_status(C("empty").isNotNull(), F.coalesce("empty", F.lit(False)))
    return r.join(s, ["x", "y"], "left").select("event_id", d.alias("d")).select("event_id", "d.*")
