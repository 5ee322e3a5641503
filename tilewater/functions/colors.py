"""Colour ramps as column expressions; every function returns struct<r,g,b,a> of ints."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col

# Server palette.
SAFE, CAUTION, DANGER, FLOODED = (76, 175, 80, 120), (255, 193, 7, 160), (244, 67, 54, 200), (33, 150, 243, 220)
# Elevation bands (lower bound in metres, colour).
TOPO_BANDS = (
    (0, (33, 150, 243, 255)),
    (5, (76, 175, 80, 255)),
    (50, (139, 195, 74, 255)),
    (100, (255, 235, 59, 255)),
    (200, (255, 152, 0, 255)),
    (500, (121, 85, 72, 255)),
    (1000, (158, 158, 158, 255)),
)
# Client palette.
CLEAR = (0, 0, 0, 0)
OCEAN, OPEN_WATER = (70, 130, 180, 255), (70, 130, 180, 220)
HAND_STOPS = ((0.0, (80, 190, 240, 115)), (0.55, (22, 124, 215, 165)), (1.0, (4, 48, 128, 215)))
HAND_NODATA = (189, 0, 255, 107)
RELIEF_MAX_M, RELIEF_SCALE_M = 6500.0, 120.0
RELIEF_STOPS = (
    (0, (34, 139, 34, 255)),
    (5, (76, 175, 80, 255)),
    (15, (154, 205, 50, 255)),
    (30, (189, 214, 102, 255)),
    (60, (210, 201, 128, 255)),
    (100, (201, 186, 130, 255)),
    (150, (184, 154, 108, 255)),
    (250, (160, 120, 80, 255)),
    (400, (135, 105, 80, 255)),
    (700, (120, 120, 120, 255)),
    (1200, (150, 150, 150, 255)),
    (2000, (185, 185, 185, 255)),
    (3000, (225, 225, 225, 255)),
    (4500, (245, 245, 245, 255)),
    (6500, (255, 255, 255, 255)),
)


def rgba(color: tuple[int, int, int, int]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip("rgba", color)])


def _mix(a, b, t: Column, nearest: bool) -> Column:
    """Blend two colours; truncate, or round halves up."""
    parts = []
    for n, va, vb in zip("rgba", a, b):
        m = F.lit(float(va)) * (1.0 - t) + F.lit(float(vb)) * t
        parts.append((F.floor(m + 0.5) if nearest else m).cast("int").alias(n))
    return F.struct(*parts)


def risk_to_rgba(risk: Column) -> Column:
    """0..1 risk level -> colour, truncated."""
    return F.when(risk <= 0.33, _mix(SAFE, CAUTION, risk / 0.33, False)) \
        .when(risk <= 0.66, _mix(CAUTION, DANGER, (risk - 0.33) / 0.33, False)) \
        .otherwise(_mix(DANGER, FLOODED, (risk - 0.66) / 0.34, False))


def flood_class_rgba(height: Column, level: Column) -> Column:
    """Four flat classes; NODATA counts as 0 m."""
    h = F.coalesce(height, F.lit(0.0))
    return F.when(h < level + 0.5, rgba(FLOODED)).when(h < level + 2.0, rgba(DANGER)) \
        .when(h < level + 5.0, rgba(CAUTION)).otherwise(rgba(SAFE))


def topo_rgba(height: Column) -> Column:
    """Elevation bands; NODATA counts as 0 m, below zero stays clear."""
    h = F.coalesce(height, F.lit(0.0))
    out = F.when(h < 0, rgba(CLEAR))
    for (_, color), (upper, _) in zip(TOPO_BANDS, TOPO_BANDS[1:]):
        out = out.when(h < upper, rgba(color))
    return out.otherwise(rgba(TOPO_BANDS[-1][1]))


def client_flood_rgba(height: Column, level: Column) -> Column:
    """Continuous colours; NODATA is open water, safe ground is clear."""
    rel = height - level
    return F.when(height.isNull(), rgba(OPEN_WATER)).when(rel >= 5.0, rgba(CLEAR)) \
        .when(rel >= 2.0, _mix(SAFE, CAUTION, (5.0 - rel) / 3.0, True)) \
        .when(rel >= 0.5, _mix(CAUTION, DANGER, (2.0 - rel) / 1.5, True)) \
        .when(rel >= -0.5, _mix(DANGER, FLOODED, (0.5 - rel) / 1.0, True)).otherwise(rgba(FLOODED))


def _ramp(df: DataFrame, t: str, stops, out: str, special: Column) -> DataFrame:
    """Add `out`: piecewise-linear ramp over (position, colour) stops at `t`, or `special` where that is not NULL.

    The segment number is found once and the colours are looked up in constant arrays, which keeps the
    generated code small enough to compile whatever the number of stops.
    """
    seg = F.lit(len(stops) - 1)
    for i in range(len(stops) - 2, -1, -1):
        seg = F.when(C(t) <= stops[i + 1][0], i + 1).otherwise(seg)
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), C("_seg"))
    starts = at([a[0] for a in stops[:-1]])
    widths = at([max(1e-12, b[0] - a[0]) for a, b in zip(stops, stops[1:])])
    parts = []
    for i, n in enumerate("rgba"):
        a, b = at([c[i] for _, c in stops[:-1]]), at([c[i] for _, c in stops[1:]])
        parts.append(F.floor(a * (1.0 - C("_u")) + b * C("_u") + 0.5).cast("int").alias(n))
    return df.withColumn("_seg", seg).withColumn("_u", F.least(F.lit(1.0), (C(t) - starts) / widths)) \
        .withColumn(out, F.coalesce(special, F.struct(*parts))).drop("_seg", "_u", t)


def hypsometric_rgba(df: DataFrame, height: str, out: str) -> DataFrame:
    """Add `out`: compressed relief ramp; NODATA and below sea level are ocean."""
    denom = math.asinh(RELIEF_MAX_M / RELIEF_SCALE_M)
    e = F.least(F.lit(RELIEF_MAX_M), C(height)) / RELIEF_SCALE_M
    stops = tuple((math.asinh(m / RELIEF_SCALE_M) / denom, c) for m, c in RELIEF_STOPS)
    ocean = F.when(C(height).isNull() | (C(height) < 0), rgba(OCEAN))
    return _ramp(df.withColumn("_t", F.ln(e + F.sqrt(e * e + 1.0)) / denom), "_t", stops, out, ocean)


def hand_depth_rgba(df: DataFrame, hand: str, threshold: str, out: str, show_nodata: bool = False) -> DataFrame:
    """Add `out`: apparent depth under a flood threshold; above it is clear."""
    thr = F.greatest(F.lit(0.0), C(threshold))
    depth = F.greatest(F.lit(0.0), thr - C(hand))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.exp(-depth / F.greatest(F.lit(0.8), thr * 0.08))))
    special = F.when(C(hand).isNull(), rgba(HAND_NODATA if show_nodata else CLEAR)).when(C(hand) > thr, rgba(CLEAR))
    return _ramp(df.withColumn("_t", t), "_t", HAND_STOPS, out, special)


def gray_scale_fixed(height: Column) -> Column:
    """-500..3500 m -> 0..255, clipped and truncated."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), (height + 500) / 4000.0 * 255)).cast("int")


def legend_classes(level: Column) -> Column:
    """array<struct<position,label,lower,upper,r,g,b,a>> for a water level."""
    from tilewater.functions.text import fixed1

    t = lambda off: fixed1(level + off)
    none = F.lit(None).cast("double")

    def entry(i, label, lo, hi, color):
        return F.struct(F.lit(i).alias("position"), label.alias("label"), lo.alias("lower"), hi.alias("upper"),
                        *[F.lit(v).alias(n) for n, v in zip("rgba", color)])

    between = lambda name, a, b: F.concat(F.lit(f"{name} ("), t(a), F.lit("-"), t(b), F.lit("m)"))
    return F.array(
        entry(0, F.concat(F.lit("Safe (>"), t(5.0), F.lit("m)")), level + 5.0, none, SAFE),
        entry(1, between("Caution", 2.0, 5.0), level + 2.0, level + 5.0, CAUTION),
        entry(2, between("Danger", 0.5, 2.0), level + 0.5, level + 2.0, DANGER),
        entry(3, F.concat(F.lit("Flooded (<"), t(0.5), F.lit("m)")), none, level + 0.5, FLOODED),
    )
