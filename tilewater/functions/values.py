"""Value encodings, flood classes and units as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewater.functions.text import fixed1

# Fixed values of the data model.
NODATA_I16 = -32768
NODATA_I16_OLD = -32767
NODATA_U16 = 65535
ELEV_MIN, ELEV_MAX, ELEV_SPAN, CODE_MAX = -500, 9000, 9500, 65534
FEET_TO_M, M_TO_FEET, DM_TO_FEET = 0.3048, 3.28084, 0.328084


def in_elevation_range(v: Column) -> Column:
    return v.between(ELEV_MIN, ELEV_MAX)


def normalize_nodata(v: Column) -> Column:
    """Both integer sentinels become NULL."""
    return F.when(~v.isin(NODATA_I16, NODATA_I16_OLD), v)


def encode_elevation(v: Column, form: str = "v1") -> Column:
    """Metres -> 0..65534, anything else 65535.

    `v1` computes in double and keeps one float32 step before truncation; `f32` keeps every step in float32.
    The two differ by one code for a few whole metres, so both are provided.
    """
    if form == "v1":
        code = F.floor(((v + 500) / F.lit(9500.0) * 65534).cast("float")).cast("int")
    elif form == "f32":
        up = (v.cast("float") + F.lit(500).cast("float")).cast("float")
        code = F.floor(((up / F.lit(9500.0)).cast("float") * F.lit(65534).cast("float")).cast("float")).cast("int")
    else:
        raise ValueError(f"unknown form {form}")
    ok = v.isNotNull() & ~F.isnan(v.cast("double")) & in_elevation_range(v)
    return F.when(ok, code).otherwise(NODATA_U16)


def decode_elevation(code: Column) -> Column:
    """Code -> metres in single precision, NULL for NODATA."""
    f = lambda c: c.cast("float")
    unit = f(f(code) / f(F.lit(65534)))
    return F.when(code != NODATA_U16, f(f(unit * f(F.lit(9500))) - f(F.lit(500))))


def encode_hand(v: Column, source_nodata: float | None = None) -> Column:
    """Metres above drainage -> decimetres, half to even in single precision, clipped to 65534."""
    f = v.cast("float")
    ok = v.isNotNull() & ~F.isnan(f) & (f >= 0) & (f < float("inf"))
    if source_nodata is not None:
        ok = ok & (f != F.lit(float(source_nodata)).cast("float"))
    code = F.rint((f * F.lit(10.0).cast("float")).cast("float"))
    return F.when(ok, F.least(code, F.lit(float(CODE_MAX))).cast("int")).otherwise(NODATA_U16)


def decode_hand(code: Column) -> Column:
    return F.when(code != NODATA_U16, (code.cast("float") / F.lit(10.0).cast("float")).cast("float"))


def flood_risk_class(height: Column, level: Column, tile_found: Column) -> Column:
    """A missing tile is `unknown`; a NODATA pixel inside a tile is `water`."""
    rel = height - level
    return F.when(~tile_found, "unknown").when(height.isNull(), "water") \
        .when(rel < 0.5, "very_high").when(rel < 2.0, "high").when(rel < 5.0, "moderate").otherwise("low")


def flood_risk_text(height: Column, level: Column, tile_found: Column, zoom: int) -> Column:
    rel = height - level
    tail = F.concat(fixed1(rel), F.lit(f"m above water level (z{zoom} sample)"))
    return F.when(~tile_found, f"No elevation data available (z{zoom} sample)") \
        .when(height.isNull(), f"Open water / no land elevation at this point (z{zoom} sample)") \
        .when(rel < 0.5, F.concat(F.lit("Very high flood risk - "), tail)) \
        .when(rel < 2.0, F.concat(F.lit("High flood risk - "), tail)) \
        .when(rel < 5.0, F.concat(F.lit("Moderate flood risk - "), tail)) \
        .otherwise(F.concat(F.lit("Low flood risk - "), tail))


def flood_risk_level(height: Column, level: Column) -> Column:
    """0 (safe) .. 1 (flooded), linear between the class borders."""
    rel = height - level
    return F.when(rel >= 5.0, 0.0) \
        .when(rel >= 2.0, (5.0 - rel) / 3.0 * 0.33) \
        .when(rel >= 0.5, (2.0 - rel) / 1.5 * 0.33 + 0.33) \
        .when(rel >= -0.5, (0.5 - rel) / 1.0 * 0.34 + 0.66).otherwise(1.0)


def water_level_key(level: Column, z: Column, x: Column, y: Column) -> Column:
    """Cache key of a level clustered to 0.1 m, halves to even."""
    tenths = F.rint(level * 10)
    whole = F.abs(tenths).cast("bigint")
    shown = F.concat(F.when(tenths < 0, "-").otherwise(""), F.floor(whole / 10).cast("string"), F.lit("."),
                     (whole % 10).cast("string"), F.lit("0"))
    return F.concat_ws(":", shown, z.cast("string"), x.cast("string"), y.cast("string"))


def slider_water_level(slider: Column) -> Column:
    return F.floor(F.pow(F.lit(10.0), slider / 25.0) * 0.1 * 10 + 0.5) / 10.0


def water_level_slider(level: Column) -> Column:
    return F.log10(level / 0.1) * 25.0


# Fixed values: (upper level, label) and (upper level, mood) bands.
LEVEL_LABELS = ((0.5, "Puddle"), (3, "Street Flood"), (10, "Neighborhood"), (75, "City Flood"), (1000, "Mega Flood"))
LEVEL_LABEL_LAST = "Apocalypse"
LEVEL_MOODS = ((0.5, "vibe-normal"), (3, "vibe-concerning"), (10, "vibe-dangerous"), (1000, "vibe-extreme"))
LEVEL_MOOD_LAST = "vibe-apocalyptic"


def banded(level: Column, bands, last: str) -> Column:
    out = F.when(level <= bands[0][0], bands[0][1])
    for upper, name in bands[1:]:
        out = out.when(level <= upper, name)
    return out.otherwise(last)


# Thresholds in feet that the reports use.
REPORT_FEET = (1, 3, 6, 10, 20, 30)


def threshold_code(feet: Column, rounding: str = "round") -> Column:
    """Largest decimetre code at or under a threshold in feet.

    `round` rounds the decimetres half to even (20 ft -> 61), `exact` keeps codes <= the exact value (20 ft -> 60).
    """
    dm = feet * FEET_TO_M * 10.0
    if rounding == "round":
        return F.rint(dm).cast("int")
    if rounding == "exact":
        return F.floor(dm).cast("int")
    raise ValueError(f"unknown rounding {rounding}")


def height_units(metres: Column) -> Column:
    return F.struct(metres.alias("height_m"), (metres * M_TO_FEET).alias("height_ft"))


def tile_data_status(found: Column, all_nodata: Column) -> Column:
    """struct<status,cache>: what a tile response says about its data and how long it may be cached."""
    status = F.when(~found, "build-miss").when(all_nodata, "source-nodata").otherwise("ok")
    cache = F.when(~found, "build_miss").when(all_nodata, "source_nodata").otherwise("hit")
    return F.struct(status.alias("status"), cache.alias("cache"))
