"""Small text builders for the twin SQL of the registered queries."""

from __future__ import annotations

CLIP = "greatest(-85.05112878e0, least(85.05112878e0, {}))"


def wx(lon: str, z: str) -> str:
    return f"(({lon} + 180e0) / 360e0 * pow(2e0, {z}))"


def wy(lat: str, z: str) -> str:
    return f"((1e0 - ln(tan(radians({lat})) + 1e0 / cos(radians({lat}))) / pi()) / 2e0 * pow(2e0, {z}))"


def clip(lat: str) -> str:
    return CLIP.format(lat)


def i32(expr: str) -> str:
    return f"cast({expr} AS integer)"


def tx(lon: str, z: str) -> str:
    return i32(f"trunc({wx(lon, z)})")


def ty(lat: str, z: str) -> str:
    return i32(f"trunc({wy(lat, z)})")


def top(y: str, z: str) -> str:
    return f"degrees(atan(sinh(pi() * (1e0 - 2e0 * ({y}) / pow(2e0, {z})))))"


def left(x: str, z: str) -> str:
    return f"(({x}) / pow(2e0, {z}) * 360e0 - 180e0)"


def degree_id(lat: str, lon: str) -> str:
    return (f"(CASE WHEN {lat} >= 0 THEN 'n' ELSE 's' END || lpad(cast(abs({lat}) AS varchar), 2, '0') || '_' || "
            f"CASE WHEN {lon} >= 0 THEN 'e' ELSE 'w' END || lpad(cast(abs({lon}) AS varchar), 3, '0') || '_1arc_v3')")


def pick(*branches: tuple[str, str], other: str = "NULL") -> str:
    """CASE WHEN chain."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {other} END"
