"""Distances, world pixels and the Albers equal-area projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0088
VIEW_MAX_LAT = 85.051129


def view_lat(lat: Column) -> Column:
    return F.greatest(F.lit(-VIEW_MAX_LAT), F.least(F.lit(VIEW_MAX_LAT), lat))


def wrap_lon(lon: Column) -> Column:
    """Longitude in (-180, 180]."""
    w = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return F.when(w == -180.0, 180.0).otherwise(w)


def world_pixel(lon: Column, lat: Column, z: Column, tile: int = 256) -> Column:
    """struct<wx,wy,scale>: pixel position on the whole world map."""
    scale = F.pow(F.lit(2.0), F.greatest(F.lit(0), z)) * float(tile)
    s = F.sin(F.radians(view_lat(lat)))
    wy = (F.lit(0.5) - F.ln((1.0 + s) / (1.0 - s)) / (4.0 * math.pi)) * scale
    return F.struct(((wrap_lon(lon) + 180.0) / 360.0 * scale).alias("wx"), wy.alias("wy"), scale.alias("scale"))


def _half_chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2.0, F.radians(lon2 - lon1) / 2.0
    return F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), F.lit(2.0))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance, arcsine form, with wrapped longitudes and clipped latitudes."""
    h = _half_chord(wrap_lon(lon1), view_lat(lat1), wrap_lon(lon2), view_lat(lat2))
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2.0 * EARTH_RADIUS_KM)


def haversine_km_atan(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance, two-argument arctangent form, coordinates used as given."""
    h = _half_chord(lon1, lat1, lon2, lat2)
    return F.atan2(F.sqrt(h), F.sqrt(1.0 - h)) * (2.0 * EARTH_RADIUS_KM)


class Albers:
    """Ellipsoidal Albers equal-area conic (Snyder 1987, p. 101). Defaults are CONUS Albers, EPSG:5070."""

    def __init__(self, lat1: float = 29.5, lat2: float = 45.5, lat0: float = 23.0, lon0: float = -96.0,
                 a: float = 6378137.0, f: float = 1.0 / 298.257222101) -> None:
        self.a, self.lon0 = a, lon0
        self.e2 = f * (2.0 - f)
        self.e = math.sqrt(self.e2)
        m1, m2 = self._m(lat1), self._m(lat2)
        q1, q2, q0 = self._q(lat1), self._q(lat2), self._q(lat0)
        self.n = (m1 * m1 - m2 * m2) / (q2 - q1)
        self.c = m1 * m1 + self.n * q1
        self.rho0 = a * math.sqrt(self.c - self.n * q0) / self.n

    def _m(self, lat: float) -> float:
        s = math.sin(math.radians(lat))
        return math.cos(math.radians(lat)) / math.sqrt(1.0 - self.e2 * s * s)

    def _q(self, lat: float) -> float:
        s, e = math.sin(math.radians(lat)), self.e
        return (1.0 - self.e2) * (s / (1.0 - self.e2 * s * s) - math.log((1.0 - e * s) / (1.0 + e * s)) / (2.0 * e))

    def forward(self, lon: Column, lat: Column) -> Column:
        """struct<px,py> in metres."""
        s = F.sin(F.radians(lat))
        q = (s / (1.0 - self.e2 * s * s)
             - F.ln((1.0 - self.e * s) / (1.0 + self.e * s)) / (2.0 * self.e)) * (1.0 - self.e2)
        rho = F.sqrt(F.lit(self.c) - q * self.n) * self.a / self.n
        theta = F.radians(lon - self.lon0) * self.n
        return F.struct((rho * F.sin(theta)).alias("px"), (F.lit(self.rho0) - rho * F.cos(theta)).alias("py"))

    def inverse(self, px: Column, py: Column) -> Column:
        """struct<lon,lat>; the authalic latitude series is exact to well below a millimetre."""
        e2, e4, e6 = self.e2, self.e2 ** 2, self.e2 ** 3
        dy = F.lit(self.rho0) - py
        rho = F.sqrt(px * px + dy * dy)
        q = (F.lit(self.c) - F.pow(rho * self.n / self.a, F.lit(2.0))) / self.n
        qp = 1.0 - (1.0 - e2) / (2.0 * self.e) * math.log((1.0 - self.e) / (1.0 + self.e))
        beta = F.asin(q / qp)
        lat = (beta + F.sin(beta * 2.0) * (e2 / 3.0 + 31.0 * e4 / 180.0 + 517.0 * e6 / 5040.0)
               + F.sin(beta * 4.0) * (23.0 * e4 / 360.0 + 251.0 * e6 / 3780.0)
               + F.sin(beta * 6.0) * (761.0 * e6 / 45360.0))
        lon = F.degrees(F.atan2(px, dy) / self.n) + self.lon0
        return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))


ALBERS_CONUS = Albers()
