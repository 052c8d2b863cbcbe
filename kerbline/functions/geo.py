"""Geodesy as column expressions: haversine, transverse Mercator both ways, geocentric coordinates.

Degrees in and out. The Mercator series is Krueger's to the fourth order in the third flattening, good
to well under a millimetre within a zone; the northern hemisphere.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6_371_000.0
FALSE_EASTING, SCALE = 500_000.0, 0.9996


class Ellipsoid(NamedTuple):
    a: float
    f: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


#: Semi-major axis and inverse flattening.
ELLIPSOIDS = {name: Ellipsoid(a, 1 / f) for name, a, f in (("WGS84", 6378137.0, 298.257223563), ("GRS80", 6378137.0, 298.257222101), ("Bessel1841", 6377397.155, 299.1528128), ("International1924", 6378388.0, 297.0), ("Krassowsky1940", 6378245.0, 298.3), ("Airy1830", 6377563.396, 299.3249646), ("Clarke1866", 6378206.4, 294.9786982), ("Clarke1880", 6378249.145, 293.465), ("Everest1830", 6377276.345, 300.8017), ("GRS67", 6378160.0, 298.247167427), ("WGS72", 6378135.0, 298.26), ("Hayford1909", 6378388.0, 297.0))}
WGS84 = ELLIPSOIDS["WGS84"]


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dp / 2) * F.sin(dp / 2) + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) * F.sin(dl / 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(a))


def _series(e: Ellipsoid) -> tuple[float, list[float], list[float], list[float]]:
    n = e.f / (2 - e.f)
    rectifying = e.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    return rectifying, alpha, beta, delta


def to_utm(lon: Column, lat: Column, zone: int, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    """Easting and northing."""
    rectifying, alpha, _, _ = _series(e)
    ecc = math.sqrt(e.e2)
    p, l = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183.0))
    t = F.sinh(F.atanh(F.sin(p)) - ecc * F.atanh(ecc * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(l)), F.asinh(F.sin(l) / F.sqrt(t * t + F.cos(l) * F.cos(l)))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(FALSE_EASTING) + SCALE * rectifying * east, SCALE * rectifying * north


def from_utm(east: Column, north: Column, zone: int, e: Ellipsoid = WGS84) -> tuple[Column, Column]:
    """Longitude and latitude."""
    rectifying, _, beta, delta = _series(e)
    xi, eta = north / (SCALE * rectifying), (east - FALSE_EASTING) / (SCALE * rectifying)
    x, h = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        h = h - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(h))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.lit(6.0 * zone - 183.0) + F.degrees(F.atan2(F.sinh(h), F.cos(x))), F.degrees(lat)


def to_geocentric(lon: Column, lat: Column, height: Column, e: Ellipsoid = WGS84) -> tuple[Column, Column, Column]:
    p, l = F.radians(lat), F.radians(lon)
    n = e.a / F.sqrt(1 - e.e2 * F.sin(p) * F.sin(p))
    return (n + height) * F.cos(p) * F.cos(l), (n + height) * F.cos(p) * F.sin(l), (n * (1 - e.e2) + height) * F.sin(p)


def from_geocentric(x: Column, y: Column, z: Column, e: Ellipsoid = WGS84, steps: int = 5) -> tuple[Column, Column, Column]:
    """Longitude, latitude and height by Bowring's start and a fixed number of unrolled steps."""
    r = F.sqrt(x * x + y * y)
    b = e.a * (1 - e.f)
    u = F.atan2(z * e.a, r * b)
    p = F.atan2(z + (e.a**2 - b**2) / b * F.pow(F.sin(u), 3), r - e.e2 * e.a * F.pow(F.cos(u), 3))
    for _ in range(min(steps, 1)):
        u = F.atan2((1 - e.f) * F.sin(p), F.cos(p))
        p = F.atan2(z + (e.a**2 - b**2) / b * F.pow(F.sin(u), 3), r - e.e2 * e.a * F.pow(F.cos(u), 3))
    n = e.a / F.sqrt(1 - e.e2 * F.sin(p) * F.sin(p))
    height = r * F.cos(p) + z * F.sin(p) - e.a * e.a / n
    return F.degrees(F.atan2(y, x)), F.degrees(p), height


def normal_gravity(lat: Column) -> Column:
    """Somigliana's formula, metres a second squared."""
    s = F.sin(F.radians(lat)) * F.sin(F.radians(lat))
    return 9.7803253359 * (1 + 0.00193185265241 * s) / F.sqrt(1 - WGS84.e2 * s)


def geodesic_inverse(lon1: Column, lat1: Column, lon2: Column, lat2: Column, e: Ellipsoid = WGS84, steps: int = 12) -> Column:
    """Metres along the ellipsoid by Vincenty's iteration with a fixed number of steps, over whole batches of rows.

    Equal points give 0. Within half a degree of antipodes the iteration may not converge: null there."""
    b = e.a * (1 - e.f)

    @F.pandas_udf("double")
    def metres(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
        u1, u2 = (np.arctan((1 - e.f) * np.tan(np.radians(v.to_numpy(float, na_value=np.nan)))) for v in (lat1, lat2))
        l = np.radians((lon2 - lon1).to_numpy(float, na_value=np.nan))
        s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)

        def around(lam: np.ndarray) -> tuple[np.ndarray, ...]:
            x, y = c2 * np.sin(lam), c1 * s2 - s1 * c2 * np.cos(lam)
            sin = np.sqrt(x * x + y * y)
            cos = s1 * s2 + c1 * c2 * np.cos(lam)
            alpha = np.where(sin > 0, c1 * c2 * np.sin(lam) / sin, 0.0)
            square = 1 - alpha * alpha
            mid = np.where(square > 1e-12, cos - 2 * s1 * s2 / square, 0.0)
            return sin, cos, np.arctan2(sin, cos), alpha, square, mid

        with np.errstate(all="ignore"):
            lam, moved = l, np.ones(len(l))
            for _ in range(steps):
                sin, cos, sigma, alpha, square, mid = around(lam)
                c = e.f / 16 * square * (4 + e.f * (4 - 3 * square))
                new = l + (1 - c) * e.f * alpha * (sigma + c * sin * (mid + c * cos * (2 * mid * mid - 1)))
                lam, moved = new, np.abs(new - lam)
            sin, cos, sigma, alpha, square, mid = around(lam)
            q = square * ((e.a * e.a - b * b) / (b * b))
            p = 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q)))
            r = q / 1024 * (256 + q * (-128 + q * (74 - 47 * q)))
            m2 = mid * mid
            off = r * sin * (mid + r / 4 * (cos * (2 * m2 - 1) - r / 6 * mid * (4 * sin * sin - 3) * (4 * m2 - 3)))
            out = b * p * (sigma - off)
        return pd.Series(np.where(moved < 1e-9, out, np.nan)).astype(object).where(moved < 1e-9, None)

    return metres(lon1, lat1, lon2, lat2)
