"""WGS84: metre offsets, UTM both ways, and the coordinate systems that rasters come in."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
N = FLAT / (2 - FLAT)
_RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
#: Coefficients of Krueger's series, to the fourth power of the third flattening.
ALPHA = (N / 2 - 2 / 3 * N**2 + 5 / 16 * N**3 + 41 / 180 * N**4, 13 / 48 * N**2 - 3 / 5 * N**3 + 557 / 1440 * N**4, 61 / 240 * N**3 - 103 / 140 * N**4, 49561 / 161280 * N**4)
BETA = (N / 2 - 2 / 3 * N**2 + 37 / 96 * N**3 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 / 1440 * N**4, 17 / 480 * N**3 - 37 / 840 * N**4, 4397 / 161280 * N**4)
DELTA = (2 * N - 2 / 3 * N**2 - 2 * N**3 + 116 / 45 * N**4, 7 / 3 * N**2 - 8 / 5 * N**3 - 227 / 45 * N**4, 56 / 15 * N**3 - 136 / 35 * N**4, 4279 / 630 * N**4)
SCALE, EAST, SOUTH = 0.9996, 500000.0, 10000000.0


def utm(lon: Column, lat: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Easting and northing as built-in expressions."""
    e = 2 * math.sqrt(N) / (1 + N)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST + SCALE * _RECTIFYING * x, F.lit(0.0 if north else SOUTH) + SCALE * _RECTIFYING * y


def utm_inverse(easting: float, northing: float, zone: int, north: bool = True) -> tuple[float, float]:
    """Longitude and latitude, on the driver."""
    xi, eta = (northing - (0 if north else SOUTH)) / (SCALE * _RECTIFYING), (easting - EAST) / (SCALE * _RECTIFYING)
    x, y = eta, xi
    for j, b in enumerate(BETA, 1):
        x -= b * math.cos(2 * j * xi) * math.sinh(2 * j * eta)
        y -= b * math.sin(2 * j * xi) * math.cosh(2 * j * eta)
    chi = math.asin(math.sin(y) / math.cosh(x))
    phi = chi + sum(d * math.sin(2 * j * chi) for j, d in enumerate(DELTA, 1))
    return zone * 6 - 183 + math.degrees(math.atan2(math.sinh(x), math.cos(y))), math.degrees(phi)


def direct(lon: np.ndarray, lat: np.ndarray, azimuth: np.ndarray, metres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vincenty's direct solution: where a geodesic ends."""
    u = np.arctan((1 - FLAT) * np.tan(np.radians(lat)))
    az = np.radians(azimuth)
    sigma1 = np.arctan2(np.tan(u), np.cos(az))
    sin_a = np.cos(u) * np.sin(az)
    cos2 = 1 - sin_a**2
    k = cos2 * (A * A - B * B) / (B * B)
    big_a, big_b = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k))), k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    sigma = metres / (B * big_a)
    for _ in range(30):
        m = np.cos(2 * sigma1 + sigma)
        step = big_b * np.sin(sigma) * (m + big_b / 4 * (np.cos(sigma) * (2 * m * m - 1) - big_b / 6 * m * (4 * np.sin(sigma) ** 2 - 3) * (4 * m * m - 3)))
        sigma = metres / (B * big_a) + step
    m = np.cos(2 * sigma1 + sigma)
    s, c = np.sin(sigma), np.cos(sigma)
    phi = np.arctan2(np.sin(u) * c + np.cos(u) * s * np.cos(az), (1 - FLAT) * np.hypot(sin_a, np.sin(u) * s - np.cos(u) * c * np.cos(az)))
    lam = np.arctan2(s * np.sin(az), np.cos(u) * c - np.sin(u) * s * np.cos(az))
    cc = FLAT / 16 * cos2 * (4 + FLAT * (4 - 3 * cos2))
    far = lam - (1 - cc) * FLAT * sin_a * (sigma + cc * s * (m + cc * c * (2 * m * m - 1)))
    return lon + np.degrees(far), np.degrees(phi)


def _moved(lon: pd.Series, lat: pd.Series, east: pd.Series, north: pd.Series) -> pd.DataFrame:
    x, y = lon.to_numpy(dtype=float), lat.to_numpy(dtype=float)
    for d, plus in ((east.to_numpy(dtype=float), 90.0), (north.to_numpy(dtype=float), 0.0)):
        nx, ny = direct(x, y, np.where(d >= 0, plus, plus + 180.0), np.abs(d))
        x, y = np.where(d == 0, x, nx), np.where(d == 0, y, ny)
    return pd.DataFrame({"lon": x, "lat": y})


def offset(lon: Column, lat: Column, east: Column, north: Column) -> Column:
    """struct<lon, lat>: a place moved by metres east or west, and from there by metres north or south; 0 leaves a leg out."""
    return F.pandas_udf(_moved, "lon double, lat double")(lon, lat, east, north)


def crs_of(wkt: str | None) -> tuple[str, int, bool] | None:
    """("wgs84", 0, True), ("utm", zone, north) or ("mercator", 0, True) of a WKT or EPSG text; null for a blank one; raises ValueError for others.

    UTM on ETRS89 and NAD83 counts as on WGS84, from which they are off by a metre or two.
    """
    text = (wkt or "").strip()
    if not text:
        return None
    codes = re.findall(r"(?:EPSG[\"':,\s\]\[ID(]*)(\d{4,5})", text)
    code = int(codes[-1]) if codes else 0
    zone = re.search(r"UTM zone (\d{1,2})([NS])", text)
    if zone and 1 <= int(zone[1]) <= 60:
        return "utm", int(zone[1]), zone[2] == "N"
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return "utm", code % 100, code < 32700
    if 25828 <= code <= 25838 or 26901 <= code <= 26923:
        return "utm", code % 100, True
    if code == 3857:
        return "mercator", 0, True
    if code == 4326 or re.match(r"GEOG(CS|CRS)\[\"WGS[ _]?(19)?84", text):
        return "wgs84", 0, True
    raise ValueError(f"unsupported coordinate system: {text[:80]}")


def metres_to_pixels(pixel_x: float, pixel_y: float) -> float:
    """Pixels a metre, of the mean pixel size; raises ValueError for none."""
    size = (abs(pixel_x) + abs(pixel_y)) / 2
    if size <= 0:
        raise ValueError("the pixel size must be positive")
    return 1 / size


def world_to_pixel(x: Column, y: Column, origin_x: float, origin_y: float, pixel_x: float, pixel_y: float) -> tuple[Column, Column]:
    """Places in the raster, unrounded."""
    return (x - origin_x) / pixel_x, (y - origin_y) / pixel_y


def to_raster(lon: Column, lat: Column, wkt: str | None, stem: str = "") -> tuple[Column, Column]:
    """Longitude and latitude in the raster's system, or in that of its name (utm33n); raises ValueError without either."""
    from .columns import zone_of_name

    crs = crs_of(wkt)
    if crs and crs[0] == "wgs84":
        return lon, lat
    if crs and crs[0] == "mercator":
        return F.radians(lon) * A, F.asinh(F.tan(F.radians(lat))) * A
    zone = crs[1:] if crs else zone_of_name(stem)
    if not zone:
        raise ValueError("the raster has no coordinate system, and its name gives none")
    return utm(lon, lat, *zone)


def origin_wgs84(x: float, y: float, wkt: str | None) -> tuple[float, float]:
    """A raster's upper left corner; without a system it is taken as longitude and latitude."""
    crs = crs_of(wkt)
    if crs and crs[0] == "mercator":
        return math.degrees(x / A), math.degrees(math.atan(math.sinh(y / A)))
    return utm_inverse(x, y, crs[1], crs[2]) if crs and crs[0] == "utm" else (x, y)
