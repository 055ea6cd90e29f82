"""From the coordinate systems that layers come in to longitude and latitude on WGS84, over arrays of places."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np

Places = tuple[np.ndarray, np.ndarray]

#: Parts of the names of datums that are within a metre or two of WGS84.
SAME_DATUMS = ("wgs1984", "wgs84", "etrs1989", "etrs89", "europeanterrestrialreferencesystem", "northamerican1983", "northamericandatum1983", "nad83", "rgf1993", "rgf93", "reseaugeodesiquefrancais1993", "gda94", "gda1994", "gda2020", "geocentricdatumofaustralia", "itrf", "jgd2000", "jgd2011", "sirgas2000", "nzgd2000", "newzealandgeodeticdatum2000", "majorauxiliarysphere")


def parse_wkt(text: str) -> tuple[str, list]:
    """A well-known text as nested (keyword, values); raises ValueError for anything else."""
    parts = re.findall(r'"(?:[^"]|"")*"|[A-Za-z_][A-Za-z0-9_]*|[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?|[\[\](),]', text)
    at = 0

    def node() -> tuple[str, list]:
        nonlocal at
        name, values = parts[at].upper(), []
        at += 1
        if at >= len(parts) or parts[at] not in "[(":
            return name, values
        while parts[at] not in "])":
            at += 1
            if parts[at][0] == '"':
                values.append(parts[at][1:-1].replace('""', '"'))
                at += 1
            elif parts[at][0].isalpha():
                values.append(node())
            else:
                values.append(float(parts[at]))
                at += 1
        at += 1
        return name, values

    try:
        return node()
    except (IndexError, ValueError):
        raise ValueError(f"not a coordinate system: {text[:80]!r}") from None


def _child(node: tuple[str, list], *names: str) -> tuple[str, list] | None:
    return next((v for v in node[1] if isinstance(v, tuple) and v[0] in names), None)


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


@dataclass(frozen=True)
class Ellipsoid:
    """An ellipsoid by its major half axis and flattening."""

    a: float = 6378137.0
    f: float = 1 / 298.257223563

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)


def transverse_mercator_inverse(x: np.ndarray, y: np.ndarray, el: Ellipsoid, lon0: float, lat0: float, scale: float) -> Places:
    """Krueger's series, to the fourth power of the third flattening; x and y are metres from the false origin, angles are radians."""
    n = el.f / (2 - el.f)
    radius = el.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4)
    beta = (n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4)
    chi0 = math.atan(math.sinh(math.asinh(math.tan(lat0)) - el.e * math.atanh(el.e * math.sin(lat0))))
    xi0 = chi0 + sum(c * math.sin(2 * j * chi0) for j, c in enumerate(alpha, 1))
    xi, eta = y / (scale * radius) + xi0, x / (scale * radius)
    p, q = xi.copy(), eta.copy()
    for j, b in enumerate(beta, 1):
        p -= b * np.sin(2 * j * xi) * np.cosh(2 * j * eta)
        q -= b * np.cos(2 * j * xi) * np.sinh(2 * j * eta)
    return lon0 + np.arctan2(np.sinh(q), np.cos(p)), _geographic(np.arcsin(np.sin(p) / np.cosh(q)), el)


def _geographic(chi: np.ndarray, el: Ellipsoid) -> np.ndarray:
    """The latitude of a conformal one, by iteration."""
    psi = np.arctanh(np.sin(chi))
    phi = chi
    for _ in range(12):
        phi = np.arcsin(np.tanh(psi + el.e * np.arctanh(el.e * np.sin(phi))))
    return phi


def mercator_inverse(x: np.ndarray, y: np.ndarray, el: Ellipsoid, lon0: float, scale: float, sphere: bool) -> Places:
    """Mercator on the ellipsoid, or on the sphere of its major half axis."""
    chi = np.arctan(np.sinh(y / (el.a * scale)))
    return lon0 + x / (el.a * scale), chi if sphere else _geographic(chi, el)


def conic_inverse(x: np.ndarray, y: np.ndarray, el: Ellipsoid, lon0: float, lat0: float, lat1: float, lat2: float, scale: float) -> Places:
    """Lambert's conformal conic with one or two standard parallels."""
    m = lambda p: math.cos(p) / math.sqrt(1 - el.e2 * math.sin(p) ** 2)
    t = lambda p: math.exp(-(math.asinh(math.tan(p)) - el.e * math.atanh(el.e * math.sin(p)))) if abs(p) < math.pi / 2 else 0.0
    n = math.sin(lat1) if abs(lat1 - lat2) < 1e-12 else math.log(m(lat1) / m(lat2)) / math.log(t(lat1) / t(lat2))
    big = el.a * scale * m(lat1) / (n * t(lat1) ** n)
    rho0 = big * t(lat0) ** n
    rho = np.copysign(np.hypot(x, rho0 - y), n)
    theta = np.arctan2(math.copysign(1, n) * x, math.copysign(1, n) * (rho0 - y))
    psi = -np.log(np.maximum(rho / big, 1e-300)) / n
    return lon0 + theta / n, _geographic(np.arctan(np.sinh(psi)), el)


def equal_area_inverse(x: np.ndarray, y: np.ndarray, el: Ellipsoid, lon0: float, lat0: float) -> Places:
    """Lambert's azimuthal equal-area projection, oblique."""
    e, e2 = el.e, el.e2
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)
    qp, q0 = q(1 - 1e-16), q(math.sin(lat0))
    rq, b0 = el.a * math.sqrt(qp / 2), math.asin(q0 / qp)
    d = el.a * math.cos(lat0) / math.sqrt(1 - e2 * math.sin(lat0) ** 2) / (rq * math.cos(b0))
    rho = np.hypot(x / d, d * y)
    c = 2 * np.arcsin(np.clip(rho / (2 * rq), -1, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        beta = np.where(rho == 0, b0, np.arcsin(np.cos(c) * math.sin(b0) + np.where(rho == 0, 0, d * y * np.sin(c) * math.cos(b0) / rho)))
    lon = lon0 + np.arctan2(x * np.sin(c), d * rho * math.cos(b0) * np.cos(c) - d * d * y * math.sin(b0) * np.sin(c))
    phi, target = beta.copy(), qp * np.sin(beta)
    for _ in range(12):  # Newton's steps to the latitude of an authalic one
        s = np.sin(phi)
        now = (1 - e2) * (s / (1 - e2 * s * s) + np.arctanh(e * s) / e)
        phi = phi + (target - now) * (1 - e2 * s * s) ** 2 / (2 * (1 - e2) * np.maximum(np.cos(phi), 1e-12))
    return lon, phi


def shift_datum(lon: np.ndarray, lat: np.ndarray, el: Ellipsoid, to: list[float]) -> Places:
    """Radians on one datum to radians on WGS84, by three shifts (metres), three rotations (arc seconds) and a scale (parts per million)."""
    dx, dy, dz, rx, ry, rz, ppm = [*to, *[0.0] * 7][:7]
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    nu = el.a / np.sqrt(1 - el.e2 * np.sin(lat) ** 2)
    x, y, z = nu * np.cos(lat) * np.cos(lon), nu * np.cos(lat) * np.sin(lon), nu * (1 - el.e2) * np.sin(lat)
    k = 1 + ppm * 1e-6
    x, y, z = dx + k * (x - rz * y + ry * z), dy + k * (rz * x + y - rx * z), dz + k * (-ry * x + rx * y + z)
    w, p = Ellipsoid(), np.hypot(x, y)
    phi = np.arctan2(z, p * (1 - w.e2))
    for _ in range(8):
        nu = w.a / np.sqrt(1 - w.e2 * np.sin(phi) ** 2)
        phi = np.arctan2(z + w.e2 * nu * np.sin(phi), p)
    return np.arctan2(y, x), phi


class ToWgs84:
    """A layer's way to longitude and latitude, from its well-known text; raises ValueError for a system that it doesn't know."""

    def __init__(self, wkt: str) -> None:
        root = parse_wkt(wkt)
        geo = root if root[0] in ("GEOGCS", "GEOGCRS", "GEODCRS") else _child(root, "GEOGCS", "BASEGEOGCRS", "BASEGEODCRS")
        if geo is None or root[0] not in ("GEOGCS", "GEOGCRS", "GEODCRS", "PROJCS", "PROJCRS"):
            raise ValueError(f"unsupported coordinate system: {wkt[:80]}")
        datum = _child(geo, "DATUM", "ENSEMBLE") or ("DATUM", [""])
        spheroid = _child(datum, "SPHEROID", "ELLIPSOID") or ("SPHEROID", ["", 6378137.0, 298.257223563])
        self.ellipsoid = Ellipsoid(spheroid[1][1], 1 / spheroid[1][2] if spheroid[1][2] else 0.0)
        shift = _child(datum, "TOWGS84")
        self.shift = shift[1] if shift and any(shift[1]) else None
        if shift is None and not any(k in _plain(datum[1][0]) for k in SAME_DATUMS):
            raise ValueError(f"the datum {datum[1][0]!r} has no known shift to WGS84")
        self.turn = (_child(geo, "UNIT", "ANGLEUNIT") or ("UNIT", ["degree", math.pi / 180]))[1][1]
        self.greenwich = (_child(geo, "PRIMEM") or ("PRIMEM", ["", 0.0]))[1][1] * self.turn
        self.method = None
        if root[0] in ("PROJCS", "PROJCRS"):
            held = _child(root, "CONVERSION") or root
            self.method = _plain(str((_child(held, "PROJECTION", "METHOD") or ("", [""]))[1][0]))
            self.values = {_plain(v[1][0]): v[1][1] for v in held[1] if isinstance(v, tuple) and v[0] == "PARAMETER"}
            self.metre = (_child(root, "UNIT", "LENGTHUNIT") or ("UNIT", ["metre", 1.0]))[1][1]
            self(np.zeros(1), np.zeros(1))

    def _get(self, *names: str, default: float = 0.0) -> float:
        return next((self.values[n] for n in names if n in self.values), default)

    def __call__(self, x: np.ndarray, y: np.ndarray) -> Places:
        """Longitudes and latitudes in degrees."""
        if self.method is None:
            lon, lat = x * self.turn, y * self.turn
        else:
            east = x * self.metre - self._get("falseeasting", "eastingatfalseorigin") * self.metre
            north = y * self.metre - self._get("falsenorthing", "northingatfalseorigin") * self.metre
            lon0 = self._get("centralmeridian", "longitudeofcenter", "longitudeofnaturalorigin", "longitudeoffalseorigin") * self.turn
            lat0 = self._get("latitudeoforigin", "latitudeofcenter", "latitudeofnaturalorigin", "latitudeoffalseorigin") * self.turn
            scale = self._get("scalefactor", "scalefactoratnaturalorigin", default=1.0)
            lat1 = self._get("standardparallel1", "latitudeof1ststandardparallel", default=lat0 / self.turn) * self.turn
            lat2 = self._get("standardparallel2", "latitudeof2ndstandardparallel", default=lat1 / self.turn) * self.turn
            if self.method in ("transversemercator", "gausskruger"):
                lon, lat = transverse_mercator_inverse(east, north, self.ellipsoid, lon0, lat0, scale)
            elif self.method in ("mercatorauxiliarysphere", "popularvisualisationpseudomercator"):
                lon, lat = mercator_inverse(east, north, self.ellipsoid, lon0, 1.0, True)
            elif self.method in ("mercator", "mercator1sp", "mercatorvarianta"):
                lon, lat = mercator_inverse(east, north, self.ellipsoid, lon0, scale, False)
            elif self.method.startswith("lambertconformalconic") or self.method.startswith("lambertconicconformal"):
                lon, lat = conic_inverse(east, north, self.ellipsoid, lon0, lat0, lat1, lat2, scale)
            elif self.method == "lambertazimuthalequalarea":
                lon, lat = equal_area_inverse(east, north, self.ellipsoid, lon0, lat0)
            else:
                raise ValueError(f"unsupported projection: {self.method}")
        lon = lon + self.greenwich
        if self.shift is not None:
            lon, lat = shift_datum(lon, lat, self.ellipsoid, self.shift)
        return np.degrees(lon), np.degrees(lat)
