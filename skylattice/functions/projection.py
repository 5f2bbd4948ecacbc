"""Map projections of model grids, after Snyder (USGS PP 1395) and EPSG GN 7-2.

The formulas take either numbers or Spark columns, so a projection can be evaluated
on the driver for four corners or within a plan for every row.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_PI, QUARTER_PI = math.pi / 2, math.pi / 4


def _f(name: str):
    plain, column = getattr(math, name), getattr(F, name)
    return lambda x: column(x) if isinstance(x, Column) else plain(x)


sin, cos, tan, log, radians, degrees, atan, exp = (_f(n) for n in ("sin", "cos", "tan", "log", "radians", "degrees", "atan", "exp"))


def two(name: str):
    plain, column = getattr(math, name), getattr(F, name)
    return lambda a, b: column(a, b) if isinstance(a, Column) or isinstance(b, Column) else plain(a, b)


atan2, hypot = two("atan2"), two("hypot")


def power(x, y: float):
    return F.pow(x, F.lit(y)) if isinstance(x, Column) else x**y


@dataclass(frozen=True)
class Ellipsoid:
    a: float = 6378137.0
    inverse_flattening: float = 298.257223563

    @property
    def e(self) -> float:
        f = 1 / self.inverse_flattening if self.inverse_flattening else 0.0
        return math.sqrt(2 * f - f * f)


WGS84 = Ellipsoid()
SPHERE = Ellipsoid(6370000.0, 0.0)


@dataclass(frozen=True)
class Projection:
    """``kind``: lcc, polar, mercator or latlon.  Angles in degrees."""

    kind: str
    lat_1: float = 0.0
    lat_2: float = 0.0
    lat_0: float = 0.0
    lon_0: float = 0.0
    ellipsoid: Ellipsoid = WGS84

    def parameters(self) -> dict:
        return asdict(self)

    # --- parts shared by forward and inverse

    def _m(self, lat: float) -> float:
        return math.cos(lat) / math.sqrt(1 - (self.ellipsoid.e * math.sin(lat)) ** 2)

    def _t(self, lat):
        e = self.ellipsoid.e
        s = sin(lat) * e
        return tan(QUARTER_PI - lat / 2) / power((1 - s) / (1 + s), e / 2)

    def _lat(self, t):
        """Latitude of an isometric t: of a number by fixed point; of a column, where steps
        would grow the expression, by the conformal latitude and a series of sines of its
        multiples, to within 1e-12 for the earth."""
        chi = HALF_PI - atan(t) * 2
        if not isinstance(t, Column):
            e, lat = self.ellipsoid.e, chi
            for _ in range(20):
                s = e * math.sin(lat)
                lat = HALF_PI - 2 * math.atan(t * ((1 - s) / (1 + s)) ** (e / 2))
            return lat
        e2 = self.ellipsoid.e**2
        # Coefficients by powers of e squared, for sines of 2, 4, 6 and 8 times.
        terms = (
            (1 / 2, 5 / 24, 1 / 12, 13 / 360, 3 / 160),
            (0, 7 / 48, 29 / 240, 811 / 11520, 81 / 2240),
            (0, 0, 7 / 120, 81 / 1120, 3029 / 53760),
            (0, 0, 0, 4279 / 161280, 883 / 20160),
        )
        lat = chi
        for k, own in enumerate(terms, 1):
            lat = lat + sin(chi * (2 * k)) * sum(c * e2**n for n, c in enumerate(own, 1))
        return lat

    def _cone(self) -> tuple[float, float, float]:
        """n, F and the radius of the origin."""
        one, two = math.radians(self.lat_1), math.radians(self.lat_2)
        m1, t1 = self._m(one), self._t(one)
        n = math.sin(one) if abs(one - two) < 1e-10 else (math.log(m1) - math.log(self._m(two))) / (math.log(t1) - math.log(self._t(two)))
        f = m1 / (n * t1**n)
        return n, f, self.ellipsoid.a * f * self._t(math.radians(self.lat_0)) ** n

    def _polar_scale(self) -> float:
        lat = math.radians(abs(self.lat_1))
        at_pole = 2 / math.sqrt((1 + self.ellipsoid.e) ** (1 + self.ellipsoid.e) * (1 - self.ellipsoid.e) ** (1 - self.ellipsoid.e))
        return self.ellipsoid.a * (at_pole if abs(lat - HALF_PI) < 1e-10 else self._m(lat) / self._t(lat))

    # --- projections

    def forward(self, lon, lat):
        """x and y of degrees, as numbers or columns."""
        if self.kind == "latlon":
            return lon, lat
        turn, phi = radians(lon - self.lon_0), radians(lat)
        if self.kind == "lcc":
            n, f, origin = self._cone()
            rho = power(self._t(phi), n) * (self.ellipsoid.a * f)
            return rho * sin(turn * n), origin - rho * cos(turn * n)
        if self.kind == "polar":
            south = self.lat_0 < 0
            rho = self._t(-phi if south else phi) * self._polar_scale()
            return rho * sin(turn), rho * cos(turn) * (1 if south else -1)
        k = self.ellipsoid.a * self._m(math.radians(self.lat_1))
        return turn * k, -log(self._t(phi)) * k

    def inverse(self, x, y):
        """Degrees of x and y, as numbers or columns."""
        if self.kind == "latlon":
            return x, y
        if self.kind == "lcc":
            n, f, origin = self._cone()
            sign = math.copysign(1, n)
            rho = hypot(x, origin - y) * sign
            t = power(rho / (self.ellipsoid.a * f), 1 / n)
            return degrees(atan2(x * sign, (origin - y) * sign) / n) + self.lon_0, degrees(self._lat(t))
        if self.kind == "polar":
            south = self.lat_0 < 0
            lat = self._lat(hypot(x, y) / self._polar_scale())
            return degrees(atan2(x, y if south else -y)) + self.lon_0, degrees(-lat if south else lat)
        k = self.ellipsoid.a * self._m(math.radians(self.lat_1))
        return degrees(x / k) + self.lon_0, degrees(self._lat(exp(-y / k)))


def from_attributes(attrs: dict, ellipsoid: Ellipsoid = WGS84) -> Projection:
    """The projection that a file's global attributes name (MAP_PROJ 1, 2, 3, 6)."""
    kind = int(attrs["MAP_PROJ"])
    f = lambda k: float(attrs.get(k, 0.0))
    if kind == 1:
        return Projection("lcc", f("TRUELAT1"), f("TRUELAT2"), f("CEN_LAT"), f("STAND_LON"), ellipsoid)
    if kind == 2:
        return Projection("polar", f("TRUELAT1"), 0.0, 90.0 if f("CEN_LAT") > 0 else -90.0, f("STAND_LON"), ellipsoid)
    if kind == 3:
        return Projection("mercator", f("TRUELAT1"), 0.0, 0.0, f("STAND_LON"), ellipsoid)
    if kind == 6:
        return Projection("latlon", ellipsoid=ellipsoid)
    raise ValueError(f"Unsupported MAP_PROJ {kind}")
