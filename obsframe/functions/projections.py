"""Map projections as column expressions (radians inside, degrees at the interface).

Closed forms; the forward Mollweide angle takes a fixed number of Newton steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: sphere of the sinusoidal grid, and the WGS84 equatorial radius (metres)
SINUSOIDAL_RADIUS = 6371007.181
WGS84_RADIUS = 6378137.0


@dataclass(frozen=True)
class Projection:
    """kind: lonlat, sinusoidal, mollweide or laea; lon0/lat0 in degrees."""

    kind: str
    lon0: float = 0.0
    lat0: float = 0.0
    radius: float = WGS84_RADIUS

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """(lon, lat) in degrees to (x, y)."""
        if self.kind == "lonlat":
            return lon, lat
        lam, phi, r = F.radians(lon - self.lon0), F.radians(lat), self.radius
        if self.kind == "sinusoidal":
            return r * lam * F.cos(phi), r * phi
        if self.kind == "mollweide":
            def newton(theta, _):
                slope = F.greatest(2 + 2 * F.cos(2 * theta), F.lit(1e-12))
                return theta - (2 * theta + F.sin(2 * theta) - math.pi * F.sin(phi)) / slope

            # a fold, since unrolled steps would repeat each other inside one expression
            theta = F.aggregate(F.sequence(F.lit(1), F.lit(8)), phi, newton)
            return (2 * math.sqrt(2) / math.pi) * r * lam * F.cos(theta), math.sqrt(2) * r * F.sin(theta)
        if self.kind == "laea":
            s1, c1 = math.sin(math.radians(self.lat0)), math.cos(math.radians(self.lat0))
            dot = s1 * F.sin(phi) + c1 * F.cos(phi) * F.cos(lam)
            k = F.sqrt(2 / (1 + dot))
            return r * k * F.cos(phi) * F.sin(lam), r * k * (c1 * F.sin(phi) - s1 * F.cos(phi) * F.cos(lam))
        raise ValueError(self.kind)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(x, y) to (lon, lat) in degrees; NULL outside the projected world."""
        if self.kind == "lonlat":
            return x, y
        r = self.radius
        if self.kind == "sinusoidal":
            phi = y / r
            lam = F.try_divide(x, r * F.cos(phi))
            ok = (F.abs(phi) <= math.pi / 2) & (F.abs(lam) <= math.pi)
        elif self.kind == "mollweide":
            s = y / (math.sqrt(2) * r)
            theta = F.asin(F.when(F.abs(s) <= 1, s))
            phi = F.asin((2 * theta + F.sin(2 * theta)) / math.pi)
            lam = F.try_divide(math.pi * x, 2 * math.sqrt(2) * r * F.cos(theta))
            ok = F.abs(lam) <= math.pi
        elif self.kind == "laea":
            s1, c1 = math.sin(math.radians(self.lat0)), math.cos(math.radians(self.lat0))
            rho = F.sqrt(x * x + y * y)
            half = rho / (2 * r)
            c = 2 * F.asin(F.when(half <= 1, half))
            lift = F.coalesce(F.try_divide(y * F.sin(c) * c1, rho), F.lit(0.0))
            phi = F.asin(F.greatest(F.least(F.cos(c) * s1 + lift, F.lit(1.0)), F.lit(-1.0)))
            lam = F.atan2(x * F.sin(c), rho * c1 * F.cos(c) - y * s1 * F.sin(c))
            lam = F.when(rho == 0, F.lit(0.0)).otherwise(lam)
            ok = half <= 1
        else:
            raise ValueError(self.kind)
        return F.when(ok, F.degrees(lam) + self.lon0), F.when(ok, F.degrees(phi))


LONLAT = Projection("lonlat")
SINUSOIDAL = Projection("sinusoidal", radius=SINUSOIDAL_RADIUS)
MOLLWEIDE = Projection("mollweide", lon0=-90.0)


def laea(lon0: float, lat0: float) -> Projection:
    return Projection("laea", lon0=lon0, lat0=lat0)


def reproject(x: Column, y: Column, source: Projection, target: Projection) -> tuple[Column, Column]:
    return target.forward(*source.inverse(x, y))
