"""Map projections as closed-form column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ellipsoid and satellite height in metres.
EQUATOR_M = 6378137.0
POLE_M = 6356752.31414
SATELLITE_HEIGHT_M = 35786023.0

# Sinusoidal tile grid (sphere radius, tile side, western and northern limit, cells per side).
SPHERE_M = 6371007.181
TILE_M = 1111950.0
WEST_M = -20015109.354
NORTH_M = 10007554.677
TILE_CELLS = 1200
CELL_M = TILE_M / TILE_CELLS


@dataclass(frozen=True)
class Geostationary:
    """A geostationary view (x sweep): height above the ellipsoid and sub-satellite longitude."""

    lon_origin: float
    height: float = SATELLITE_HEIGHT_M

    @property
    def _distance(self) -> float:
        return self.height + EQUATOR_M

    def to_lonlat(self, x_m: Column, y_m: Column) -> tuple[Column, Column]:
        """Longitude and latitude of projected metres; null off the disk."""
        alpha, beta = x_m / F.lit(self.height), y_m / F.lit(self.height)
        squash = (EQUATOR_M / POLE_M) ** 2
        far = self._distance
        a = F.pow(F.sin(alpha), F.lit(2.0)) + F.pow(F.cos(alpha), F.lit(2.0)) * (
            F.pow(F.cos(beta), F.lit(2.0)) + F.lit(squash) * F.pow(F.sin(beta), F.lit(2.0))
        )
        b = F.lit(-2.0 * far) * F.cos(alpha) * F.cos(beta)
        disc = b * b - F.lit(4.0 * (far**2 - EQUATOR_M**2)) * a
        reach = F.when(disc >= 0, (-b - F.sqrt(F.greatest(disc, F.lit(0.0)))) / (F.lit(2.0) * a))
        sx = reach * F.cos(alpha) * F.cos(beta)
        sy = -reach * F.sin(alpha)
        sz = reach * F.cos(alpha) * F.sin(beta)
        to_axis = F.lit(far) - sx
        lat = F.degrees(F.atan(F.lit(squash) * sz / F.sqrt(to_axis * to_axis + sy * sy)))
        lon = F.lit(self.lon_origin) - F.degrees(F.atan(sy / to_axis))
        return lon, lat

    def from_lonlat(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """Projected metres of a longitude and latitude; null where the satellite cannot see."""
        squash = (EQUATOR_M / POLE_M) ** 2
        ecc2 = 1.0 - 1.0 / squash
        far = self._distance
        phi = F.atan(F.lit(1.0 / squash) * F.tan(F.radians(lat)))
        lam = F.radians(lon - F.lit(self.lon_origin))
        rc = F.lit(POLE_M) / F.sqrt(F.lit(1.0) - F.lit(ecc2) * F.cos(phi) * F.cos(phi))
        sx = F.lit(far) - rc * F.cos(phi) * F.cos(lam)
        sy = -rc * F.cos(phi) * F.sin(lam)
        sz = rc * F.sin(phi)
        seen = F.lit(far) * (F.lit(far) - sx) >= sy * sy + F.lit(squash) * sz * sz
        beta = F.atan(sz / sx)
        alpha = F.asin(-sy / F.sqrt(sx * sx + sy * sy + sz * sz))
        return F.when(seen, alpha * F.lit(self.height)), F.when(seen, beta * F.lit(self.height))


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    x = F.lit(EQUATOR_M) * F.radians(lon)
    y = F.lit(EQUATOR_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / F.lit(2.0)))
    return x, y


def to_sinusoidal_tile(lon: Column, lat: Column) -> tuple[Column, Column, Column, Column]:
    """Tile column H, tile row V and the fractional row i and column j inside the tile."""
    east = F.lit(SPHERE_M) * F.radians(lon) * F.cos(F.radians(lat)) - F.lit(WEST_M)
    south = F.lit(NORTH_M) - F.lit(SPHERE_M) * F.radians(lat)
    tile_h = F.floor(east / F.lit(TILE_M)).cast("int")
    tile_v = F.floor(south / F.lit(TILE_M)).cast("int")
    i = F.pmod(south, F.lit(TILE_M)) / F.lit(CELL_M) - F.lit(0.5)
    j = F.pmod(east, F.lit(TILE_M)) / F.lit(CELL_M) - F.lit(0.5)
    return tile_h, tile_v, i, j


def from_sinusoidal_tile(tile_h: Column, tile_v: Column, i: Column, j: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a place inside a tile."""
    x = (j + F.lit(0.5)) * F.lit(CELL_M) + tile_h * F.lit(TILE_M) + F.lit(WEST_M)
    lat = (F.lit(NORTH_M) - (i + F.lit(0.5)) * F.lit(CELL_M) - tile_v * F.lit(TILE_M)) / F.lit(SPHERE_M)
    return F.degrees(x / (F.lit(SPHERE_M) * F.cos(lat))), F.degrees(lat)


def tile_name(tile_h: Column, tile_v: Column) -> Column:
    return F.format_string("h%02dv%02d", tile_h, tile_v)


def parse_tile(name: Column) -> tuple[Column, Column]:
    """``h12v08`` to (12, 8)."""
    return (F.regexp_extract(name, r"h(\d+)v(\d+)", 1).cast("int"),
            F.regexp_extract(name, r"h(\d+)v(\d+)", 2).cast("int"))
