"""SQL fragments for formulas that several statements need."""

from __future__ import annotations

import math

R_EQ, R_POL, H_SAT = 6378137.0, 6356752.31414, 35786023.0
FAR = R_EQ + H_SAT
SQUASH = (R_EQ / R_POL) ** 2
ECC2 = 1 - 1 / SQUASH


def to_geostationary(source: str, lon: str, lat: str, lon0: float, keep: str = "*") -> str:
    """SELECT that adds x_m and y_m (null when not visible) to ``source``."""
    return f"""SELECT {keep},
      CASE WHEN {FAR!r} * ({FAR!r} - sx) >= sy * sy + {SQUASH!r} * sz * sz
           THEN asin(-sy / sqrt(sx * sx + sy * sy + sz * sz)) * {H_SAT!r} END AS x_m,
      CASE WHEN {FAR!r} * ({FAR!r} - sx) >= sy * sy + {SQUASH!r} * sz * sz
           THEN atan(sz / sx) * {H_SAT!r} END AS y_m
    FROM (SELECT *, {FAR!r} - rc * cos(phi) * cos(lam) AS sx, -rc * cos(phi) * sin(lam) AS sy, rc * sin(phi) AS sz
          FROM (SELECT *, {R_POL!r} / sqrt(1 - {ECC2!r} * cos(phi) * cos(phi)) AS rc
                FROM (SELECT *, atan(tan(radians({lat})) / {SQUASH!r}) AS phi, radians({lon} - ({lon0!r})) AS lam
                      FROM {source})))"""


def from_geostationary(source: str, lon0: float, keep: str = "*") -> str:
    """SELECT that adds lon_g and lat_g (null off the disk) to ``source``, from x_m and y_m."""
    return f"""SELECT {keep},
      {lon0!r} - degrees(atan(-rs * sin(al) / ({FAR!r} - rs * cos(al) * cos(be)))) AS lon_g,
      degrees(atan({SQUASH!r} * rs * cos(al) * sin(be)
                   / sqrt(pow({FAR!r} - rs * cos(al) * cos(be), 2) + pow(rs * sin(al), 2)))) AS lat_g
    FROM (SELECT *, CASE WHEN qb * qb - 4 * qa * qc >= 0 THEN (-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) END AS rs
          FROM (SELECT *, pow(sin(al), 2) + pow(cos(al), 2) * (pow(cos(be), 2) + {SQUASH!r} * pow(sin(be), 2)) AS qa,
                       -2 * {FAR!r} * cos(al) * cos(be) AS qb, {FAR * FAR - R_EQ * R_EQ!r} AS qc
                FROM (SELECT *, x_m / {H_SAT!r} AS al, y_m / {H_SAT!r} AS be FROM {source})))"""


# grid geometry of the stand-in views, read off the tables
CELL_AXES = """cell_axes AS (
  SELECT max(y) + 1 AS ny, max(x) + 1 AS nx, min(x_m) AS x0, max(y_m) AS y0,
         (max(x_m) - min(x_m)) / max(x) AS dx, (min(y_m) - max(y_m)) / max(y) AS dy FROM grid_cells)"""
MET_AXES = """met_axes AS (
  SELECT max(i) + 1 AS ni, max(j) + 1 AS nj, min(lat) AS lat0, min(lon) AS lon0,
         (max(lat) - min(lat)) / max(i) AS dlat, (max(lon) - min(lon)) / max(j) AS dlon FROM met_daily)"""

# edges of the region rings
EDGES = """edges AS (
  SELECT a.name, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2
  FROM region_vertices a JOIN region_vertices b ON a.name = b.name AND a.part = b.part AND b.k = a.k + 1)"""


def inside_pairs(points: str, keys: str, lon: str, lat: str) -> str:
    """SELECT of (keys, name) pairs whose point lies inside the ring, by counting crossed edges."""
    return f"""SELECT {keys}, name FROM {points} p JOIN edges e
      ON (y1 > p.{lat}) <> (y2 > p.{lat}) AND p.{lon} < (x2 - x1) * (p.{lat} - y1) / (y2 - y1) + x1
      GROUP BY ALL HAVING count(*) % 2 = 1"""


PI_4 = math.pi / 4
