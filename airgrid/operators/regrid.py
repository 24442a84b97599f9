"""Bilinear regridding as a join with sparse weights.

Weights depend on the two grids only.  They are computed once, can be written
and read back, and serve every time step of every variable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.projection import Geostationary
from airgrid.operators.binding import if_small, with_bound
from airgrid.operators.matching import RegularAxis


def weights_at(cells: DataFrame, row_position: Column, column_position: Column,
               row_axis: RegularAxis, column_axis: RegularAxis) -> DataFrame:
    """(y, x, i, j, w, n_corners): the source nodes of each target cell inside the source grid.

    Corners of zero weight are left out, so a cell exactly on the last row or
    column still has all it needs.
    """
    corner = F.array(F.lit(0), F.lit(1))
    placed = (with_bound(cells, {"fi": row_position, "fj": column_position}).select("y", "x", "fi", "fj")
              .filter(F.col("fi").between(0, row_axis.size - 1) & F.col("fj").between(0, column_axis.size - 1)))
    sides = {"i0": F.floor("fi").cast("int"), "j0": F.floor("fj").cast("int")}
    shares = {"t": F.col("fi") - F.col("i0"), "u": F.col("fj") - F.col("j0")}
    cornered = placed.withColumns(sides).withColumns(shares).withColumn(
        "n_corners", F.when(F.col("t") > 0, 2).otherwise(1) * F.when(F.col("u") > 0, 2).otherwise(1))
    spread = cornered.withColumn("di", F.explode(corner)).withColumn("dj", F.explode(corner))
    w = (F.when(F.col("di") == 1, F.col("t")).otherwise(1 - F.col("t"))
         * F.when(F.col("dj") == 1, F.col("u")).otherwise(1 - F.col("u")))
    return (spread.select("y", "x", (F.col("i0") + F.col("di")).alias("i"), (F.col("j0") + F.col("dj")).alias("j"),
                          w.alias("w"), "n_corners")
            .filter(F.col("w") > 0))


def bilinear_weights(cells: DataFrame, lat_axis: RegularAxis, lon_axis: RegularAxis) -> DataFrame:
    """Weights from a regular lat/lon grid to cells with ``lat`` and ``lon``."""
    return weights_at(cells, lat_axis.position(F.col("lat")), lon_axis.position(F.col("lon")), lat_axis, lon_axis)


def between_satellites_weights(cells: DataFrame, view_a: Geostationary, view_b: Geostationary,
                               row_axis: RegularAxis, column_axis: RegularAxis) -> DataFrame:
    """Weights from the regular scan grid of satellite B to the cells of satellite A.

    A's cells go to longitude and latitude and from there into B's projection;
    cells B cannot see get no weights.
    """
    lon, lat = view_a.to_lonlat(F.col("x_m"), F.col("y_m"))
    located = with_bound(cells.select("y", "x", "x_m", "y_m"), {"lon": lon, "lat": lat})
    x_b, y_b = view_b.from_lonlat(F.col("lon"), F.col("lat"))
    seen = with_bound(located, {"x_b": x_b, "y_b": y_b}).dropna(subset=["x_b", "y_b"])
    return weights_at(seen, row_axis.position(F.col("y_b")), column_axis.position(F.col("x_b")), row_axis, column_axis)


def apply_weights(field: DataFrame, weights: DataFrame, values: Sequence[str], by: Sequence[str] = ("time",)) -> DataFrame:
    """Weighted sums on the target cells; a value with a missing corner is missing.

    The field is never sent whole to every executor: the planner judges it by its files, which may hold far fewer rows than it has.
    """
    joined = field.select(*by, "i", "j", *values).hint("merge").join(if_small(weights), ["i", "j"])
    return joined.groupBy(*by, "y", "x").agg(*[
        F.when(F.count(v) == F.max("n_corners"), F.sum(F.col(v) * F.col("w"))).alias(v) for v in values])


def combine_satellites(a: DataFrame, b_on_a: DataFrame, value: str, by: Sequence[str] = ("time",)) -> DataFrame:
    """Both satellites on A's cells, each row marked by where it came from."""
    return (a.select(*by, "y", "x", value, F.lit(False).alias("remapped"))
            .unionByName(b_on_a.select(*by, "y", "x", value, F.lit(True).alias("remapped"))))
