"""The matched table: field, weather and monitors of every cell and day, ready for training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.operators import features, regrid
from airgrid.operators.binding import if_small


def matched_table(grid: DataFrame, cells: DataFrame, weather: DataFrame, weights: DataFrame, monitor_means: DataFrame,
                  weather_values: Sequence[str], on: str = "time") -> DataFrame:
    """Field cells with their place, regridded weather and the mean of their monitors.

    ``monitor_means`` has (time, y, x, PM25).  All three are aggregates by (time,
    y, x), so they meet without being shuffled again.  Rows need a field value
    and a monitor; weather may be missing.
    """
    regridded = regrid.apply_weights(weather, weights, list(weather_values), by=[on])
    joined = (grid.filter(F.col("AOD").isNotNull()).join(monitor_means, [on, "y", "x"])
              .join(regridded, [on, "y", "x"], "left"))
    placed = joined.join(if_small(cells.select("y", "x", "lat", "lon")), ["y", "x"])
    return placed.select(on, "lat", "lon", "AOD", *weather_values, "PM25", "n_snapshots")


def training_table(matched: DataFrame, time: str = "time") -> DataFrame:
    """Complete rows of the matched table with the months encoded."""
    return features.one_hot_month(matched.dropna("any"), time)
