"""Joins of points to grid cells, nodes and tiles, all as equi-joins.

A nearest or window match is turned into equality on integer cell indices, so
nothing is compared with everything and Spark is free to hash, sort-merge or,
below its own size threshold, broadcast.  No broadcast is forced here.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.functions import projection
from airgrid.operators.binding import if_small, with_bound
from airgrid.operators.ranking import per_range, with_ranges


EVEN_WITHIN = 1e-6  # of a step, how far a node may be off its place
TIME_CHUNKS = 64


@dataclass(frozen=True)
class RegularAxis:
    """Equally spaced coordinate: value = origin + step * index, 0 <= index < size."""

    origin: float
    step: float
    size: int

    @classmethod
    def of(cls, grid: DataFrame, index: str, value: str) -> RegularAxis:
        """Read the axis off a table that carries both index and coordinate: one row per node comes to the driver.

        Raises ValueError where the nodes are not evenly spaced; ``nearest_on_axis`` serves such an axis.
        """
        nodes = sorted(tuple(r) for r in grid.groupBy(index).agg(F.min(value), F.max(value)).collect() if None not in r)
        if not nodes:
            raise ValueError(f"no nodes in {index}, {value}")
        (first, low, _), (last, high, _) = nodes[0], nodes[-1]
        step = (high - low) / (last - first) if last > first else 1.0
        if any(max(abs(v - low - (i - first) * step) for v in ends) > EVEN_WITHIN * abs(step) for i, *ends in nodes):
            raise ValueError(f"{value} is not evenly spaced along {index}")
        return cls(low - first * step, step, last + 1)

    def position(self, value: Column) -> Column:
        """Fractional index."""
        return (value - F.lit(self.origin)) / F.lit(self.step)

    def nearest(self, value: Column) -> Column:
        """Index of the nearest node, possibly outside the axis; halfway, that of the larger node."""
        position = self.position(value)
        return (F.floor(position + 0.5) if self.step > 0 else F.ceil(position - 0.5)).cast("int")

    def nearest_clamped(self, value: Column) -> Column:
        return F.least(F.greatest(self.nearest(value), F.lit(0)), F.lit(self.size - 1))

    def value(self, index: Column) -> Column:
        return F.lit(self.origin) + F.lit(self.step) * index

    def nearest_within(self, value: Column, tolerance: float) -> Column:
        """Index of the nearest node if it exists and lies within the tolerance, else null."""
        index = self.nearest(value)
        near = F.abs(value - self.value(index)) <= tolerance
        return F.when(index.between(0, self.size - 1) & near, index)


def spread_nulls(key: Column, row: Sequence[str]) -> Column:
    """A join key in which nulls become many negative values that match nothing.

    Unmatched rows can be a large part of a table; left as null they would all
    be sent to one task of an outer join.
    """
    return F.coalesce(key, (F.lit(-1) - F.pmod(F.xxhash64(*row), F.lit(4096))).cast("int"))


def with_projected(points: DataFrame, view: projection.Geostationary, lon: str, lat: str) -> DataFrame:
    x, y = view.from_lonlat(F.col(lon), F.col(lat))
    return with_bound(points, {"x_m": x, "y_m": y})


def with_nearest_cell(points: DataFrame, x_axis: RegularAxis, y_axis: RegularAxis, tolerance: float,
                      x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Cell index of each point; null on both axes unless both are within the tolerance."""
    ix, iy = x_axis.nearest_within(F.col(x), tolerance), y_axis.nearest_within(F.col(y), tolerance)
    both = ix.isNotNull() & iy.isNotNull()
    return with_bound(points, {"cell_y": F.when(both, iy), "cell_x": F.when(both, ix)})


def nearest_cell_join(points: DataFrame, grid: DataFrame, x_axis: RegularAxis, y_axis: RegularAxis, tolerance: float,
                      on: Sequence[str] = ("time",), values: Sequence[str] = ("AOD",)) -> DataFrame:
    """Left join of points to the grid cell nearest to them at the same time.

    ``tolerance`` holds per axis.  Points without a cell stay, with nulls.
    """
    placed = with_nearest_cell(points, x_axis, y_axis, tolerance)
    keyed = placed.withColumns({"_y": spread_nulls(F.col("cell_y"), points.columns),
                                "_x": spread_nulls(F.col("cell_x"), points.columns)})
    cells = grid.select(*on, F.col("y").alias("_y"), F.col("x").alias("_x"), *values, F.lit(True).alias("has_cell"))
    return keyed.join(cells, [*on, "_y", "_x"], "left").drop("_y", "_x")


def match_outcome(x_axis: RegularAxis, y_axis: RegularAxis, value: str = "AOD", x: str = "x_m", y: str = "y_m") -> Column:
    """What became of a point of ``nearest_cell_join``."""
    outside = (F.col(x).isNull() | ~x_axis.nearest(F.col(x)).between(0, x_axis.size - 1)
               | ~y_axis.nearest(F.col(y)).between(0, y_axis.size - 1))
    return (F.when(outside, "out_of_bounds")
            .when(F.col("cell_x").isNull() | F.col("has_cell").isNull(), "unmatched")
            .when(F.col(value).isNull(), "matched_null")
            .otherwise("matched"))


def nearest_node_join(points: DataFrame, nodes: DataFrame, lon_axis: RegularAxis, lat_axis: RegularAxis,
                      on: Sequence[str], values: Sequence[str], lon: str = "lon", lat: str = "lat",
                      how: str = "left") -> DataFrame:
    """Join to the nearest node of a regular grid; places past the ends take the last node."""
    keyed = points.withColumns({"i": lat_axis.nearest_clamped(F.col(lat)), "j": lon_axis.nearest_clamped(F.col(lon))})
    return keyed.join(nodes.select(*on, "i", "j", *values), [*on, "i", "j"], how)


def nearest_on_axis(points: DataFrame, axis: DataFrame, value: str, node: str) -> DataFrame:
    """Nearest node of an unevenly spaced axis (ties go to the larger node), as column ``node``.

    Nodes and the distinct places are ordered together in key ranges.  Within a
    range, running windows find the node before and after each place; across
    ranges the driver carries over one node per range.  No matter how nodes
    cluster or how many points share a place, no task gets more than a range.
    """
    nodes = axis.select(F.col(node).cast("double").alias("v"), F.lit(True).alias("is_node")).dropna().distinct()
    places = points.select(F.col(value).cast("double").alias("v"), F.lit(False).alias("is_node")).dropna().distinct()
    ranged = with_ranges(nodes.unionByName(places), ["v"])
    ends = ranged.groupBy("_range").agg(*[
        f(F.when(F.col("is_node"), F.col("v"))) for f in (F.min, F.max)]).orderBy("_range").collect()  # one row per range
    before = accumulate((r[2] for r in ends), lambda a, b: a if b is None else b)
    after = accumulate((r[1] for r in reversed(ends)), lambda a, b: a if b is None else b)
    below, above = [None, *before][:len(ends)], [None, *after][:len(ends)][::-1]
    carried = per_range(ranged, [(r[0], b, a) for r, b, a in zip(ends, below, above)], "below double, above double")
    here = F.last(F.when(F.col("is_node"), F.col("v")), ignorenulls=True)
    running = [Window.unboundedPreceding, Window.currentRow]
    low = F.coalesce(here.over(Window.partitionBy("_range").orderBy("v").rangeBetween(*running)), F.col("below"))
    high = F.coalesce(here.over(Window.partitionBy("_range").orderBy(F.desc("v")).rangeBetween(*running)), F.col("above"))
    nearest = (F.when(F.col("low").isNull(), F.col("high")).when(F.col("high").isNull(), F.col("low"))
               .when(F.col("v") - F.col("low") < F.col("high") - F.col("v"), F.col("low")).otherwise(F.col("high")))
    lookup = (carried.withColumns({"low": low, "high": high}).filter(~F.col("is_node"))
              .select(F.col("v").alias("_v"), nearest.alias(node)))
    return (points.withColumn("_v", F.col(value).cast("double")).join(if_small(lookup), "_v", "left").drop("_v"))


def nearest_node_and_time(points: DataFrame, nodes: DataFrame, lon_axis: RegularAxis, lat_axis: RegularAxis, values: Sequence[str],
                          time: str = "time", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Join to the nearest node at the nearest time the nodes have, as ``node_time``; halfway, the later one."""
    seconds = F.col(time).cast("timestamp").cast("double")
    times = nodes.select(seconds.alias("_node_s")).distinct()
    near = nearest_on_axis(points.withColumn("_s", seconds), times, "_s", "_node_s").drop("_s")
    return nearest_node_join(near, nodes.withColumn("_node_s", seconds).withColumnRenamed(time, "node_time"), lon_axis, lat_axis,
                             ["_node_s"], ["node_time", *values], lon, lat).drop("_node_s")


def mean_per_cell(points: DataFrame, value: str, on: Sequence[str] = ("time",)) -> DataFrame:
    """Mean of all readings that fall into a cell (a mean of readings, not of site means)."""
    return (points.filter(F.col("cell_y").isNotNull())
            .groupBy(*on, F.col("cell_y").alias("y"), F.col("cell_x").alias("x")).agg(F.avg(value).alias(value)))


def mean_of_readings(readings: DataFrame, value: str, lon: str, lat: str, view: projection.Geostationary,
                     x_axis: RegularAxis, y_axis: RegularAxis, tolerance: float,
                     on: Sequence[str] = ("time",)) -> DataFrame:
    """Mean of all readings of a cell, the readings of a place summed up first.

    Sums and counts per place combine on the map side, so the projection runs
    once per place and time instead of once per reading; the mean over sums is
    the mean over readings.
    """
    sums = readings.groupBy(*on, lon, lat).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    placed = with_nearest_cell(with_projected(sums, view, lon, lat), x_axis, y_axis, tolerance)
    return (placed.filter(F.col("cell_y").isNotNull())
            .groupBy(*on, F.col("cell_y").alias("y"), F.col("cell_x").alias("x"))
            .agg((F.sum("_sum") / F.sum("_n")).alias(value)))


def assign_points_to_grid(grid: DataFrame, points: DataFrame, value: str, name: str,
                          on: Sequence[str] = ("time",)) -> DataFrame:
    """Add the mean of the points of each cell to the grid as ``name``; null where there is none."""
    means = mean_per_cell(points, value, on).withColumnRenamed(value, name)
    return grid.join(means, [*on, "y", "x"], "left")


def join_parameters(left: DataFrame, readings: DataFrame, keys: Sequence[str], parameter: str, value: str,
                    parameters: Sequence[str]) -> DataFrame:
    """Look up the mean of each named parameter at the exact keys, one column per parameter."""
    wide = readings.groupBy(*keys).pivot(parameter, list(parameters)).agg(F.avg(value))
    return left.join(wide, list(keys), "left")


def merge_products(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Outer alignment of several products on their coordinates.

    A variable that several products have comes from the first of them.  The
    rows are stacked and folded by key: one shuffle, however many products.
    """
    seen: set[str] = set()
    parts = []
    for frame in frames:
        fresh = [c for c in frame.columns if c not in keys and c not in seen]
        seen.update(fresh)
        parts.append(frame.select(*keys, *fresh))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    variables = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.max(c).alias(c) for c in variables])


def focal_mean(points: DataFrame, grid: DataFrame, values: Sequence[str], by: Sequence[str] = ("time",),
               reach: int = 3, y: str = "y", x: str = "x") -> DataFrame:
    """Mean of the square of cells around each point cell, per ``by``; empty squares give no row.

    The offsets are made per distinct point cell and meet the grid on equal
    cell indices.
    """
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    around = (points.select(F.col(y).alias("point_y"), F.col(x).alias("point_x")).distinct()
              .withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
              .select("point_y", "point_x", (F.col("point_y") + F.col("dy")).alias("y"),
                      (F.col("point_x") + F.col("dx")).alias("x")))
    some = F.coalesce(*[F.col(v) for v in values]).isNotNull()
    return (grid.filter(some).join(if_small(around), ["y", "x"])
            .groupBy("point_y", "point_x", *by).agg(*[F.avg(v).alias(v) for v in values]))


def focal_has_data(points: DataFrame, grid: DataFrame, value: str, reach: int = 3) -> DataFrame:
    """The distinct point cells with any value in the square of cells around them."""
    def widened(cells: DataFrame, axis: str) -> DataFrame:
        there = F.explode(F.sequence(F.col(axis) - reach, F.col(axis) + reach)).alias(axis)
        return cells.select(*[there if c == axis else c for c in cells.columns]).distinct()

    # the filled cells grow along one axis, meet themselves again, and grow along the other
    filled = grid.filter(F.col(value).isNotNull()).select("y", "x").distinct()
    return points.select("y", "x").distinct().join(widened(widened(filled, "y"), "x"), ["y", "x"], "left_semi")


def files_for_tiles(files: DataFrame, points: DataFrame, lon: str, lat: str, tile: str = "tile") -> DataFrame:
    """The files whose tile holds at least one of the points."""
    tile_h, tile_v, _, _ = projection.to_sinusoidal_tile(F.col(lon), F.col(lat))
    wanted = points.select(projection.tile_name(tile_h, tile_v).alias(tile)).distinct()
    return files.join(if_small(wanted), tile, "left_semi")


def densify_grid(field: DataFrame, cells: DataFrame, time: str = "time") -> DataFrame:
    """The dense form of a sparse field: every cell at every time that occurs.

    The distinct times are dealt to a fixed number of chunks, and cells meet the chunks by key.
    """
    times = field.filter(F.col(time).isNotNull()).select(time).distinct().withColumn("_chunk", F.pmod(F.hash(time), F.lit(TIME_CHUNKS)))
    chunks = if_small(times.groupBy("_chunk").agg(F.collect_list(time).alias("_times")), F.size("_times"))
    spine = cells.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(TIME_CHUNKS - 1)))).join(chunks, "_chunk")
    return spine.withColumn(time, F.explode("_times")).drop("_chunk", "_times").join(field, [time, "y", "x"], "left")
