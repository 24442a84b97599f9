"""Order-based operators that do not gather a table, or a hot group, in one task.

A window without a partition, or over one hot partition, sorts everything in a
single task.  Here Spark range-partitions the rows by all their keys, the ranges
are written once, and each range is then numbered by itself and moved on by the
total of the ranges before it.  The driver sees one row per range, of which
there are at most ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.session import materialise

ROW_BITS = 33  # of a monotonically increasing id, the rest is the partition


def with_ranges(df: DataFrame, keys: Sequence[str], name: str = "_range") -> DataFrame:
    """Bring rows together by key range and number the ranges in key order.

    The result is a written table: range limits come from a sample, and every
    later reading must see the same ones.
    """
    return materialise(df.repartitionByRange(*keys).withColumn(name, F.spark_partition_id()))


def per_range(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    """Join one small row per range, made on the driver, back to the rows of the ranges."""
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, f"_range int, {schema}")), "_range")


def with_running_totals(df: DataFrame, keys: Sequence[str], weights: dict[str, Column]) -> DataFrame:
    """Totals of several weights over this row and all rows before it in key order; the keys must be unique."""
    ranged = with_ranges(df, keys)
    totals = ranged.groupBy("_range").agg(*[F.sum(w).alias(n) for n, w in weights.items()]).orderBy("_range").collect()
    before = zip(*[[0, *accumulate(r[n] for r in totals)][:len(totals)] for n in weights])
    offsets = [(r["_range"], *b) for r, b in zip(totals, before)]
    order = Window.partitionBy("_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = per_range(ranged, offsets, ", ".join(f"`_before_{n}` bigint" for n in weights))
    return joined.withColumns({n: F.col(f"_before_{n}") + F.sum(w).over(order) for n, w in weights.items()}).select(
        *df.columns, *weights)


def with_running_total(df: DataFrame, keys: Sequence[str], weight: Column, name: str = "running") -> DataFrame:
    return with_running_totals(df, keys, {name: weight})


def with_rank(df: DataFrame, keys: Sequence[str], name: str = "rank") -> DataFrame:
    """Position of each row in key order, from 1; the keys should be unique.

    Rows are written sorted, range by range, so their place in a range is their
    place in its file: no window and no second shuffle.
    """
    ordered = materialise(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    numbered = ordered.withColumn("_id", F.monotonically_increasing_id()).select(
        *df.columns, F.shiftright("_id", ROW_BITS).cast("int").alias("_range"),
        F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row"))
    counts = numbered.groupBy("_range").count().orderBy("_range").collect()
    before = accumulate((r["count"] for r in counts), initial=0)
    offsets = [(r["_range"], b) for r, b in zip(counts, before)]
    return per_range(numbered, offsets, "_before bigint").withColumn(
        name, F.col("_before") + F.col("_row") + 1).select(*df.columns, name)


def monotonic_axis(axis: DataFrame, by: Sequence[str], position: str, value: str) -> DataFrame:
    """Whether a coordinate strictly decreases along each axis, and how often it does not.

    Positions are consecutive, so neighbours meet by an equi-join and a long
    axis is not sorted in one task.
    """
    here = axis.select(*by, position, value)
    before = axis.select(*by, (F.col(position) + 1).alias(position), F.col(value).alias("_before"))
    step = F.col(value) - F.col("_before")
    return here.join(before, [*by, position]).groupBy(*by).agg(
        F.bool_and(step < 0).alias("decreasing"), F.count_if(step >= 0).alias("n_violations"))


def with_falling_axis(axis: DataFrame, by: Sequence[str], position: str, value: str) -> DataFrame:
    """Axes that rise from end to end are turned round: their positions count from the other end."""
    ends = axis.groupBy(*by).agg(F.min(position).alias("_first"), F.max(position).alias("_last"),
                                 (F.min_by(value, position) < F.max_by(value, position)).alias("_rises"))
    turned = F.when(F.col("_rises"), F.col("_first") + F.col("_last") - F.col(position)).otherwise(F.col(position))
    return axis.join(ends, list(by)).withColumn(position, turned).select(*axis.columns)
