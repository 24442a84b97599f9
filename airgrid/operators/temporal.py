"""Resampling over event time and count-weighted means.

Every mean here is an algebraic aggregate, so Spark combines on the map side
before the one shuffle on (time bin, cell): a bin or cell that holds a large
part of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions import calendar, optics


def observation_count(value: str) -> Column:
    """Aggregate: number of non-null values, null instead of zero."""
    return F.nullif(F.count(value), F.lit(0).cast("bigint"))


def with_target_depth(snapshots: DataFrame) -> DataFrame:
    """Add the depth at the target wavelength, per snapshot."""
    return snapshots.withColumn("AOD470", optics.to_wavelength(
        F.col("AOD"), F.col("AE1"), optics.REFERENCE_NM, optics.TARGET_NM))


def hourly_average(snapshots: DataFrame, keys: Sequence[str] = ("y", "x"), time: str = "t") -> DataFrame:
    """Hourly mean per cell over all satellites, with the number of snapshots behind it."""
    return (
        with_target_depth(snapshots)
        .groupBy(calendar.hour_start(F.col(time)).alias(time), *keys)
        .agg(F.avg("AOD").alias("AOD"), F.avg("AOD470").alias("AOD470"),
             observation_count("AOD").alias("n_snapshots"))
    )


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate: mean of ``value`` whose weights count only where it is present."""
    present = F.when(F.col(value).isNotNull(), F.col(weight))
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(present))


def daily_weighted_average(hourly: DataFrame, keys: Sequence[str] = ("y", "x"), time: str = "t",
                           values: Sequence[str] = ("AOD", "AOD470"), weight: str = "n_snapshots") -> DataFrame:
    """Daily mean of hourly means, each hour weighted by its number of snapshots."""
    return hourly.groupBy(F.to_date(time).alias("time"), *keys).agg(
        *[weighted_mean(v, weight).alias(v) for v in values], F.sum(weight).alias(weight))


def bin_start(time: str, every: str, anchor: Column | None = None) -> Column:
    """Label of the tumbling bin of ``time``: 'hour', 'day', 'month', 'year' or '<n> days'."""
    c = F.col(time)
    if every == "hour":
        return calendar.hour_start(c)
    if every == "day":
        return F.to_date(c)
    if every == "month":
        return F.last_day(c)
    if every == "year":
        return F.year(c)
    days, unit = every.split()
    if unit != "days":
        raise ValueError(f"unknown bin {every!r}")
    return calendar.nday_start(F.to_date(c), anchor if anchor is not None else F.lit("1970-01-01").cast("date"),
                               int(days))


def resample_mean(df: DataFrame, time: str, every: str, keys: Sequence[str], values: Sequence[str],
                  anchor: str = "data") -> DataFrame:
    """Mean of each value per bin and key.

    Bins of several days start at the first day of the data (``anchor="data"``)
    or at 1970-01-01 (``anchor="epoch"``).
    """
    start = None
    if every.endswith("days") and anchor == "data":
        start = F.lit(df.agg(F.min(F.to_date(time))).first()[0])
    return df.groupBy(bin_start(time, every, start).alias(time), *keys).agg(
        *[F.avg(v).alias(v) for v in values])


def densify_time(df: DataFrame, time: str, step: str, keys: Sequence[str]) -> DataFrame:
    """Every bin between the first and the last of the table, for each key that occurs.

    Two scalars reach the driver.  The spine is made per key, so it spreads over
    the cluster, and keys without any data are not filled in.
    """
    kind = df.schema[time].dataType
    low, high = df.agg(F.min(time).cast("string"), F.max(time).cast("string")).first()
    if low is None:
        return df
    # in the column's own type, so that the join keeps the partitioning of an aggregate below it
    spine = F.sequence(F.lit(low).cast(kind), F.lit(high).cast(kind), F.expr(f"INTERVAL {step}"))
    full = df.select(*keys).distinct().withColumn(time, F.explode(spine))
    return full.join(df, [time, *keys], "left").select(*df.columns)


def seasonal_weighted_mean(monthly: DataFrame, time: str, keys: Sequence[str], values: Sequence[str],
                           renormalise: bool = False) -> DataFrame:
    """Mean of monthly means per season, months weighted by their days.

    The weights of a season add up to one over all months from the first to the
    last of the table.  A cell that lacks a month is not scaled back up unless
    ``renormalise`` is set; a total of zero counts as missing.
    """
    low, high = monthly.agg(F.min(time), F.max(time)).first()
    month_axis = F.explode(F.sequence(F.trunc(F.lit(low), "month"), F.lit(high), F.expr("INTERVAL 1 MONTH")))
    axis = monthly.sparkSession.range(1).select(month_axis.alias("month"))
    totals = axis.groupBy(calendar.season_code(F.col("month")).alias("season")).agg(
        F.sum(calendar.days_in_month(F.col("month"))).alias("season_days"))
    weighted = monthly.withColumns({"season": calendar.season_code(F.col(time)),
                                    "days": calendar.days_in_month(F.col(time))}).join(totals, "season")

    def mean(v: str) -> Column:
        total = F.sum(F.col(v) * F.col("days") / F.col("season_days"))
        if renormalise:
            share = F.sum(F.when(F.col(v).isNotNull(), F.col("days") / F.col("season_days")))
            total = F.try_divide(total, share)
        return F.nullif(total, F.lit(0.0)).alias(v)

    return weighted.groupBy("season", *keys).agg(*[mean(v) for v in values])


def date_spine(start: Column, stop: Column, step: str, table: DataFrame, inclusive: str = "both") -> DataFrame:
    """The dates or times from ``start`` to ``stop`` for each row of ``table``."""
    spine = table.select("*", F.explode(F.sequence(start, stop, F.expr(f"INTERVAL {step}"))).alias("time"))
    return spine if inclusive == "both" else spine.filter(F.col("time") < stop)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; columns missing in some come out null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
