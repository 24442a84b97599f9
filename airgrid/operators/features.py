"""Feature encoding, scaling and splits."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.functions import calendar, text
from airgrid.operators.binding import if_small
from airgrid.operators.ranking import with_rank
from airgrid.session import materialise

MONTHS = [f"month_{m}" for m in range(1, 13)]
# Order of the numeric model inputs.
NUMERIC_INPUTS = ["AOD", "lat", "lon", "u10", "v10", "d2m", "t2m", "lai_hv", "lai_lv", "skt", "sp", "tp", "blh"]


def one_hot_month(df: DataFrame, time: str = "time") -> DataFrame:
    """One 0/1 column per calendar month, whatever months occur."""
    return df.withColumns({f"month_{m}": (F.month(time) == m).cast("int") for m in range(1, 13)})


def one_hot_season(df: DataFrame, time: str = "time") -> DataFrame:
    """One 0/1 column per season, in alphabetical order."""
    label = calendar.season_label(F.col(time))
    return df.withColumns({f"season_{s}": (label == s).cast("int") for s in sorted(calendar.SEASON_MONTHS)})


def model_inputs(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), time: str = "time") -> DataFrame:
    """Complete rows with the given input columns in the given order; months are encoded."""
    encoded = one_hot_month(df, time) if any(c in MONTHS for c in columns) else df
    return encoded.select(*keep, *columns).dropna(subset=list(columns))


def standardise(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract the mean and divide by the population deviation (a constant column becomes zero)."""
    moments = df.agg(*[F.avg(c).alias(f"{c}|m") for c in columns], *[F.stddev_pop(c).alias(f"{c}|s") for c in columns]).first()
    return df.withColumns({c: (F.col(c) - moments[f"{c}|m"]) / (moments[f"{c}|s"] or 1.0) for c in columns})


def holdout_split(df: DataFrame, keys: Sequence[str], percent: int = 20, name: str = "is_test") -> DataFrame:
    """Mark about ``percent`` of the rows, by a hash of their keys: the same rows on every run."""
    return df.withColumn(name, text.hash_percent(*[F.col(k) for k in keys]) < percent)


def contiguous_folds(df: DataFrame, keys: Sequence[str], k: int, name: str = "fold") -> DataFrame:
    """k folds of consecutive rows in key order; the first ``rows % k`` folds hold one row more."""
    ranked = with_rank(df, keys, "_rank")
    size, larger = divmod(df.count(), k)
    position, edge = F.col("_rank") - 1, larger * (size + 1)
    fold = (F.when(position < edge, F.floor(position / (size + 1)))
            .otherwise(larger + F.floor((position - edge) / max(size, 1))))
    return ranked.withColumn(name, fold.cast("int")).drop("_rank")


def stratified_folds(df: DataFrame, target: str, keys: Sequence[str], k: int, name: str = "fold") -> DataFrame:
    """k folds that each take an even part of every one of k equal-width bins of the target."""
    low, high = df.agg(F.min(target), F.max(target)).first()
    width = (high - low) / k or 1.0
    stratum = F.least(F.greatest(F.ceil((F.col(target) - low) / width), F.lit(1)), F.lit(k)).cast("int")
    binned = df.withColumn("stratum", stratum)
    sizes = {r[0]: r[1] for r in binned.groupBy("stratum").count().collect()}  # at most k rows
    start = {s: sum(n for t, n in sizes.items() if t < s) for s in sizes}
    before = F.element_at(F.array(*[F.lit(start.get(s, 0)) for s in range(1, k + 1)]), F.col("stratum"))
    ranked = with_rank(binned, ["stratum", *keys], "_rank")
    return ranked.withColumn(name, F.pmod(F.col("_rank") - 1 - before, F.lit(k)).cast("int")).drop("_rank")


def levelled(loads: Sequence[int], size: int, n: int) -> list[int]:
    """How many of ``n`` groups of equal size each fold gets if the least loaded, first among equals, always takes the next.

    A fold is asked at its load, then at each ``size`` more; the ``n`` lowest of these levels are taken, found by halving.
    """

    def below(level: int) -> list[int]:
        return [max(0, -((load - level) // size)) for load in loads]

    low, high = min(loads), max(loads) + size * n
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(below(middle)) <= n else (low, middle - 1)
    taken = below(low)
    for fold, load in enumerate(loads):
        if sum(taken) < n and load <= low and (low - load) % size == 0:
            taken[fold] += 1
    return taken


def group_fold_table(df: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """(group, rows, fold): groups from the largest down, each into the fold with the fewest rows so far.

    Groups of one size are interchangeable, so the driver only sees how many
    groups there are of each size, never the groups.  It hands every fold a
    stretch of the groups of that size, and a group finds its fold by its rank.
    """
    sizes = materialise(df.groupBy(*group).agg(F.count("*").alias("n_rows")))
    classes = sizes.groupBy("n_rows").agg(F.count("*").alias("n_groups")).orderBy(F.desc("n_rows"))
    loads = [0] * k
    stretches, start = [], 0
    for n_rows, n_groups in classes.toLocalIterator():
        taken = levelled(loads, n_rows, n_groups)
        loads = [load + n_rows * t for load, t in zip(loads, taken)]
        stretches.append((n_rows, list(accumulate(taken, initial=start))[1:]))
        start += n_groups
    table = df.sparkSession.createDataFrame(stretches, "n_rows bigint, ends array<bigint>")
    ranked = with_rank(sizes.withColumn("_down", -F.col("n_rows")), ["_down", *group], "_rank").drop("_down")
    fold = F.size(F.filter("ends", lambda e: e < F.col("_rank")))
    return ranked.join(if_small(table, F.size("ends")), "n_rows").select(*group, "n_rows", fold.cast("int").alias("fold"))


def group_folds(df: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """Add the fold of each row's group; no group is in two folds."""
    return df.join(if_small(group_fold_table(df, group, k).drop("n_rows")), list(group))
