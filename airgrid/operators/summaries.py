"""Scores, histograms, densities and order statistics.

Counts, sums and moments combine on the map side, so their shuffles carry one
row per group and task.  Order statistics are exact and never hold a group in
one task: values are counted, ranged over all groups together and read off at
the wanted ranks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.operators.binding import if_small
from airgrid.operators.ranking import with_rank, with_running_total

# Air-quality breakpoints and categories, and the two-class guideline.
AQI_EDGES = [0.0, 12.1, 35.5, 55.5, 150.5, 250.5, 350.5, 500.5, 99999.9]
AQI_CATEGORIES = ["GOOD", "MODERATE", "UNHEALTHY FOR SENSITIVE", "UNHEALTHY", "VERY UNHEALTHY", "HAZARDOUS",
                  "HAZARDOUS", "HAZARDOUS"]
WHO_EDGES = [0.0, 5.0, 500.0]
WHO_CATEGORIES = ["Good", "Unhealthy"]

# The summaries' ranks are off by 1 / SUMMARY_SIZE of the rows at most; a bracket is wider than two such errors and two rows.
SUMMARY_SIZE, BRACKET, FEW_ROWS = 2000, 0.0015, 10_000
BOX, KERNEL_TERMS = 0.5, 14  # width of a box of values in bandwidths; terms of the kernel's series about its middle


def unpivoted(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "model",
              value: str = "value") -> DataFrame:
    return df.unpivot(list(keep), list(columns), name, value)


def regression_scores(df: DataFrame, truth: str, models: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """R2, MAE and RMSE per model (and group) in one pass over the wide table."""
    aggregates: list[Column] = []
    for m in models:
        error = F.col(truth) - F.col(m)
        # moments over the rows this model has a prediction for
        scored_truth = F.when(error.isNotNull(), F.col(truth))
        aggregates += [
            (1 - F.try_divide(F.sum(error * error), F.var_pop(scored_truth) * F.count(error))).alias(f"{m}|r2"),
            F.avg(F.abs(error)).alias(f"{m}|mae"), F.sqrt(F.avg(error * error)).alias(f"{m}|rmse"),
            F.count(error).alias(f"{m}|n")]
    wide = df.groupBy(*by).agg(*aggregates)
    rows = F.array(*[F.struct(F.lit(m).alias("model"), *[F.col(f"`{m}|{s}`").alias(s) for s in ("r2", "mae", "rmse", "n")])
                     for m in models])
    return wide.select(*by, F.inline(rows))


def score_summary(scores: DataFrame, model: str = "model") -> DataFrame:
    """Mean R2, mean absolute MAE and mean absolute RMSE over folds."""
    return scores.groupBy(model).agg(F.avg("r2").alias("r2"), F.avg(F.abs("neg_mae")).alias("mae"),
                                     F.avg(F.abs("neg_rmse")).alias("rmse"))


def percent_change(reference: DataFrame, other: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(reference - other) / reference in percent, per key and column."""
    joined = reference.alias("a").join(other.alias("b"), key)
    return joined.select(key, *[F.col(f"b.{c}").alias(c) for c in columns],
                         *[(F.try_divide(F.col(f"a.{c}") - F.col(f"b.{c}"), F.col(f"a.{c}")) * 100).alias(f"{c}_change")
                           for c in columns])


def mean_with_stderr(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"),
                               (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("stderr"))


def mean_with_spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def best_fit_line(df: DataFrame, y: str, models: Sequence[str], of_truth: bool = True) -> DataFrame:
    """Least-squares line per model: truth on prediction, or prediction on truth."""
    parts: list[Column] = []
    for m in models:
        a, b = (F.col(y), F.col(m)) if of_truth else (F.col(m), F.col(y))
        parts.append(F.struct(F.lit(m).alias("model"), F.regr_slope(a, b).alias("slope"),
                              F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2")))
    return df.agg(F.array(*parts).alias("lines")).select(F.inline("lines"))


def category_shares(df: DataFrame, columns: Sequence[str], edges: Sequence[float], labels: Sequence[str]) -> DataFrame:
    """Rows per column and bin, and their share of all rows.

    Bins are closed on the left, the last one on both sides; values outside are
    counted in no bin but stay in the total.
    """
    last = len(labels) - 1
    counts: list[Column] = []
    for c in columns:
        for k in range(len(labels)):
            below = F.col(c) <= edges[k + 1] if k == last else F.col(c) < edges[k + 1]
            counts.append(F.count_if((F.col(c) >= edges[k]) & below).alias(f"{c}|{k}"))
    wide = df.agg(F.count(F.lit(1)).alias("total"), *counts)
    rows = F.array(*[
        F.struct(F.lit(c).alias("model"), F.lit(k).alias("bin"), F.lit(float(edges[k])).alias("lower"),
                 F.lit(label).alias("category"), F.col(f"`{c}|{k}`").alias("n"),
                 (F.try_divide(F.col(f"`{c}|{k}`"), F.col("total")) * 100).alias("share"))
        for c in columns for k, label in enumerate(labels)])
    return wide.select(F.inline(rows))


def histogram_from_zero(df: DataFrame, columns: Sequence[str], width: float) -> DataFrame:
    """Counts in bins of ``width`` from zero to just past the largest magnitude of all columns."""
    top = df.agg(F.greatest(*[F.max(F.abs(F.col(c))) for c in columns])).first()[0] or 0.0
    n_bins = int(top / width) + 1
    counted = (unpivoted(df.select(*columns), columns, name="variable").filter(F.col("value") >= 0)
               .groupBy("variable", F.floor(F.col("value") / width).cast("int").alias("bin")).agg(F.count("*").alias("n")))
    spine = (df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"),
                                                  F.explode(F.array(*[F.lit(c) for c in columns])).alias("variable")))
    return (spine.join(counted, ["variable", "bin"], "left")
            .select("variable", "bin", (F.col("bin") * width).alias("lower"), F.coalesce("n", F.lit(0)).alias("n")))


def histogram_right_closed(df: DataFrame, column: str, n_bins: int) -> DataFrame:
    """As ``histogram``, closed on the right; the first bin also holds the smallest value."""
    return histogram(df, column, n_bins, right=True)


def histogram(df: DataFrame, column: str, n_bins: int, right: bool = False) -> DataFrame:
    """``n_bins`` equal bins from the smallest to the largest value, closed on the left; the last also holds the largest value.

    ``density`` integrates to one.  A single value gets a unit range around it; no values, no rows.
    """
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n bigint, density double")
    if low == high:
        low, high = low - 0.5, high + 0.5  # one value: a unit range around it
    width = (high - low) / n_bins
    position = (F.col(column) - low) / width
    number = F.least(F.greatest(F.ceil(position) - 1 if right else F.floor(position), F.lit(0)), F.lit(n_bins - 1)).cast("int")
    counted = df.filter(F.col(column).isNotNull()).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    total = df.agg(F.count(column)).first()[0]
    return spine.join(counted, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * width).alias("lower"), (F.lit(low) + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.lit(total * width)).alias("density"))


def hexbin_counts(df: DataFrame, x: str, y: str, grid_size: int = 100,
                  extent: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Counts of hexagonal bins: of two offset lattices a point takes the nearer centre."""
    if extent is None:
        extent = tuple(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
                       .agg(F.min(x), F.max(x), F.min(y), F.max(y)).first())
    if extent[0] is None:
        return df.sparkSession.createDataFrame([], "center_x double, center_y double, n bigint, log_n double")
    x0, x1, y0, y1 = (w for a, b in (extent[:2], extent[2:]) for w in ((a, b) if a < b else (a - 0.5, b + 0.5)))
    sx, sy = (x1 - x0) / grid_size, (y1 - y0) / int(grid_size / math.sqrt(3))
    scaled = df.select(((F.col(x) - x0) / sx).alias("ix"), ((F.col(y) - y0) / sy).alias("iy")).dropna()
    centres = scaled.withColumns({"ax": F.floor(F.col("ix") + 0.5).cast("double"), "ay": F.floor(F.col("iy") + 0.5).cast("double"),
                                  "bx": F.floor("ix") + F.lit(0.5), "by": F.floor("iy") + F.lit(0.5)})

    def distance(cx: str, cy: str) -> Column:
        dx, dy = F.col("ix") - F.col(cx), F.col("iy") - F.col(cy)
        return dx * dx + 3.0 * dy * dy

    first = distance("ax", "ay") < distance("bx", "by")
    return (centres.groupBy(F.when(first, F.col("ax")).otherwise(F.col("bx")).alias("hx"),
                            F.when(first, F.col("ay")).otherwise(F.col("by")).alias("hy"))
            .agg(F.count("*").alias("n"))
            .select((F.lit(x0) + F.col("hx") * sx).alias("center_x"), (F.lit(y0) + F.col("hy") * sy).alias("center_y"),
                    "n", F.log10(F.col("n") + 1).alias("log_n")))


def _hermite_sum(moments: Sequence[Column]) -> list[Column]:
    """Coefficients of the polynomial in ``z`` that is the sum of the moments times Hermite polynomials."""
    polynomials = [[1], [0, 1]]
    while len(polynomials) < len(moments):
        last, before, k = polynomials[-1], polynomials[-2], len(polynomials) - 1
        polynomials.append([(last[j - 1] if j else 0) - k * (before[j] if j < len(before) else 0) for j in range(k + 2)])
    return [reduce(Column.__add__, [m * float(q[j]) for m, q in zip(moments, polynomials) if j < len(q) and q[j]])
            for j in range(len(moments))]


def kde_curve(df: DataFrame, by: Sequence[str], value: str, start: float, stop: float, points: int) -> DataFrame:
    """Gaussian kernel density on an even grid of ``points`` from ``start`` to ``stop``, per group, tails included.

    Bandwidth is the sample deviation times n^(-1/5); a group without spread has no density, and its rows are null.
    Values are counted into boxes half a bandwidth wide, as moments about the middle of their box, which combine on the
    map side; a grid point meets boxes, not values.  The kernel's Hermite series about a box is cut after
    ``KERNEL_TERMS``, by Cramer's bound within 2e-14 of the kernel's peak for every value.
    """
    step = (stop - start) / (points - 1)
    stats = if_small(df.groupBy(*by).agg(F.count(value).alias("n"), F.stddev_samp(value).alias("sd")).withColumn(
        "h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))))
    box = F.floor((F.col("v") - start) / (F.col("h") * BOX))
    boxed = (df.select(*by, F.col(value).alias("v")).filter("v IS NOT NULL").join(stats.filter("h > 0"), list(by))
             .select(*by, "h", box.alias("b"), "v")
             .select(*by, "h", "b", ((F.col("v") - start) / F.col("h") - (F.col("b") + 0.5) * BOX).alias("d")))
    moments = [F.sum(F.pow("d", F.lit(float(k)))) / float(math.factorial(k)) for k in range(1, KERNEL_TERMS)]
    summed = boxed.groupBy(*by, "h", "b").agg(F.count("*").cast("double").alias("m0"),
                                              *[m.alias(f"m{k}") for k, m in enumerate(moments, 1)])
    z = F.col("k") * (step / F.col("h")) - (F.col("b") + 0.5) * BOX
    factors = _hermite_sum([F.col(f"m{k}") for k in range(KERNEL_TERMS)])
    met = (summed.select(*by, "h", "b", *[f.alias(f"q{j}") for j, f in enumerate(factors)])
           .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("z", z))
    series = reduce(lambda total, j: total * F.col("z") + F.col(f"q{j}"), reversed(range(KERNEL_TERMS - 1)), F.col(f"q{KERNEL_TERMS - 1}"))
    # the exponential is zero in double precision beyond, where the series would overflow
    part = F.when(F.abs("z") < 40, series * F.exp(F.col("z") * F.col("z") * -0.5)).otherwise(0.0)
    sums = met.groupBy(*by, "k").agg(F.greatest(F.sum(part), F.lit(0.0)).alias("mass"))
    grid = stats.select(*by, "n", "h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    return grid.join(sums, [*by, "k"], "left").select(
        *by, (F.lit(start) + F.col("k") * step).alias("x"),
        (F.coalesce("mass", F.lit(0.0)) / F.nullif(F.col("n") * F.col("h") * math.sqrt(2 * math.pi), F.lit(0.0))).alias("density"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one named column per probability.

    A first pass brackets each wanted rank by mergeable quantile summaries, whose error is bounded; a second counts the
    values below each bracket and keeps only those inside, a few thousandths of the rows, to be ranked.  Small groups
    are their own bracket.  Equal values are counted before they are ordered.
    """
    data = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    marks = [m for p in probabilities.values() for m in (max(p - BRACKET, 0.0), min(p + BRACKET, 1.0))]
    first = data.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                                  F.percentile_approx("_v", marks, SUMMARY_SIZE).alias("_marks"))
    few = F.col("_n") <= FEW_ROWS
    ends = F.array(*[F.struct(
        F.when(few | F.lit(marks[2 * i] == 0.0), F.col("_min")).otherwise(F.col("_marks")[2 * i]).alias("low"),
        F.when(few | F.lit(marks[2 * i + 1] == 1.0), F.col("_max")).otherwise(F.col("_marks")[2 * i + 1]).alias("high"))
        for i in range(len(probabilities))])
    groups = if_small(first.select(*by, "_n", ends.alias("_ends")), F.lit(2 * len(probabilities) + len(by) + 1))
    placed = data.join(groups, list(by))
    below = placed.groupBy(*by).agg(*[F.count_if(F.col("_v") < F.col("_ends")[i]["low"]).alias(f"_below{i}") for i in range(len(probabilities))])
    inside = F.filter(F.transform("_ends", lambda e, i: F.when(F.col("_v").between(e["low"], e["high"]), i)), lambda i: i.isNotNull())
    counted = placed.select(*by, "_v", F.explode(inside).alias("_p")).groupBy(*by, "_p", "_v").agg(F.count("*").alias("_times"))
    upto = with_running_total(counted, [*by, "_p", "_v"], F.col("_times"), "_upto")
    before = if_small(upto.groupBy(*by, "_p").agg(F.min(F.col("_upto") - F.col("_times")).alias("_before")))
    counts = if_small(groups.drop("_ends").join(below, list(by)))
    ranked = upto.join(before, [*by, "_p"]).join(counts, list(by))
    picks: list[Column] = []
    for i, (name, p) in enumerate(probabilities.items()):
        position = (F.col("_n") - 1) * p
        within = F.when(F.col("_p") == i, F.col("_upto") - F.col("_before") + F.col(f"_below{i}"))
        picks += [F.min(F.when(within > F.floor(position), F.col("_v"))).alias(f"{name}|lo"),
                  F.min(F.when(within > F.ceil(position), F.col("_v"))).alias(f"{name}|hi")]
    found = ranked.groupBy(*by, "_n").agg(*picks)
    results = []
    for name, p in probabilities.items():
        position = (F.col("_n") - 1) * p
        low, high = F.col(f"`{name}|lo`"), F.col(f"`{name}|hi`")
        results.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return found.select(*by, *results)


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, extremes and quartiles per column."""
    long = unpivoted(df.select(*columns), columns, name="variable")
    basic = long.groupBy("variable").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return basic.join(exact_quantiles(long, ["variable"], "value", QUARTILES), "variable")


def boxplot_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean, quartiles, whiskers at the last values within 1.5 IQR, and the number of outliers."""
    present = df.select(*by, value).filter(F.col(value).isNotNull())
    box = exact_quantiles(present, by, value, QUARTILES).withColumns({
        "low_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
        "high_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    inside = F.col(value).between(F.col("low_fence"), F.col("high_fence"))
    return present.join(if_small(box), list(by)).groupBy(*by, "q1", "median", "q3").agg(
        F.avg(value).alias("mean"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def robust_limits(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """The smallest low quantile and the largest high quantile over all columns."""
    q = exact_quantiles(unpivoted(df.select(*columns), columns, name="variable"), ["variable"], "value",
                        {"low": low, "high": high})
    return q.agg(F.min("low").alias("vmin"), F.max("high").alias("vmax"))


def global_min_max(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.least(*[F.min(c) for c in columns]).alias("vmin"),
                  F.greatest(*[F.max(c) for c in columns]).alias("vmax"))


def residual_quantiles(df: DataFrame, truth: str, prediction: str, by: Sequence[str],
                       probabilities: Sequence[float]) -> DataFrame:
    """Residual quantiles beside those of a standard normal, per group: the points of a Q-Q plot."""
    names = {f"p{k}": p for k, p in enumerate(probabilities)}
    q = exact_quantiles(df.withColumn("residual", F.col(prediction) - F.col(truth)), by, "residual", names)
    rows = F.array(*[F.struct(F.lit(float(p)).alias("probability"), F.lit(NormalDist().inv_cdf(p)).alias("normal_quantile"),
                              F.col(n).alias("residual_quantile")) for n, p in names.items()])
    return q.select(*by, F.inline(rows))


def residual_points(df: DataFrame, truth: str, prediction: str, by: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Every residual with its plotting position (rank - 1/2) / n among those of its group: all points of a Q-Q plot.

    ``keys`` tell rows apart, so that ranks are total; rows are ranked over key ranges, not gathered by group.
    """
    residuals = df.select(*by, (F.col(prediction) - F.col(truth)).alias("residual"), *keys).filter("residual IS NOT NULL")
    ranked = with_rank(residuals, [*by, "residual", *keys])
    groups = if_small(ranked.groupBy(*by).agg(F.min("rank").alias("_first"), F.count("*").alias("_n")))
    return ranked.join(groups, list(by)).select(
        *by, *keys, "residual", ((F.col("rank") - F.col("_first") + 0.5) / F.col("_n")).alias("probability"))


def top_models(scores: DataFrame, criterion: str, n: int = 3) -> DataFrame:
    """The best models: highest R2, or lowest MAE or RMSE."""
    return scores.orderBy(F.desc(criterion) if criterion == "r2" else F.asc(criterion), "model").limit(n)


def top_features(importances: DataFrame, k: int | None = None, model: str = "model", feature: str = "feature",
                 importance: str = "importance") -> DataFrame:
    """The ``k`` most important features of each model, or all of them, ranked."""
    order = Window.partitionBy(model).orderBy(F.desc(importance), feature)
    ranked = importances.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def added_features(sets: DataFrame, model: str = "model", step: str = "step", features: str = "features") -> DataFrame:
    """What each step of a nested selection adds to the steps before it: (model, step, added), names joined by commas.

    A feature is added at the first step that has it, so sets need not repeat what earlier ones hold: giving each
    feature once, at its own step, is enough.  Steps that add nothing come out empty.
    """
    first = sets.select(model, step, F.explode(features).alias("_feature")).groupBy(model, "_feature").agg(F.min(step).alias(step))
    added = first.groupBy(model, step).agg(F.array_join(F.array_sort(F.collect_list("_feature")), ",").alias("added"))
    steps = sets.select(model, step).distinct()
    return steps.join(added, [model, step], "left").select(model, step, F.coalesce("added", F.lit("")).alias("added"))


def reindexed(df: DataFrame, key: str, labels: dict[str, str]) -> DataFrame:
    """Rows in the order of ``labels``, renamed; labels the table lacks come out empty."""
    entries = F.array(*[F.struct(F.lit(k).alias(key), F.lit(v).alias("label"), F.lit(n).alias("position"))
                        for n, (k, v) in enumerate(labels.items())])
    spine = df.sparkSession.range(1).select(F.inline(entries))
    return spine.join(df, key, "left").drop(key).orderBy("position")
