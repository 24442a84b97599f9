"""Properties of resampling, order statistics, densities and folds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.functions import calendar, optics
from airgrid.operators import features, masking, ranking, summaries, temporal


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_weighted_daily_mean_is_the_mean_of_snapshots(tables):
    masked = masking.quality_mask(tables.snapshots)
    two_steps = rows(temporal.daily_weighted_average(temporal.hourly_average(masked)), "time", "y", "x")
    direct = rows(temporal.with_target_depth(masked).groupBy(F.to_date("t").alias("time"), "y", "x").agg(
        F.avg("AOD").alias("AOD"), F.count("AOD").alias("n")), "time", "y", "x")
    assert two_steps.keys() == direct.keys()
    for k, r in direct.items():
        if r["AOD"] is None:
            assert two_steps[k]["AOD"] is None
        else:
            assert two_steps[k]["AOD"] == pytest.approx(r["AOD"], rel=1e-12)
            assert two_steps[k]["n_snapshots"] == r["n"]


def test_quality_rule_depends_on_the_number_of_flags(spark):
    data = [(1.0, 0.5, dqf, 0, n) for dqf in range(4) for n in (2, 4)] + [(1.0, 0.5, 0, 2, 4)]
    df = spark.createDataFrame(data, "AOD double, AE1 double, DQF int, AE_DQF int, n_flags int")
    got = [(r["DQF"], r["n_flags"], r["AOD"], r["AE1"]) for r in masking.quality_mask(df).collect()]
    assert [g for g in got if g[2] is not None and g[3] is not None] == [(0, 2, 1.0, 0.5), (0, 4, 1.0, 0.5), (1, 4, 1.0, 0.5)]
    assert (0, 4, 1.0, None) in got and len(got) == 9


def test_no_data_is_null_not_zero(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "k int, v double")
    got = rows(df.groupBy("k").agg(F.sum("v").alias("s"), temporal.observation_count("v").alias("n")), "k")
    assert (got[(1,)]["s"], got[(1,)]["n"]) == (None, None) and got[(2,)]["n"] == 1


def test_dense_bins(spark):
    df = spark.createDataFrame([("2024-01-01", 1, 5.0), ("2024-01-07", 2, 6.0)], "d string, k int, v double") \
        .withColumn("time", F.to_date("d")).drop("d")
    dense = temporal.densify_time(df, "time", "1 DAY", ["k"])
    assert dense.count() == 2 * 7 and dense.filter("v IS NOT NULL").count() == 2


def test_bins_of_several_days_start_with_the_data(spark):
    days = ["2024-01-03", "2024-01-04", "2024-01-05", "2024-01-09"]
    df = spark.createDataFrame([(d, float(k)) for k, d in enumerate(days)], "d string, v double").select(
        F.to_date("d").alias("time"), "v", F.lit(0).alias("k"))
    anchored = {str(r["time"]): r["v"] for r in temporal.resample_mean(df, "time", "2 days", ["k"], ["v"]).collect()}
    assert anchored == {"2024-01-03": 0.5, "2024-01-05": 2.0, "2024-01-09": 3.0}
    epoch = temporal.resample_mean(df, "time", "2 days", ["k"], ["v"], anchor="epoch")
    assert {str(r["time"]) for r in epoch.collect()} != set(anchored)


def test_seasonal_weights(spark):
    months = ["2023-01-31", "2023-02-28", "2023-03-31", "2023-12-31"]
    df = spark.createDataFrame([(m, 1, 10.0) for m in months] + [(months[0], 2, 10.0)], "m string, cell int, v double") \
        .withColumn("time", F.to_date("m"))
    got = rows(temporal.seasonal_weighted_mean(df, "time", ["cell"], ["v"]), "season", "cell")
    assert got[("DJF", 1)]["v"] == pytest.approx(10.0)
    assert got[("DJF", 2)]["v"] == pytest.approx(10.0 * 31 / (31 + 28 + 31))  # not scaled back up
    assert got[("MAM", 1)]["v"] == pytest.approx(10.0 * 31 / 92)  # April and May are on the axis
    full = rows(temporal.seasonal_weighted_mean(df, "time", ["cell"], ["v"], renormalise=True), "season", "cell")
    assert full[("DJF", 2)]["v"] == pytest.approx(10.0)


def test_time_slice_takes_the_whole_last_day(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-02 23:59:59' AS t UNION ALL SELECT timestamp_ntz'2024-01-03 00:00:00'")
    assert masking.time_slice(df, "t", "2024-01-01", "2024-01-02").count() == 1


def test_box_is_inclusive_unless_asked(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, y double")
    assert masking.bounding_box(df, "x", "y", (0.0, 0.0, 1.0, 1.0)).count() == 2
    assert masking.bounding_box(df, "x", "y", (0.0, 0.0, 1.0, 1.0), inclusive=False).count() == 0


def test_exponent_of_interpolated_depth_is_the_exponent(spark):
    df = spark.createDataFrame([(0.4, 1.3), (0.2, 0.7), (-0.1, 1.0)], "AOD double, AE1 double")
    there = df.withColumn("AOD470", optics.to_wavelength(F.col("AOD"), F.col("AE1"), 550.0, 470.0))
    back = there.select("AOD", "AE1", optics.exponent_between(F.col("AOD470"), F.col("AOD"), 470.0, 550.0).alias("AE")).collect()
    for r in back:
        assert r["AE"] == pytest.approx(r["AE1"])
    bad = spark.createDataFrame([(0.4, -0.1), (0.0, 1.0)], "a double, b double")
    assert [r[0] for r in bad.select(optics.exponent_between(F.col("b"), F.col("a"), 470.0, 550.0)).collect()] == [None, None]


def test_malformed_times_are_null(spark):
    df = spark.createDataFrame([("01:02:2021", "10:00:00"), ("31:02:2021", "10:00:00"), ("x", "y")], "d string, c string")
    got = [r[0] for r in df.select(calendar.site_timestamp(F.col("d"), F.col("c"))).collect()]
    assert got[0].month == 2 and got[1:] == [None, None]


def test_rank_does_not_depend_on_partitions_or_skew(spark, ranges):
    random.seed(4)
    data = [(7 if k % 3 else random.randrange(10**6), k) for k in range(5000)]  # one key value holds two thirds
    for parts in (1, 13):
        df = spark.createDataFrame(data, "a int, b int").repartition(parts)
        got = sorted((r["rank"], r["a"], r["b"]) for r in ranking.with_rank(df, ["a", "b"]).collect())
        assert got == [(n + 1, a, b) for n, (a, b) in enumerate(sorted(data))]


def test_exact_quantiles_with_ties_and_a_hot_group(spark, ranges):
    random.seed(9)
    data = [("hot", float(random.choice([1, 1, 1, 2, 5, 9]))) for _ in range(3000)] + [("few", random.random()) for _ in range(37)]
    data += [("one", 4.0), ("hot", None)]
    probabilities = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.99, "e": 1.0}
    got = rows(summaries.exact_quantiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", probabilities), "g")
    for g in ("hot", "few", "one"):
        values = [v for h, v in data if h == g and v is not None]
        for name, p in probabilities.items():
            assert got[(g,)][name] == pytest.approx(np.quantile(values, p))


def test_boxplot_whiskers(spark, ranges):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    got = summaries.boxplot_stats(spark.createDataFrame([("m", v) for v in values], "m string, v double"), ["m"], "v").first()
    assert (got["q1"], got["median"], got["q3"], got["whisker_low"], got["whisker_high"], got["n_outliers"]) == (2, 3, 4, 1, 4, 1)


def test_kernel_density_against_brute_force(spark):
    random.seed(6)
    data = {"a": [random.gauss(5, 2) for _ in range(300)], "b": [random.gauss(60, 0.3) for _ in range(50)]}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    got = rows(summaries.kde_curve(df, ["g"], "v", 0.0, 100.0, 101), "g", "x")
    assert len(got) == 2 * 101
    for g, vs in data.items():
        h = np.std(vs, ddof=1) * len(vs) ** -0.2
        for x in range(101):
            want = sum(math.exp(-((x - v) / h) ** 2 / 2) for v in vs) / (len(vs) * h * math.sqrt(2 * math.pi))
            assert got[(g, float(x))]["density"] == pytest.approx(want, abs=1e-12)


def test_kernel_density_keeps_far_tails(spark):
    values = [0.0, 0.1, -0.2, 0.05, 0.3, 50.0] * 5
    df = spark.createDataFrame([("a", v) for v in values], "g string, v double")
    h = np.std(values, ddof=1) * len(values) ** -0.2
    for r in summaries.kde_curve(df, ["g"], "v", -150.0, 250.0, 81).collect():
        want = sum(math.exp(-((r.x - v) / h) ** 2 / 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(want, rel=1e-2, abs=1e-300 if abs(r.x) < 80 else 1e-30)
        assert r.density >= 0.0
    far = summaries.kde_curve(df, ["g"], "v", -1e30, 1e30, 3).collect()
    assert all(r.density >= 0.0 for r in far)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (12.1,), (99999.9,), (100000.0,)], "m double")
    shares = rows(summaries.category_shares(df, ["m"], summaries.AQI_EDGES, summaries.AQI_CATEGORIES), "bin")
    assert [shares[(k,)]["n"] for k in range(8)] == [1, 1, 0, 0, 0, 0, 0, 1]
    assert sum(r["share"] for r in shares.values()) == pytest.approx(60.0)
    ends = rows(summaries.histogram_right_closed(spark.createDataFrame([(float(k),) for k in range(11)], "v double"), "v", 5), "bin")
    assert [ends[(k,)]["n"] for k in range(5)] == [3, 2, 2, 2, 2]
    assert sum(r["density"] * 2.0 for r in ends.values()) == pytest.approx(1.0)


def test_scores_ignore_rows_without_a_prediction(spark):
    df = spark.createDataFrame([(1.0, 1.5, 1.0), (2.0, 2.5, None), (4.0, 3.0, 4.0)], "y double, a double, b double")
    got = rows(summaries.regression_scores(df, "y", ["a", "b"]), "model")
    y, a = np.array([1, 2, 4.0]), np.array([1.5, 2.5, 3.0])
    assert got[("a",)]["r2"] == pytest.approx(1 - ((y - a) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got[("b",)]["rmse"] == 0 and got[("b",)]["n"] == 2 and got[("b",)]["r2"] == pytest.approx(1.0)


def test_standardise_uses_the_population_deviation(spark):
    df = features.standardise(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"])
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [(-1.0, 0.0), (1.0, 0.0)]


def test_contiguous_fold_sizes(spark, ranges):
    df = features.contiguous_folds(spark.range(23), ["id"], 5)
    assert [r["count"] for r in df.groupBy("fold").count().orderBy("fold").collect()] == [5, 5, 5, 4, 4]
    assert df.groupBy("fold").agg((F.max("id") - F.min("id") + 1 - F.count("*")).alias("gap")).filter("gap <> 0").count() == 0


@pytest.mark.parametrize("sizes", [[50] + [3] * 40, [1] * 100, list(range(1, 60))])
def test_group_folds(spark, ranges, sizes):
    df = spark.createDataFrame([(g, k) for g, n in enumerate(sizes) for k in range(n)], "g int, k int")
    table = features.group_fold_table(df, ["g"], 5).collect()
    assert sorted(r["g"] for r in table) == list(range(len(sizes)))
    loads = [sum(r["n_rows"] for r in table if r["fold"] == f) for f in range(5)]
    greedy = [0] * 5
    for n in sorted(sizes, reverse=True):
        greedy[greedy.index(min(greedy))] += n
    assert sorted(loads) == sorted(greedy)
    assert max(loads) - min(loads) <= max(sizes)


def test_holdout_share_and_repeatability(tables):
    split = features.holdout_split(tables.features, ["l_orderkey", "l_linenumber"])
    share = split.agg(F.avg(F.col("is_test").cast("int"))).first()[0]
    assert 0.17 < share < 0.23
    again = features.holdout_split(tables.features.repartition(7), ["l_orderkey", "l_linenumber"])
    assert split.filter("is_test").select("l_orderkey").exceptAll(again.filter("is_test").select("l_orderkey")).count() == 0


def test_months_absent_from_a_day_are_zero_columns(tables):
    one_month = tables.pred_grid.filter("month(time) = 3")
    inputs = features.model_inputs(one_month, ["linear", *features.MONTHS], keep=["y"])
    assert inputs.columns == ["y", "linear", *features.MONTHS]
    assert inputs.agg(F.min("month_3"), F.max("month_4")).first() == (1, 0)


def test_reindex_keeps_labels_that_have_no_row(spark):
    df = spark.createDataFrame([("lat", 1.0)], "feature string, v double")
    got = summaries.reindexed(df, "feature", {"lon": "Longitude", "lat": "Latitude"}).collect()
    assert [(r["label"], r["v"]) for r in got] == [("Longitude", None), ("Latitude", 1.0)]
