"""Queries over predictions, scores and features."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from airgrid.functions import calendar, text
from airgrid.learning.collection import stacked
from airgrid.operators import features, masking, summaries
from airgrid.plans.catalog import register
from airgrid.plans.text import rounded
from airgrid.session import spread

MODELS = ["linear", "forest", "trees"]
LONG = """long AS (SELECT l_orderkey, l_linenumber, truth, model, value FROM predictions
  UNPIVOT (value FOR model IN (linear, forest, trees)))"""
SCORES = f"""{LONG}, scores AS (
  SELECT model, 1 - sum(pow(truth - value, 2)) / (var_pop(truth) * count(*)) AS r2, avg(abs(truth - value)) AS mae,
         sqrt(avg(pow(truth - value, 2))) AS rmse, count(*) AS n FROM long GROUP BY 1)"""


@register("regression_scores", f"""WITH {SCORES}
    SELECT model, round(r2, 6) AS r2, round(mae, 6) AS mae, round(rmse, 6) AS rmse, n FROM scores""")
def _(t):
    return rounded(summaries.regression_scores(t.predictions, "truth", MODELS))


@register("top_n_models", f"""WITH {SCORES} SELECT model, round(rmse, 6) AS rmse FROM scores ORDER BY rmse LIMIT 2""")
def _(t):
    scores = summaries.regression_scores(t.predictions, "truth", MODELS)
    return rounded(summaries.top_models(scores, "rmse", 2).select("model", "rmse"))


@register("stacked_prediction", f"""WITH {SCORES}, best AS (SELECT model FROM scores ORDER BY rmse LIMIT 2)
    SELECT l_orderkey, l_linenumber, round(truth, 6) AS truth,
           round(((CASE WHEN 'linear' IN (SELECT model FROM best) THEN linear ELSE 0 END)
                + (CASE WHEN 'forest' IN (SELECT model FROM best) THEN forest ELSE 0 END)
                + (CASE WHEN 'trees' IN (SELECT model FROM best) THEN trees ELSE 0 END)) / 2, 6) AS stacked
    FROM predictions""")
def _(t):
    scores = summaries.regression_scores(t.predictions, "truth", MODELS)
    best = [r["model"] for r in summaries.top_models(scores, "rmse", 2).collect()]  # at most n names
    return rounded(t.predictions.select("l_orderkey", "l_linenumber", "truth", stacked(best).alias("stacked")))


@register("calibration_line", """
    SELECT 'linear' AS model, round(regr_slope(truth, linear), 6) AS slope, round(regr_intercept(truth, linear), 5) AS intercept,
           round(regr_r2(truth, linear), 6) AS r2 FROM predictions
    UNION ALL SELECT 'forest', round(regr_slope(truth, forest), 6), round(regr_intercept(truth, forest), 5), round(regr_r2(truth, forest), 6) FROM predictions
    UNION ALL SELECT 'trees', round(regr_slope(truth, trees), 6), round(regr_intercept(truth, trees), 5), round(regr_r2(truth, trees), 6) FROM predictions""")
def _(t):
    return rounded(summaries.best_fit_line(t.predictions, "truth", MODELS), intercept=5)


def shares_sql(edges, labels):
    bins = ", ".join(f"({k}, {edges[k]}e0, {edges[k + 1]}e0, '{c}', {str(k == len(labels) - 1).lower()})"
                     for k, c in enumerate(labels))
    return f"""WITH {LONG}, total AS (SELECT count(*) AS n_all FROM predictions),
    bins AS (SELECT * FROM (VALUES {bins}) AS b(bin, lower, upper, category, is_last)),
    models AS (SELECT DISTINCT model FROM long)
    SELECT m.model, b.bin, b.lower, b.category, count(value) AS n, round(count(value) / any_value(n_all) * 100, 6) AS share
    FROM models m CROSS JOIN bins b CROSS JOIN total LEFT JOIN long l
      ON l.model = m.model AND value >= lower AND (value < upper OR (is_last AND value = upper))
    GROUP BY 1, 2, 3, 4"""


@register("aqi_category_shares", shares_sql(summaries.AQI_EDGES, summaries.AQI_CATEGORIES))
def _(t):
    return rounded(summaries.category_shares(t.predictions, MODELS, summaries.AQI_EDGES, summaries.AQI_CATEGORIES))


@register("who_category_shares", shares_sql(summaries.WHO_EDGES, summaries.WHO_CATEGORIES))
def _(t):
    return rounded(summaries.category_shares(t.predictions, MODELS, summaries.WHO_EDGES, summaries.WHO_CATEGORIES))


@register("format_share", f"""WITH shares AS ({shares_sql(summaries.AQI_EDGES, summaries.AQI_CATEGORIES)}),
    total AS (SELECT count(*) AS n_all FROM predictions)
    SELECT model, bin, category, n,
           CAST(n AS VARCHAR) || ' (' || printf('%.1f', round_even(n / n_all * 100 * 10, 0) / 10) || ' %)' AS cell
    FROM shares, total""")
def _(t):
    shares = summaries.category_shares(t.predictions, MODELS, summaries.AQI_EDGES, summaries.AQI_CATEGORIES)
    return shares.select("model", "bin", "category", text.share_text(F.col("n"), F.col("share")).alias("cell"), "n")


@register("histogram_equal_width", """
    WITH top AS (SELECT CAST(floor(greatest(max(abs(truth)), max(abs(linear))) / 25e-2) AS INT) + 1 AS n_bins FROM predictions),
    spine AS (SELECT variable, CAST(unnest(range(n_bins)) AS INT) AS bin FROM top, (VALUES ('truth'), ('linear')) AS v(variable)),
    long AS (SELECT 'truth' AS variable, truth AS value FROM predictions UNION ALL SELECT 'linear', linear FROM predictions),
    counted AS (SELECT variable, CAST(floor(value / 25e-2) AS INT) AS bin, count(*) AS n FROM long WHERE value >= 0 GROUP BY 1, 2)
    SELECT variable, bin, bin * 25e-2 AS lower, coalesce(n, 0) AS n FROM spine LEFT JOIN counted USING (variable, bin)""")
def _(t):
    return summaries.histogram_from_zero(t.predictions, ["truth", "linear"], 0.25)


@register("histogram_right_closed", """
    WITH ends AS (SELECT min(forest) AS lo, max(forest) AS hi, (max(forest) - min(forest)) / 40 AS w, count(*) AS total FROM predictions),
    spine AS (SELECT CAST(unnest(range(40)) AS INT) AS bin),
    counted AS (SELECT CAST(least(greatest(ceil((forest - lo) / w), 1), 40) AS INT) - 1 AS bin, count(*) AS n
                FROM predictions, ends GROUP BY 1)
    SELECT bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper, coalesce(n, 0) AS n,
           round(coalesce(n, 0) / (total * w), 8) AS density
    FROM spine LEFT JOIN counted USING (bin) CROSS JOIN ends""")
def _(t):
    return rounded(summaries.histogram_right_closed(t.predictions, "forest", 40), density=8)


@register("histogram_left_closed", """
    WITH ends AS (SELECT min(forest) AS lo, max(forest) AS hi, (max(forest) - min(forest)) / 50 AS w, count(*) AS total FROM predictions),
    spine AS (SELECT CAST(unnest(range(50)) AS INT) AS bin),
    counted AS (SELECT CAST(least(floor((forest - lo) / w), 49) AS INT) AS bin, count(*) AS n FROM predictions, ends GROUP BY 1)
    SELECT bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper, coalesce(n, 0) AS n,
           round(coalesce(n, 0) / (total * w), 8) AS density
    FROM spine LEFT JOIN counted USING (bin) CROSS JOIN ends""")
def _(t):
    return rounded(summaries.histogram(t.predictions, "forest", 50), density=8)


@register("hexbin_counts", """
    WITH ends AS (SELECT min(linear) AS x0, (max(linear) - min(linear)) / 60 AS sx, min(truth) AS y0,
                         (max(truth) - min(truth)) / 34 AS sy FROM predictions),
    scaled AS (SELECT (linear - x0) / sx AS ix, (truth - y0) / sy AS iy, x0, sx, y0, sy FROM predictions, ends),
    lattice AS (SELECT *, pow(ix - floor(ix + 5e-1), 2) + 3 * pow(iy - floor(iy + 5e-1), 2)
                          < pow(ix - floor(ix) - 5e-1, 2) + 3 * pow(iy - floor(iy) - 5e-1, 2) AS first FROM scaled),
    hexes AS (SELECT CASE WHEN first THEN floor(ix + 5e-1) ELSE floor(ix) + 5e-1 END AS hx,
                     CASE WHEN first THEN floor(iy + 5e-1) ELSE floor(iy) + 5e-1 END AS hy, x0, sx, y0, sy FROM lattice)
    SELECT round(any_value(x0) + hx * any_value(sx), 6) AS center_x, round(any_value(y0) + hy * any_value(sy), 6) AS center_y,
           count(*) AS n, round(log10(count(*) + 1), 6) AS log_n FROM hexes GROUP BY hx, hy""")
def _(t):
    return rounded(summaries.hexbin_counts(t.predictions, "linear", "truth", 60))


KDE_TAIL = """
    SELECT {by}, round({start} + k * {step}, 6) AS x,
           round(sum(exp(-5e-1 * pow(({start} + k * {step} - value) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density
    FROM long JOIN stats USING ({by}) CROSS JOIN (SELECT unnest(range({points})) AS k) GROUP BY {by}, k"""


@register("kde_curve", f"""WITH {LONG},
    stats AS (SELECT model, count(*) AS n, stddev_samp(value) * pow(count(*), -2e-1) AS h FROM long GROUP BY 1)
    {KDE_TAIL.format(by="model", start="0e0", step="5e-1", points=201)}""")
def _(t):
    long = summaries.unpivoted(spread(t.predictions).select(*MODELS), MODELS)
    return rounded(summaries.kde_curve(long, ["model"], "value", 0.0, 100.0, 201), density=8)


@register("kde_by_group", f"""
    WITH long AS (SELECT CAST(year(time) AS INT) AS year, ln(linear) AS value FROM pred_grid WHERE linear > 0),
    stats AS (SELECT year, count(*) AS n, stddev_samp(value) * pow(count(*), -2e-1) AS h FROM long GROUP BY 1)
    {KDE_TAIL.format(by="year", start="-3e0", step="(8e0 / 149e0)", points=150)}""")
def _(t):
    logged = masking.log_columns(t.pred_grid.select(F.year("time").alias("year"), "linear"), ["linear"])
    return rounded(summaries.kde_curve(logged, ["year"], "linear", -3.0, 5.0, 150), density=8)


@register("log_transform", """
    SELECT time, y, x, round(ln(linear), 6) AS linear, round(ln(forest), 6) AS forest FROM pred_grid
    WHERE linear > 0 AND forest > 0""")
def _(t):
    return rounded(masking.log_columns(t.pred_grid.select("time", "y", "x", "linear", "forest"), ["linear", "forest"]))


@register("describe_numeric", """
    WITH long AS (SELECT variable, value FROM predictions UNPIVOT (value FOR variable IN (truth, linear, trees)))
    SELECT variable, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
           round(min(value), 6) AS min, round(max(value), 6) AS max, round(quantile_cont(value, 25e-2), 6) AS q1,
           round(quantile_cont(value, 5e-1), 6) AS median, round(quantile_cont(value, 75e-2), 6) AS q3
    FROM long GROUP BY 1""")
def _(t):
    return rounded(summaries.describe(t.predictions, ["truth", "linear", "trees"]))


@register("robust_limits", """
    SELECT round(least(quantile_cont(linear, 1e-2), quantile_cont(forest, 1e-2), quantile_cont(trees, 1e-2)), 6) AS vmin,
           round(greatest(quantile_cont(linear, 99e-2), quantile_cont(forest, 99e-2), quantile_cont(trees, 99e-2)), 6) AS vmax
    FROM pred_grid""")
def _(t):
    return rounded(summaries.robust_limits(t.pred_grid, MODELS))


@register("global_min_max", """
    SELECT round(least(min(linear), min(forest), min(trees)), 6) AS vmin,
           round(greatest(max(linear), max(forest), max(trees)), 6) AS vmax FROM pred_grid""")
def _(t):
    return rounded(summaries.global_min_max(t.pred_grid, MODELS))


QQ = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
IN_TEST = "CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20"


@register("residual_quantiles", f"""
    WITH points AS (SELECT * FROM (VALUES {", ".join(f"({p!r}e0, {NormalDist().inv_cdf(p)!r}e0)" for p in QQ)}) AS v(probability, normal_quantile)),
    residuals AS (SELECT {IN_TEST} AS is_test, linear - truth AS r FROM predictions),
    q AS (SELECT is_test, quantile_cont(r, {QQ!r}) AS qs FROM residuals GROUP BY 1),
    listed AS (SELECT is_test, unnest(qs) AS residual_quantile, unnest({QQ!r}) AS p FROM q)
    SELECT is_test, probability, round(normal_quantile, 6) AS normal_quantile, round(residual_quantile, 6) AS residual_quantile
    FROM listed JOIN points ON abs(probability - CAST(p AS DOUBLE)) < 1e-9""")
def _(t):
    split = features.holdout_split(t.predictions, ["l_orderkey", "l_linenumber"])
    return rounded(summaries.residual_quantiles(split, "truth", "linear", ["is_test"], QQ))


@register("residual_points", f"""
    SELECT l_orderkey, l_linenumber, {IN_TEST} AS is_test, round(linear - truth, 6) AS residual, round((row_number() OVER (
        PARTITION BY {IN_TEST} ORDER BY linear - truth, l_orderkey, l_linenumber) - 5e-1)
        / count(*) OVER (PARTITION BY {IN_TEST}), 9) AS probability FROM predictions""")
def _(t):
    split = features.holdout_split(t.predictions, ["l_orderkey", "l_linenumber"])
    points = summaries.residual_points(split, "truth", "linear", ["is_test"], ["l_orderkey", "l_linenumber"])
    return rounded(points, probability=9)


# ---- cross-validation score tables


@register("cv_summary", """
    SELECT model, round(avg(r2), 6) AS r2, round(avg(abs(neg_mae)), 6) AS mae, round(avg(abs(neg_rmse)), 6) AS rmse
    FROM cv_scores GROUP BY 1""")
def _(t):
    return rounded(summaries.score_summary(t.cv_scores))


@register("boxplot_stats", """
    WITH box AS (SELECT model, quantile_cont(r2, 25e-2) AS q1, quantile_cont(r2, 5e-1) AS median, quantile_cont(r2, 75e-2) AS q3
                 FROM cv_scores GROUP BY 1),
    joined AS (SELECT c.model, r2, q1, median, q3, r2 BETWEEN q1 - 15e-1 * (q3 - q1) AND q3 + 15e-1 * (q3 - q1) AS inside
               FROM cv_scores c JOIN box USING (model))
    SELECT model, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(avg(r2), 6) AS mean,
           round(min(r2) FILTER (inside), 6) AS whisker_low, round(max(r2) FILTER (inside), 6) AS whisker_high,
           count(*) FILTER (NOT inside) AS n_outliers FROM joined GROUP BY model, q1, median, q3""")
def _(t):
    return rounded(summaries.boxplot_stats(t.cv_scores, ["model"], "r2"))


@register("mean_with_stderr", """
    SELECT model, round(avg(fit_time), 6) AS mean, round(stddev_samp(fit_time) / sqrt(count(fit_time)), 6) AS stderr
    FROM cv_scores GROUP BY 1""")
def _(t):
    return rounded(summaries.mean_with_stderr(t.cv_scores, ["model"], "fit_time"))


@register("learning_curve_summary", """
    SELECT model, fold % 20 + 1 AS train_size, round(avg(r2), 6) AS mean, round(stddev_pop(r2), 6) AS std
    FROM cv_scores GROUP BY 1, 2""")
def _(t):
    sized = t.cv_scores.withColumn("train_size", F.col("fold") % 20 + 1)
    return rounded(summaries.mean_with_spread(sized, ["model", "train_size"], "r2"))


@register("score_compare", """
    WITH s AS (SELECT model, fold % 2 AS kind, avg(r2) AS r2, avg(abs(neg_mae)) AS mae, avg(abs(neg_rmse)) AS rmse
               FROM cv_scores GROUP BY 1, 2)
    SELECT a.model, round(b.r2, 6) AS r2, round(b.mae, 6) AS mae, round(b.rmse, 6) AS rmse,
           round((a.r2 - b.r2) / a.r2 * 100, 6) AS r2_change, round((a.mae - b.mae) / a.mae * 100, 6) AS mae_change,
           round((a.rmse - b.rmse) / a.rmse * 100, 6) AS rmse_change,
           printf('%.2f (%.2f%%)', b.mae, (a.mae - b.mae) / a.mae * 100) AS mae_text
    FROM s a JOIN s b ON a.model = b.model AND a.kind = 0 AND b.kind = 1""")
def _(t):
    # one pass for both score tables
    wide = t.cv_scores.groupBy("model").agg(*[
        F.avg(F.when(F.col("fold") % 2 == k, F.abs(c))).alias(f"{n}_{k}")
        for k in (0, 1) for n, c in (("mae", "neg_mae"), ("rmse", "neg_rmse"))],
        *[F.avg(F.when(F.col("fold") % 2 == k, F.col("r2"))).alias(f"r2_{k}") for k in (0, 1)])
    tables = [wide.select("model", *[F.col(f"{n}_{k}").alias(n) for n in ("r2", "mae", "rmse")]) for k in (0, 1)]
    compared = summaries.percent_change(tables[0], tables[1], "model", ["r2", "mae", "rmse"])
    return rounded(compared.withColumn("mae_text", text.change_text(F.col("mae"), F.col("mae_change"))))


LABELS = {"trees": "Extra Trees", "forest": "Random Forest", "linear": "Linear Regression", "mlp": "MLP"}


@register("reindex_labels", """
    WITH spine AS (SELECT * FROM (VALUES ('trees', 'Extra Trees', 0), ('forest', 'Random Forest', 1),
                                         ('linear', 'Linear Regression', 2), ('mlp', 'MLP', 3)) AS v(model, label, position)),
    s AS (SELECT model, avg(r2) AS r2 FROM cv_scores GROUP BY 1)
    SELECT label, position, round(r2, 6) AS r2 FROM spine LEFT JOIN s USING (model)""")
def _(t):
    scores = t.cv_scores.groupBy("model").agg(F.avg("r2").alias("r2"))
    return rounded(summaries.reindexed(scores, "model", LABELS))


IMPORTANCES = """importances AS (
  SELECT p_brand AS model, p_type AS feature, avg(p_retailprice) AS importance FROM part GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank FROM importances)"""


def importances(t):
    return t.part.groupBy(F.col("p_brand").alias("model"), F.col("p_type").alias("feature")).agg(
        F.avg("p_retailprice").alias("importance"))


@register("top_k_features", f"""WITH {IMPORTANCES}
    SELECT model, feature, round(importance, 4) AS importance, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 3""")
def _(t):
    return rounded(summaries.top_features(importances(t), 3), 4)


@register("incremental_features", f"""WITH {IMPORTANCES}
    SELECT model, CAST(rank AS INT) AS step, feature AS added FROM ranked""")
def _(t):
    # a set differs from the one before it by one feature, and repeats at least the one before that
    ranked = summaries.top_features(importances(t)).select("model", "rank", "feature")
    held = ranked.union(ranked.select("model", (F.col("rank") + 1).alias("rank"), "feature").join(ranked.select("model", "rank"), ["model", "rank"], "left_semi"))
    sets = held.groupBy("model", F.col("rank").alias("step")).agg(F.collect_list("feature").alias("features"))
    return summaries.added_features(sets).select("model", "step", "added")


# ---- features and splits


@register("season_label", """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN month(time) IN (12, 1, 2) THEN 'winter' WHEN month(time) < 6 THEN 'spring'
           WHEN month(time) < 9 THEN 'summer' ELSE 'fall' END AS season FROM features""")
def _(t):
    return t.features.select("l_orderkey", "l_linenumber", "l_partkey", calendar.season_label(F.col("time")).alias("season"))


@register("one_hot_month", "SELECT l_orderkey, l_linenumber, l_partkey, " + ", ".join(
    f"CAST(month(time) = {m} AS INT) AS month_{m}" for m in range(1, 13)) + " FROM features")
def _(t):
    return features.one_hot_month(t.features).select("l_orderkey", "l_linenumber", "l_partkey", *features.MONTHS)


@register("one_hot_season", """
    SELECT l_orderkey, l_linenumber, l_partkey, CAST(month(time) IN (9, 10, 11) AS INT) AS season_fall, CAST(month(time) IN (3, 4, 5) AS INT) AS season_spring,
           CAST(month(time) IN (6, 7, 8) AS INT) AS season_summer, CAST(month(time) IN (12, 1, 2) AS INT) AS season_winter
    FROM features""")
def _(t):
    return features.one_hot_season(t.features).select("l_orderkey", "l_linenumber", "l_partkey", *[
        f"season_{s}" for s in ("fall", "spring", "summer", "winter")])


@register("score_features", """
    SELECT time, y, x, round(linear, 6) AS linear, round(trees, 6) AS trees, """ + ", ".join(
    f"CAST(month(time) = {m} AS INT) AS month_{m}" for m in range(1, 13)) + " FROM pred_grid WHERE trees IS NOT NULL")
def _(t):
    return rounded(features.model_inputs(t.pred_grid, ["linear", "trees", *features.MONTHS], keep=["time", "y", "x"]))


@register("standardise", """
    WITH m AS (SELECT avg(AOD) AS ma, stddev_pop(AOD) AS sa, avg(blh) AS mb, stddev_pop(blh) AS sb FROM features)
    SELECT l_orderkey, l_linenumber, l_partkey, round((AOD - ma) / sa, 6) AS AOD, round((blh - mb) / sb, 6) AS blh FROM features, m""")
def _(t):
    return rounded(features.standardise(t.features.select("l_orderkey", "l_linenumber", "l_partkey", "AOD", "blh"), ["AOD", "blh"]))


@register("holdout_split", f"SELECT l_orderkey, l_linenumber, l_partkey, {IN_TEST} AS is_test FROM features")
def _(t):
    return features.holdout_split(t.features, ["l_orderkey", "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "is_test")


ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
ROW_KEY_SQL = ", ".join(ROW_KEY)


@register("kfold_assign", f"SELECT {ROW_KEY_SQL}, CAST(ntile(5) OVER (ORDER BY {ROW_KEY_SQL}) - 1 AS INT) AS fold FROM features")
def _(t):
    return features.contiguous_folds(t.features.select(*ROW_KEY), ROW_KEY, 5)


@register("stratified_kfold", f"""
    WITH ends AS (SELECT min(PM25) AS lo, (max(PM25) - min(PM25)) / 5 AS w FROM features),
    binned AS (SELECT {ROW_KEY_SQL}, CAST(least(greatest(ceil((PM25 - lo) / w), 1), 5) AS INT) AS stratum FROM features, ends)
    SELECT {ROW_KEY_SQL}, stratum, CAST((row_number() OVER (PARTITION BY stratum ORDER BY {ROW_KEY_SQL}) - 1) % 5 AS INT) AS fold
    FROM binned""")
def _(t):
    return features.stratified_folds(t.features.select(*ROW_KEY, "PM25"), "PM25", ROW_KEY, 5).drop("PM25")


# groups from the largest down, one at a time, each into the lightest of ten folds
GREEDY = """sizes AS (SELECT lat, lon, count(*) AS n FROM features GROUP BY 1, 2),
    ordered AS (SELECT lat, lon, n, row_number() OVER (ORDER BY n DESC, lat, lon) AS r FROM sizes),
    placed AS (
      SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS n, CAST(0 AS INT) AS fold, CAST([0, 0, 0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]) AS loads
      UNION ALL
      SELECT o.r, o.n, CAST(list_position(loads, list_min(loads)) - 1 AS INT),
             list_transform(loads, lambda v, i: v + CASE WHEN i = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END)
      FROM placed p JOIN ordered o ON o.r = p.r + 1)"""


@register("group_kfold", f"""
    WITH RECURSIVE {GREEDY},
    folds AS (SELECT n, fold, row_number() OVER (PARTITION BY n ORDER BY fold) AS k FROM placed WHERE r > 0),
    groups AS (SELECT lat, lon, n, row_number() OVER (PARTITION BY n ORDER BY lat, lon) AS k FROM ordered)
    SELECT lat, lon, n AS n_rows, fold FROM groups JOIN folds USING (n, k)""")
def _(t):
    return features.group_fold_table(t.features, ["lat", "lon"], 10)


@register("group_kfold_loads", f"""
    WITH RECURSIVE {GREEDY}
    SELECT fold, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rows FROM placed WHERE r > 0 GROUP BY 1""")
def _(t):
    table = features.group_fold_table(t.features, ["lat", "lon"], 10)
    return table.groupBy("fold").agg(F.count("*").alias("n_groups"), F.sum("n_rows").alias("n_rows"))
