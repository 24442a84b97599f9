"""Queries that train, compare and apply models."""

from __future__ import annotations

import json

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from airgrid.functions import text
from airgrid.learning import selection
from airgrid.learning.collection import (ModelCollection, ModelStack, column_name, default_models, feature_importances,
                                         tree_lines)
from airgrid.learning.linear import BayesianRidge
from airgrid.learning.trees import BoostedTrees
from airgrid.operators import features, matching, scoring
from airgrid.operators.binding import if_small
from airgrid.plans.catalog import register
from airgrid.plans.matching_queries import met_axes
from airgrid.plans.report_queries import IN_TEST, ROW_KEY
from airgrid.plans.streaming_queries import stream
from airgrid.plans.text import rounded
from airgrid.session import scratch_path, spread
from airgrid.streaming import incremental

INPUTS = ["AOD", "t2m", "blh"]
LABEL = "PM25"
SITE = ["lat", "lon"]


def split(t):
    marked = features.holdout_split(spread(t.features), ["l_orderkey", "l_linenumber"])
    return marked.filter(~F.col("is_test")), marked.filter("is_test")


def fitted(t, names) -> tuple[ModelCollection, object]:
    chosen = default_models(LABEL)
    collection = ModelCollection(INPUTS, LABEL, {n: chosen[n] for n in names})
    train, test = split(t)
    return collection.fit(train), test


@register("ml_linear", """
    SELECT round(regr_slope(PM25, AOD), 6) AS slope, round(regr_intercept(PM25, AOD), 6) AS intercept,
           round(regr_r2(PM25, AOD), 6) AS r2, count(*) AS n FROM features""")
def _(t):
    table = VectorAssembler(inputCols=["AOD"], outputCol="features").transform(spread(t.features))
    model = LinearRegression(featuresCol="features", labelCol=LABEL, predictionCol="linear", solver="normal").fit(table)
    scored = model.transform(table)
    error = F.col(LABEL) - F.col("linear")
    return rounded(scored.agg(
        F.lit(float(model.coefficients[0])).alias("slope"), F.lit(float(model.intercept)).alias("intercept"),
        (1 - F.sum(error * error) / (F.var_pop(LABEL) * F.count("*"))).alias("r2"), F.count("*").alias("n")))


@register("ml_linear_holdout", f"""
    WITH split AS (SELECT *, {IN_TEST} AS is_test FROM features),
    line AS (SELECT regr_slope(PM25, AOD) AS b, regr_intercept(PM25, AOD) AS a FROM split WHERE NOT is_test)
    SELECT count(*) AS n, round(sqrt(avg(pow(PM25 - a - b * AOD, 2))), 6) AS rmse, round(avg(abs(PM25 - a - b * AOD)), 6) AS mae
    FROM split, line WHERE is_test""")
def _(t):
    train, test = split(t)
    collection = ModelCollection(["AOD"], LABEL, {"Linear Regression": default_models(LABEL)["Linear Regression"]}).fit(train)
    return rounded(collection.compute_scores(test).select("n", "rmse", "mae"))


@register("elastic_net_line", """
    WITH m AS (SELECT covar_pop(blh, PM25) AS c, var_pop(blh) AS v, avg(blh) AS mx, avg(PM25) AS my, stddev_samp(PM25) AS sy FROM features),
    line AS (SELECT sign(c) * greatest(abs(c) - 5e-1, 0) / (v + 5e-1 / sy) AS b, mx, my FROM m)
    SELECT round(b, 4) AS slope, round(my - b * mx, 4) AS intercept FROM line""")
def _(t):
    # one input: the penalties shrink the covariance and raise the variance; the second is taken relative to the label's deviation
    collection = ModelCollection(["blh"], LABEL, {"Elastic Net": default_models(LABEL)["Elastic Net"]}).fit(t.features)
    line = collection.fitted["Elastic Net"].stages[-1]
    return rounded(t.spark.createDataFrame([(float(line.coefficients[0]), float(line.intercept))], "slope double, intercept double"), 4)


@register("polynomial_line", """
    WITH m AS (SELECT var_pop(blh) AS v1, var_pop(blh * blh) AS v2, covar_pop(blh, blh * blh) AS c12, covar_pop(blh, PM25) AS c1,
        covar_pop(blh * blh, PM25) AS c2, avg(blh) AS m1, avg(blh * blh) AS m2, avg(PM25) AS my FROM features),
    curve AS (SELECT (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2, m1, m2, my FROM m)
    SELECT l_orderkey, l_linenumber, round(my + b1 * (blh - m1) + b2 * (blh * blh - m2), 4) AS polynomial FROM features, curve""")
def _(t):
    collection = ModelCollection(["blh"], LABEL, {"Polynomial": default_models(LABEL)["Polynomial"]}).fit(t.features)
    return rounded(collection.predict(t.features.select(*ROW_KEY, "blh")).select("l_orderkey", "l_linenumber", "polynomial"), 4)


@register("ridge_line", """
    WITH RECURSIVE m AS (SELECT count(*) AS n, covar_pop(blh, PM25) * count(*) AS xy, var_pop(blh) * count(*) AS xx, var_pop(PM25) * count(*) AS yy,
        var_pop(PM25) AS vy, avg(blh) AS mx, avg(PM25) AS my FROM features),
    steps AS (
      SELECT 0 AS k, 0e0 AS w, 1 / (vy + 2.220446049250313e-16) AS alpha, 1e0 AS lam FROM m
      UNION ALL
      SELECT k + 1, xy / (xx + lam / alpha), (n - g + 2e-6) / (rss + 2e-6), (g + 2e-6) / (w2 + 2e-6) FROM (
        SELECT k, alpha, lam, n, xx, xy, alpha * xx / (lam + alpha * xx) AS g, pow(xy / (xx + lam / alpha), 2) AS w2,
               yy - 2 * xy / (xx + lam / alpha) * xy + pow(xy / (xx + lam / alpha), 2) * xx AS rss
        FROM steps, m WHERE k < 20)),
    line AS (SELECT xy / (xx + lam / alpha) AS b, mx, my FROM steps, m WHERE k = 20)
    SELECT round(b, 4) AS slope, round(my - b * mx, 4) AS intercept FROM line""")
def _(t):
    table = VectorAssembler(inputCols=["blh"], outputCol="features").transform(t.features)
    model = BayesianRidge(featuresCol="features", labelCol=LABEL).fit(table)
    row = (float(model.getOrDefault(model.coefficients)[0]), float(model.getOrDefault(model.intercept)))
    return rounded(t.spark.createDataFrame([row], "slope double, intercept double"), 4)


def scores_of(name):
    def run(t):
        collection, test = fitted(t, [name])
        return rounded(collection.compute_scores(test), 3)

    return run


register("ml_elastic_net")(scores_of("Elastic Net"))
register("ml_polynomial")(scores_of("Polynomial"))
register("ml_svr")(scores_of("SVR"))
register("ml_mlp")(scores_of("MLP"))
register("ml_ada_boost")(scores_of("Ada Boost"))
@register("tree_stump", """
    WITH sums AS (SELECT blh, count(*) AS n, sum(PM25) AS s FROM features GROUP BY blh),
    cuts AS (SELECT blh, sum(n) OVER w AS n_left, sum(s) OVER w AS s_left, sum(n) OVER () AS n_all, sum(s) OVER () AS s_all
             FROM sums WINDOW w AS (ORDER BY blh)),
    best AS (SELECT * FROM cuts WHERE n_left < n_all
             ORDER BY round(s_left * s_left / n_left + (s_all - s_left) * (s_all - s_left) / (n_all - n_left) - s_all * s_all / n_all, 3) DESC, blh LIMIT 1)
    SELECT blh AS cut, round(s_left / n_left, 4) AS below, round((s_all - s_left) / (n_all - n_left), 4) AS above, CAST(n_left AS BIGINT) AS n_below FROM best""")
def _(t):
    # a boosted tree of one level from nothing: its leaves are the means on either side of the best cut
    rows = spread(t.features)
    table = VectorAssembler(inputCols=["blh"], outputCol="features").transform(rows)
    model = BoostedTrees(labelCol=LABEL, maxIter=1, stepSize=1.0, maxDepth=1).fit(table)
    scored = model.transform(table.select("features", "blh"))
    sides = scored.groupBy("prediction").agg(F.max("blh").alias("cut"), F.count("*").alias("n"))
    low = F.struct("cut", "prediction", "n")
    return rounded(sides.agg(F.min(low).alias("low"), F.max(low).alias("high")).select(
        F.col("low.cut").alias("cut"), F.col("low.prediction").alias("below"), F.col("high.prediction").alias("above"), F.col("low.n").alias("n_below")), 4)


register("ml_random_forest")(scores_of("Random Forest"))
register("ml_extra_trees")(scores_of("Extra Trees"))
register("ml_gradient_boost")(scores_of("Gradient Boost"))
register("ml_xgboost")(scores_of("XGBoost"))


@register("ml_bayesian_ridge")
def _(t):
    table = VectorAssembler(inputCols=INPUTS, outputCol="features").transform(t.features)
    model = BayesianRidge(featuresCol="features", labelCol=LABEL).fit(table)
    weights = model.getOrDefault(model.coefficients)
    rows = [(n, float(w)) for n, w in zip([*INPUTS, "intercept"], [*weights, model.getOrDefault(model.intercept)])]
    return rounded(t.spark.createDataFrame(rows, "term string, weight double"), 6)


FAST = ["Linear Regression", "Polynomial", "Bayesian Ridge"]
REFERENCE = [*FAST, "MLP", "Random Forest", "Extra Trees", "XGBoost"]


@register("model_predictions")
def _(t):
    collection, test = fitted(t, [*FAST, "Random Forest"])
    return rounded(collection.predict(test.select(*ROW_KEY, *INPUTS, LABEL)), 4)


def site_folds(t, k):
    table = features.group_fold_table(t.features, SITE, k).drop("n_rows")
    return spread(t.features).join(if_small(table), SITE)


def reference_models():
    models = default_models(LABEL)
    return {n: models[n] for n in REFERENCE}


@register("cross_val_scores")
def _(t):
    collection = ModelCollection(INPUTS, LABEL, reference_models())
    return rounded(collection.cross_validate(site_folds(t, 10), "fold", 10, parallel=3), 4)


@register("model_stack")
def _(t):
    collection, test = fitted(t, [*FAST, "Random Forest"])
    train, _ = split(t)
    stack = ModelStack(collection, collection.compute_scores(test), "rmse", 3).fit(train)
    return rounded(stack.compute_scores(test), 4)


@register("grid_search")
def _(t):
    collection = ModelCollection(INPUTS, LABEL)
    found = collection.tune(site_folds(t, 10), "fold")
    collection.update_models()
    rows = [(column_name(name), json.dumps({p.name: v for p, v in point.items()}, sort_keys=True), float(metric), point == best["best"])
            for name, best in found.items() for point, metric in zip(best["grid"], best["metrics"])]
    return rounded(t.spark.createDataFrame(rows, "model string, point string, r2 double, is_best boolean"), 4)


@register("learning_curve")
def _(t):
    pipeline = default_models(LABEL)["Linear Regression"]
    shares = [k / 20 for k in range(1, 21)]
    return rounded(selection.learning_curve(pipeline, site_folds(t, 5), INPUTS, LABEL, "fold", 5, ROW_KEY, shares), 4)


def plain_curve(name):
    """The curve of a model under plain folds by row order."""

    def run(t):
        folds = features.contiguous_folds(spread(t.features), ROW_KEY, 5)
        shares = [k / 20 for k in range(1, 21)]
        return rounded(selection.learning_curve(default_models(LABEL)[name], folds, INPUTS, LABEL, "fold", 5, ROW_KEY, shares), 4)

    return run


register("learning_curve_linear")(plain_curve("Linear Regression"))
register("learning_curve_extra_trees")(plain_curve("Extra Trees"))
register("learning_curve_mlp")(plain_curve("MLP"))


@register("forward_selection")
def _(t):
    steps = selection.forward_selection(site_folds(t, 5), [*INPUTS, "lat", "lon", "n_snapshots"], LABEL, "fold", 5)
    return rounded(steps.withColumn("features", F.array_join("features", ",")), 4)


@register("inclusion_curve")
def _(t):
    return rounded(selection.inclusion_curve(site_folds(t, 5), ["blh", "AOD", "t2m", "lat"], LABEL, "fold", 5), 4)


@register("feature_importance")
def _(t):
    collection, _ = fitted(t, ["Random Forest"])
    return rounded(feature_importances(collection.fitted["Random Forest"], INPUTS, t.spark), 4)


@register("tree_inspection")
def _(t):
    collection, _ = fitted(t, ["Random Forest"])
    return tree_lines(collection.fitted["Random Forest"], t.spark)


def weather_grid(t):
    """The daily field with the weather of the nearest node."""
    lon_axis, lat_axis = met_axes(t)
    located = t.daily_grid.join(t.grid_cells.select("y", "x", "lat", "lon"), ["y", "x"])
    return matching.nearest_node_join(located, t.met_daily, lon_axis, lat_axis, ["time"], ["t2m", "blh"])


@register("grid_scoring")
def _(t):
    inputs = [*INPUTS, *features.MONTHS]
    collection = ModelCollection(inputs, LABEL, reference_models())
    collection.fit(features.model_inputs(spread(t.features), inputs, keep=[LABEL]))
    return rounded(scoring.score_grid(weather_grid(t), inputs, collection.predict), 4)


LINE = "line AS (SELECT regr_slope(PM25, AOD) AS b, regr_intercept(PM25, AOD) AS a FROM features)"


@register("grid_scoring_linear", f"""WITH {LINE}
    SELECT time, y, x, round(a + b * AOD, 4) AS linear_regression FROM daily_grid, line""")
def _(t):
    collection = ModelCollection(["AOD"], LABEL, {"Linear Regression": default_models(LABEL)["Linear Regression"]})
    collection.fit(spread(t.features))
    return rounded(scoring.score_grid(t.daily_grid, ["AOD"], collection.predict), 4)


@register("saved_model_scoring", f"""WITH {LINE}
    SELECT time, y, x, round(a + b * AOD, 4) AS linear_regression FROM daily_grid, line""")
def _(t):
    collection = ModelCollection(["AOD"], LABEL, {"Linear Regression": default_models(LABEL)["Linear Regression"]})
    collection.fit(t.features)
    path = scratch_path(t.spark, "models")
    collection.save(path)
    return rounded(scoring.score_grid(t.daily_grid, ["AOD"], ModelCollection.load(path).predict), 4)


@register("cross_val_linear", """
    WITH folded AS (SELECT AOD, PM25, CAST(CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 // 20 AS INT) AS fold
                    FROM features),
    folds AS (SELECT DISTINCT fold FROM folded),
    lines AS (SELECT s.fold, regr_slope(PM25, AOD) AS b, regr_intercept(PM25, AOD) AS a
              FROM folds s JOIN folded r ON r.fold <> s.fold GROUP BY 1)
    SELECT fold, round(1 - sum(pow(PM25 - a - b * AOD, 2)) / (var_pop(PM25) * count(*)), 6) AS r2,
           round(-avg(abs(PM25 - a - b * AOD)), 6) AS neg_mae, round(-sqrt(avg(pow(PM25 - a - b * AOD, 2))), 6) AS neg_rmse, count(*) AS n
    FROM folded JOIN lines USING (fold) GROUP BY 1""")
def _(t):
    folded = spread(t.features).withColumn("fold", F.floor(text.hash_percent(F.col("l_orderkey")) / 20).cast("int"))
    collection = ModelCollection(["AOD"], LABEL, {"Linear Regression": default_models(LABEL)["Linear Regression"]})
    scores = collection.cross_validate(folded, "fold", 5, parallel=2)
    return rounded(scores.select("fold", "r2", "neg_mae", "neg_rmse", "n"))


@register("inclusion_linear", """
    WITH folded AS (SELECT blh, PM25, CAST(CAST('0x' || substr(md5(CAST(l_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 // 20 AS INT) AS fold
                    FROM features),
    folds AS (SELECT DISTINCT fold FROM folded),
    lines AS (SELECT s.fold, regr_slope(PM25, blh) AS b, regr_intercept(PM25, blh) AS a
              FROM folds s JOIN folded r ON r.fold <> s.fold GROUP BY 1)
    SELECT 1 AS n_features, fold, round(1 - sum(pow(PM25 - a - b * blh, 2)) / (var_pop(PM25) * count(*)), 6) AS r2
    FROM folded JOIN lines USING (fold) GROUP BY 2""")
def _(t):
    folded = t.features.withColumn("fold", F.floor(text.hash_percent(F.col("l_orderkey")) / 20).cast("int"))
    return rounded(selection.inclusion_curve(folded, ["blh"], LABEL, "fold", 5))


@register("stream_scoring", f"""WITH {LINE}
    SELECT event_id, s.y, s.x, CASE WHEN c.lat IS NOT NULL THEN round(a + b * s.AOD, 4) END AS linear_regression
    FROM snapshots s LEFT JOIN grid_cells c ON c.y = s.y AND c.x = s.x CROSS JOIN line""")
def _(t):
    collection = ModelCollection(["AOD"], LABEL, {"Linear Regression": default_models(LABEL)["Linear Regression"]})
    collection.fit(spread(t.features))
    cells = t.grid_cells.select("y", "x", "lat")
    scored = incremental.scored_stream(stream(t).select("event_id", "y", "x", "AOD"), cells, collection.predict, ["AOD", "lat"],
                                       ["linear_regression"])
    out = scratch_path(t.spark, "scored")
    incremental.run_to_table(scored, out, scratch_path(t.spark, "checkpoint"))
    return rounded(t.spark.read.parquet(out).select("event_id", "y", "x", "linear_regression"), 4)
