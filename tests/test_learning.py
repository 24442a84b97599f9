"""Estimators, selection and the model collection."""

import warnings

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from airgrid.learning import selection
from airgrid.learning.base import feature_means, moments
from airgrid.learning.collection import (ModelCollection, ModelStack, column_name, default_models, feature_importances,
                                         mlp_layouts, tree_lines)
from airgrid.learning.linear import BayesianRidge, LinearSVR, nystroem_features
from airgrid.learning.network import Perceptron
from airgrid.learning.trees import AdaBoost, AdaBoostModel, ExtraTrees, ExtraTreesModel
from airgrid.operators import features, scoring, summaries

INPUTS = ["AOD", "t2m", "blh"]


@pytest.fixture(scope="module")
def table(tables):
    marked = features.holdout_split(tables.features, ["l_orderkey", "l_linenumber"])
    folded = marked.withColumn("fold", F.pmod(F.xxhash64("l_orderkey"), F.lit(3)).cast("int"))
    return VectorAssembler(inputCols=INPUTS, outputCol="features").transform(folded).persist()


@pytest.fixture(scope="module")
def arrays(table):
    pdf = table.select(*INPUTS, "PM25").toPandas()
    return pdf[INPUTS].to_numpy(), pdf["PM25"].to_numpy()


def r2(model, table, column="prediction"):
    return summaries.regression_scores(model.transform(table), "PM25", [column]).first()["r2"]


def test_linear_recovers_the_planted_signal(table):
    model = default_models("PM25")["Linear Regression"].fit(table).stages[-1]
    assert model.coefficients[0] == pytest.approx(40.0, abs=0.5)
    assert model.coefficients[2] == pytest.approx(0.1, abs=0.01)


def test_moments_match_numpy(table, arrays):
    x, y = arrays
    rows = BayesianRidge(labelCol="PM25").training_rows(table)
    center = feature_means(rows)
    assert center == pytest.approx(x.mean(axis=0))
    z = np.column_stack([np.ones(len(y)), x - center, y])
    assert moments(rows, 3, center)[0] == pytest.approx(z.T @ z)


def test_bayesian_ridge_is_ridge_at_its_own_precisions(table, arrays):
    x, y = arrays
    model = BayesianRidge(labelCol="PM25").fit(table)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    ridge = np.linalg.solve(xc.T @ xc + model.weight_precision / model.noise_precision * np.eye(3), xc.T @ yc)
    assert model.getOrDefault(model.coefficients) == pytest.approx(ridge.tolist(), rel=1e-4)
    predicted = x @ ridge + (y.mean() - x.mean(axis=0) @ ridge)
    assert model.noise_precision == pytest.approx(1 / np.mean((y - predicted) ** 2), rel=0.01)


@pytest.mark.parametrize("estimator", [
    LinearSVR(labelCol="PM25", maxIter=40),
    Perceptron(labelCol="PM25", hidden=[16], maxIter=12, batchSize=50, stepSize=0.01),
    ExtraTrees(labelCol="PM25", numTrees=4, maxDepth=6),
    AdaBoost(labelCol="PM25", numTrees=5),
], ids=lambda e: type(e).__name__)
def test_beats_the_mean_and_survives_a_round_trip(estimator, table, tmp_path):
    model = Pipeline(stages=[estimator]).fit(table.filter(~F.col("is_test")))
    test = table.filter("is_test")
    score = r2(model, test)
    assert score > 0.5
    model.write().overwrite().save(str(tmp_path / "m"))
    assert r2(PipelineModel.load(str(tmp_path / "m")), test) == pytest.approx(score, abs=1e-9)


def test_nystroem_with_all_points_is_the_kernel(spark):
    points = np.array([[0.0, 0.0], [1.0, 0.5], [2.0, -1.0]])
    df = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(
        spark.createDataFrame([(*p, k) for k, p in enumerate(points.tolist())], "a double, b double, k int"))
    got = np.stack([r["z"].toArray() for r in nystroem_features(df, "f", points, 0.3, "z").orderBy("k").collect()])
    apart = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    assert got @ got.T == pytest.approx(np.exp(-0.3 * apart))


def test_collection_predicts_saves_and_loads(table, tmp_path):
    models = default_models("PM25", trees=3, depth=4)
    collection = ModelCollection(INPUTS, "PM25", {n: models[n] for n in ("Linear Regression", "Bayesian Ridge", "Random Forest")})
    train, test = table.drop("features").filter(~F.col("is_test")), table.drop("features").filter("is_test")
    assert collection.fit_model("Linear Regression", train) > 0
    collection.fit(train)
    wide = collection.predict(test.select("l_orderkey", *INPUTS))
    assert wide.columns == ["l_orderkey", *INPUTS, "linear_regression", "bayesian_ridge", "random_forest"]
    before = {r["model"]: r["r2"] for r in collection.compute_scores(test).collect()}
    assert min(before.values()) > 0.5
    collection.save(str(tmp_path / "c"))
    after = {r["model"]: r["r2"] for r in ModelCollection.load(str(tmp_path / "c")).compute_scores(test).collect()}
    assert after == pytest.approx(before)
    assert collection.compute_scores_for_model("Random Forest", test).count() == 1


def test_stack_averages_the_best_and_uses_its_input(table):
    models = default_models("PM25", trees=3, depth=4)
    collection = ModelCollection(INPUTS, "PM25", {n: models[n] for n in ("Linear Regression", "Bayesian Ridge", "Elastic Net")})
    rows = table.drop("features")
    collection.fit(rows)
    stack = ModelStack(collection, collection.compute_scores(rows), "r2", 2).fit(rows)
    assert sorted(stack.collection.models) == ["Bayesian Ridge", "Linear Regression"]
    one = rows.limit(1)
    both = collection.predict(stack.predict(one)).first()
    assert both["stacked"] == pytest.approx((both["linear_regression"] + both["bayesian_ridge"]) / 2)


def test_cross_validation_scores_held_out_rows(table, tmp_path):
    models = default_models("PM25")
    collection = ModelCollection(INPUTS, "PM25", {n: models[n] for n in ("Linear Regression", "Bayesian Ridge")})
    scores = collection.cross_validate(table.drop("features"), "fold", 3, parallel=2)
    got = {(r["model"], r["fold"]): r for r in scores.collect()}
    assert len(got) == 6 and all(r["fit_time"] > 0 and r["neg_rmse"] < 0 for r in got.values())
    pdf = table.select(*INPUTS, "PM25", "fold").toPandas()
    for f in range(3):
        a, b = pdf[pdf.fold != f], pdf[pdf.fold == f]
        w = np.linalg.lstsq(np.column_stack([np.ones(len(a)), a[INPUTS]]), a["PM25"], rcond=None)[0]
        error = b["PM25"] - np.column_stack([np.ones(len(b)), b[INPUTS]]) @ w
        want = 1 - (error**2).sum() / ((b["PM25"] - b["PM25"].mean()) ** 2).sum()
        assert got[("linear_regression", f)]["r2"] == pytest.approx(want, abs=1e-6)
        assert got[("linear_regression", f)]["n"] == len(b)
    collection.save_cross_val_scores(str(tmp_path / "s"))
    assert collection.load_cross_val_scores(str(tmp_path / "s")).count() == 6


def test_forward_selection_and_inclusion_from_gram_matrices(table):
    rows = table.drop("features")
    steps = selection.forward_selection(rows, [*INPUTS, "lat", "n_snapshots"], "PM25", "fold", 3).orderBy("step").collect()
    assert [r["added"] for r in steps[:2]] == ["blh", "AOD"] and len(steps) == 4
    assert summaries.added_features(table.sparkSession.createDataFrame(
        [(1, r["step"], r["features"]) for r in steps], "model int, step int, features array<string>")
    ).orderBy("step").first()["added"] == "blh"
    curve = selection.inclusion_curve(rows, ["blh", "AOD", "t2m"], "PM25", "fold", 3)
    means = [r["r2"] for r in curve.groupBy("n_features").agg(F.avg("r2").alias("r2")).orderBy("n_features").collect()]
    assert means[0] == pytest.approx(steps[0]["r2"]) and means[1] == pytest.approx(steps[1]["r2"])


def test_learning_curve_parts_are_exact(table):
    pipeline = default_models("PM25")["Linear Regression"]
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    curve = selection.learning_curve(pipeline, table.drop("features"), INPUTS, "PM25", "fold", 3, keys, [0.1, 1.0]).collect()
    counts = {r["fold"]: r["count"] for r in table.groupBy("fold").count().collect()}
    total = sum(counts.values())
    for r in curve:
        assert r["train_size"] in (round(0.1 * (total - counts[r["fold"]])), total - counts[r["fold"]])
        assert r["test_r2"] > 0.5


def test_grid_search_leaves_out_invalid_points(table):
    models = default_models("PM25")
    collection = ModelCollection(INPUTS, "PM25", {"Gradient Boost": models["Gradient Boost"], "Linear Regression": models["Linear Regression"]})
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        found = collection.tune(table.drop("features"), "fold", {"Gradient Boost": {"stepSize": [0.0, 0.3], "maxIter": [2, 5]}})
    assert any("above zero" in str(w.message) for w in caught)
    assert len(found["Gradient Boost"]["metrics"]) == 2 and "Linear Regression" not in found
    collection.update_models()
    assert collection.models["Gradient Boost"].getStages()[-1].getMaxIter() == 5


def test_importances_and_tree_text(table, spark):
    models = default_models("PM25", trees=3, depth=4)
    for name in ("Random Forest", "Extra Trees"):
        model = models[name].fit(table)
        got = {r["feature"]: r["importance"] for r in feature_importances(model, INPUTS, spark).collect()}
        assert sum(got.values()) == pytest.approx(1.0) and got["t2m"] < got["blh"]
    lines = tree_lines(models["Random Forest"].fit(table), spark)
    assert lines.count() >= 3 and lines.filter("level > 3").count() == 0


def test_layouts_and_names():
    layouts = mlp_layouts("PM25")
    assert len(layouts) == 6 and column_name("Random Forest") == "random_forest"


def test_scoring_keeps_incomplete_cells(table, spark):
    collection = ModelCollection(["AOD", "month_1"], "PM25", {"Linear Regression": default_models("PM25")["Linear Regression"]})
    collection.fit(features.one_hot_month(table.drop("features")))
    grid = spark.sql("SELECT date'2024-01-01' AS time, 0 AS y, 0 AS x, 0.05D AS AOD UNION ALL SELECT date'2024-01-01', 0, 1, NULL")
    got = {r["x"]: r["linear_regression"] for r in scoring.score_grid(grid, ["AOD", "month_1"], collection.predict).collect()}
    assert got[0] is not None and got[1] is None


def test_ensembles_combine_their_members(table):
    model = AdaBoost(labelCol="PM25", numTrees=3).fit(table)
    assert isinstance(model, AdaBoostModel)
    scored, names = model.member_predictions(table.limit(20))
    says = model.getOrDefault(model.memberWeights)
    scored = scored.withColumnsRenamed({n: f"member_{k}" for k, n in enumerate(names)})
    names = [f"member_{k}" for k in range(len(names))]
    for r in model.transform(scored).collect():
        pairs, upto = sorted(zip([r[n] for n in names], says)), 0.0
        for p, s in pairs:
            upto += s
            if upto >= 0.5 * sum(says):
                assert r["prediction"] == pytest.approx(p)
                break
    assert isinstance(ExtraTrees(labelCol="PM25", numTrees=2, maxDepth=3).fit(table), ExtraTreesModel)
