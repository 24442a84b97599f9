"""Registered learning queries do the whole job of the operators behind them."""

import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

import __spark_entry__ as entry
from airgrid.learning import selection
from airgrid.learning.collection import ModelCollection, default_models
from airgrid.plans.learning_queries import INPUTS, LABEL
from conftest import SF_DIR

FITTED = {"ml_svr": "SVR", "ml_mlp": "MLP", "ml_ada_boost": "Ada Boost", "ml_random_forest": "Random Forest", "ml_extra_trees": "Extra Trees",
          "ml_gradient_boost": "Gradient Boost", "ml_xgboost": "XGBoost", "model_predictions": "Random Forest", "model_stack": "Random Forest",
          "feature_importance": "Random Forest", "tree_inspection": "Random Forest"}


class Seen(Exception):
    pass


def settings(pipeline):
    last = pipeline.getStages()[-1]
    return {p.name: v for p, v in last.extractParamMap().items()}


@pytest.mark.parametrize("query", sorted(FITTED))
def test_queries_fit_the_models_of_the_collection(query, spark, monkeypatch):
    def fit(self, df):
        raise Seen(self.models)

    monkeypatch.setattr(ModelCollection, "fit", fit)
    with pytest.raises(Seen) as seen:
        entry.queries()[query](spark, SF_DIR)
    models, name = seen.value.args[0], FITTED[query]
    assert settings(models[name]) == settings(default_models(LABEL)[name])


SEVEN = {"Linear Regression", "Polynomial", "Bayesian Ridge", "MLP", "Random Forest", "Extra Trees", "XGBoost"}


def test_searches_and_curves_are_whole(spark, monkeypatch):
    def stop(*args, **kwargs):
        raise Seen(*args, kwargs)

    monkeypatch.setattr(ModelCollection, "fit", stop)
    monkeypatch.setattr(ModelCollection, "cross_validate", stop)
    monkeypatch.setattr(ModelCollection, "tune", stop)
    monkeypatch.setattr(selection, "learning_curve", stop)

    def asked(query):
        with pytest.raises(Seen) as seen:
            entry.queries()[query](spark, SF_DIR)
        return seen.value.args

    collection, folds, _, n_folds, _ = asked("cross_val_scores")
    assert set(collection.models) == SEVEN and n_folds == 10 and folds.select("fold").distinct().count() == 10
    collection, folds, *grids = asked("grid_search")
    assert set(collection.models) == set(default_models(LABEL)) and grids == ["fold", {}] and folds.agg(F.max("fold")).first()[0] == 9
    *_, n_folds, _, shares, _ = asked("learning_curve")
    assert n_folds == 5 and shares == pytest.approx([0.05 * k for k in range(1, 21)])
    assert set(asked("grid_scoring")[0].models) == SEVEN


@pytest.mark.parametrize("name, grid", [("Elastic Net", {"regParam": [0.05, 1.0], "elasticNetParam": [0.0, 0.5, 0.99]}),
                                        ("Bayesian Ridge", {"alpha_1": [1e-6, 1e-4], "lambda_2": [1e-6]})])
def test_grid_points_from_gram_matrices_score_as_fits_do(name, grid, tables, monkeypatch):
    models = default_models(LABEL)
    collection = ModelCollection(INPUTS, LABEL, {name: models[name]})
    rows = tables.features.withColumn("fold", F.pmod(F.xxhash64("l_orderkey"), F.lit(3)).cast("int"))
    with monkeypatch.context() as patch:
        patch.setattr(CrossValidator, "fit", lambda *_: pytest.fail("fitted point by point"))
        got = collection.tune(rows, "fold", {name: grid})[name]
    search = CrossValidator(estimator=models[name], estimatorParamMaps=got["grid"], numFolds=3, foldCol="_fold", evaluator=RegressionEvaluator(
        labelCol=LABEL, predictionCol=name.lower().replace(" ", "_"), metricName="r2"))
    want = search.fit(collection.training_table(rows, F.col("fold").alias("_fold"))).avgMetrics
    assert got["metrics"] == pytest.approx(want, abs=1e-5)


def test_curve_points_from_gram_matrices_score_as_fits_do(tables, monkeypatch):
    rows = tables.features.withColumn("fold", F.pmod(F.xxhash64("l_orderkey"), F.lit(2)).cast("int"))
    ask = (default_models(LABEL)["Linear Regression"], rows, INPUTS, LABEL, "fold", 2, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], [0.3, 0.05, 0.3])
    got = selection.learning_curve(*ask).collect()
    monkeypatch.setattr(selection, "plain_least_squares", lambda _: False)
    want = selection.learning_curve(*ask).collect()
    assert len(got) == 6 and [tuple(r) for r in got] == [pytest.approx(tuple(r), abs=1e-6) for r in want]


def test_default_models_are_not_cut_below_the_reference(spark):
    models = {n: settings(p) for n, p in default_models(LABEL).items()}
    assert models["Random Forest"]["maxDepth"] == models["Extra Trees"]["maxDepth"] == 30
    assert models["MLP"]["maxIter"] == 50_000 and models["MLP"]["patience"] == 10
