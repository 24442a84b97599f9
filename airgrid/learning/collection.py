"""A named family of regressors trained, scored and applied together."""

from __future__ import annotations

import json
import time
import warnings
from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.learning.base import feature_means, moments
from airgrid.learning.kernel import KernelSVR
from airgrid.learning.linear import BayesianRidge
from airgrid.learning.network import Perceptron
from airgrid.learning.trees import AdaBoost, BoostedTrees, ExtraTrees, RandomForest
from airgrid.operators import summaries

FEATURES = "features"


def column_name(model: str) -> str:
    """Prediction column of a model: its name in small letters and underscores."""
    return model.lower().replace(" ", "_").replace("-", "_")


def default_models(label: str, trees: int = 100, depth: int = 30) -> dict[str, Pipeline]:
    """The regressors by name; ``trees`` and ``depth`` size the averaged ensembles."""

    def common(name: str) -> dict[str, str]:
        return {"featuresCol": FEATURES, "labelCol": label, "predictionCol": column_name(name)}

    def one(name: str, make: Callable[..., Estimator], **params) -> Pipeline:
        return Pipeline(stages=[make(**common(name), **params)])

    squares = PolynomialExpansion(degree=2, inputCol=FEATURES, outputCol="squares")
    return {
        "Linear Regression": one("Linear Regression", LinearRegression, solver="normal"),
        "Elastic Net": one("Elastic Net", LinearRegression, regParam=1.0, elasticNetParam=0.5, standardization=False),
        "Polynomial": Pipeline(stages=[squares, LinearRegression(
            featuresCol="squares", labelCol=label, predictionCol=column_name("Polynomial"), solver="normal")]),
        "Bayesian Ridge": one("Bayesian Ridge", BayesianRidge),
        "SVR": one("SVR", KernelSVR),
        "MLP": one("MLP", Perceptron),
        "Ada Boost": one("Ada Boost", AdaBoost),
        "Random Forest": one("Random Forest", RandomForest, numTrees=trees, maxDepth=depth),
        "Extra Trees": one("Extra Trees", ExtraTrees, numTrees=trees, maxDepth=depth),
        "Gradient Boost": one("Gradient Boost", BoostedTrees, maxIter=100, stepSize=0.1, maxDepth=3),
        "XGBoost": one("XGBoost", BoostedTrees, maxIter=100, stepSize=0.3, maxDepth=6, rowShare=0.9, columnShare=0.5, l2=1.0),
    }


# Hidden layers of the six network layouts, and the grids searched by default.
MLP_LAYOUTS = {"MLP0": [100], "MLP1": [10, 10, 10], "MLP2": [10, 20, 10], "MLP3": [100, 100, 100],
               "MLP4": [100, 50, 50, 50, 50], "MLP5": [100, 50, 50, 50, 50, 100]}
DEFAULT_GRIDS = {
    "Elastic Net": {"regParam": [round(0.05 * k, 2) for k in range(1, 21)],
                    "elasticNetParam": [round(0.01 * k, 2) for k in range(100)]},
    "Bayesian Ridge": {p: [1e-6, 1e-5, 1e-4] for p in ("alpha_1", "alpha_2", "lambda_1", "lambda_2")},
    "SVR": {"gamma": [10.0 ** (-3 + 6 * k / 9) for k in range(10)], "landmarks": [100, 200, 300], "C": [10.0 ** (-3 + 6 * k / 9) for k in range(10)]},
    "MLP": {"hidden": [[10], [50], [100], [100, 50, 10], [10, 100, 50], [10, 50, 100]]},
    "Ada Boost": {"numTrees": [100, 500, 1000], "learningRate": [round(0.1 * k, 1) for k in range(11)]},
    "Random Forest": {"numTrees": [100, 200, 300], "minSplit": [1, 2, 3, 4], "minInstancesPerNode": [1, 2, 3, 4],
                      "featuresPerSplit": [1, 2, 3, 4], "maxDepth": [10, 20, 30]},
    "Extra Trees": {"numTrees": [100, 200, 300], "minSplit": [1, 2, 3, 4], "minInstancesPerNode": [1, 2, 3, 4],
                    "featuresPerSplit": [1, 2, 3, 4], "maxDepth": [10, 20, 30]},
    "Gradient Boost": {"stepSize": [round(0.1 * k, 1) for k in range(11)], "maxIter": [100, 500, 1000],
                       "minSplit": [2, 3, 4], "minInstancesPerNode": [1, 2, 3]},
    "XGBoost": {"stepSize": [round(0.1 * k, 1) for k in range(11)], "maxIter": [100, 500, 1000]},
}


def mlp_layouts(label: str) -> dict[str, Pipeline]:
    return {name: Pipeline(stages=[Perceptron(featuresCol=FEATURES, labelCol=label, predictionCol=column_name(name),
                                              hidden=hidden)]) for name, hidden in MLP_LAYOUTS.items()}


def stacked(columns: Sequence[str]) -> Column:
    """Mean of several prediction columns."""
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns]) / len(columns)


class ModelCollection:
    """Regressors over one assembled feature vector.

    ``models`` maps names to pipelines that read ``features`` and write a column
    named after the model; entries can be replaced or added.
    """

    def __init__(self, inputs: Sequence[str], label: str, models: dict[str, Pipeline] | None = None) -> None:
        self.inputs = list(inputs)
        self.label = label
        self.models = dict(models) if models is not None else default_models(label)
        self.fitted: dict[str, PipelineModel] = {}
        self.fit_seconds: dict[str, float] = {}
        self.cross_val_scores: DataFrame | None = None
        self.hyperparameters: dict[str, dict] = {}
        self._assembler = VectorAssembler(inputCols=self.inputs, outputCol=FEATURES)

    def assemble(self, df: DataFrame) -> DataFrame:
        return self._assembler.transform(df)

    def training_table(self, df: DataFrame, *keep: str) -> DataFrame:
        return self.assemble(df).select(FEATURES, F.col(self.label).cast("double").alias(self.label), *keep)

    def fit_model(self, name: str, df: DataFrame) -> float:
        """Fit one model; the seconds it took."""
        start = time.perf_counter()
        self.fitted[name] = self.models[name].fit(self.training_table(df))
        self.fit_seconds[name] = time.perf_counter() - start
        return self.fit_seconds[name]

    def fit(self, df: DataFrame) -> ModelCollection:
        """Fit every model on the same rows, read once."""
        rows = self.training_table(df).persist()
        try:
            for name, pipeline in self.models.items():
                start = time.perf_counter()
                self.fitted[name] = pipeline.fit(rows)
                self.fit_seconds[name] = time.perf_counter() - start
        finally:
            rows.unpersist()
        return self

    def predict(self, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """The table with one prediction column per model, all in one plan."""
        keep, out = df.columns, self.assemble(df)
        added: list[str] = []
        for name in names or list(self.fitted):
            added.append(column_name(name))
            out = self.fitted[name].transform(out).select(*keep, FEATURES, *added)
        return out.drop(FEATURES)

    def predict_model(self, name: str, df: DataFrame) -> DataFrame:
        return self.predict(df, [name])

    def compute_scores(self, df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """R2, MAE and RMSE of every model on the given rows."""
        names = list(names or self.fitted)
        return summaries.regression_scores(self.predict(df, names), self.label, [column_name(n) for n in names])

    def compute_scores_for_model(self, name: str, df: DataFrame) -> DataFrame:
        return self.compute_scores(df, [name])

    def cross_validate(self, df: DataFrame, fold: str, n_folds: int, parallel: int = 1) -> DataFrame:
        """Scores of every model on every fold, from models fitted on the other folds."""
        from airgrid.learning.selection import cross_val_scores

        self.cross_val_scores = cross_val_scores(self, df, fold, n_folds, parallel)
        return self.cross_val_scores

    def tune(self, df: DataFrame, fold: str, grids: dict[str, dict[str, list]] | None = None,
             parallel: int = 4) -> dict[str, dict]:
        """Best parameters per model by R2 over the folds; given grids take the place of the default ones.

        Grid points that make no model are left out with a warning.  The elastic net and Bayesian ridge take all their points
        from one Gram matrix per fold; tree ensembles grow all folds together and read every point off the trees it shares.
        """
        from airgrid.learning.selection import grid_r2, takes_grams

        rows = self.training_table(df, F.col(fold).cast("int").alias("_fold")).persist()
        n_folds = (rows.agg(F.max("_fold")).first()[0] or 0) + 1
        grams = None
        try:
            for name, grid in {**DEFAULT_GRIDS, **(grids or {})}.items():
                if not grid or name not in self.models:
                    continue
                pipeline = self.models[name]
                last = pipeline.getStages()[-1]
                builder = ParamGridBuilder()
                for param, values in grid.items():
                    builder = builder.addGrid(last.getParam(param), _accepted(name, param, values))
                points = builder.build()
                if takes_grams(pipeline, list(grid)):
                    if grams is None:
                        arrays = rows.select(vector_to_array(FEATURES).alias("x"), F.col(self.label).alias("y"), F.col("_fold").alias("fold"))
                        center = feature_means(arrays)
                        grams = moments(arrays, len(center), center, "fold", n_folds)
                    metrics = grid_r2(last, points, grams)
                elif shares_growth(pipeline):
                    scores = last.staged_scores(rows, "_fold", n_folds, [{p.name: v for p, v in point.items()} for point in points])
                    means = {r["point"]: r["r2"] for r in scores.groupBy("point").agg(F.avg("r2").alias("r2")).collect()}
                    metrics = [means[k] for k in range(len(points))]
                else:
                    evaluator = RegressionEvaluator(labelCol=self.label, predictionCol=column_name(name), metricName="r2")
                    metrics = points_r2(pipeline, points, evaluator, rows, n_folds, parallel)
                best = points[max(range(len(points)), key=metrics.__getitem__)]
                self.hyperparameters[name] = {"metrics": metrics, "best": best, "grid": points}
        finally:
            rows.unpersist()
        return self.hyperparameters

    def update_models(self) -> None:
        """Put the best parameters found into the models."""
        for name, found in self.hyperparameters.items():
            stages = list(self.models[name].getStages())
            stages[-1] = stages[-1].copy(found["best"])
            self.models[name] = Pipeline(stages=stages)

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        for name, model in self.fitted.items():
            model.write().overwrite().save(f"{path}/{column_name(name)}")
        about = {"inputs": self.inputs, "label": self.label, "names": list(self.fitted), "seconds": self.fit_seconds}
        spark.createDataFrame([(json.dumps(about),)], "value string").write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> ModelCollection:
        spark = SparkSession.getActiveSession()
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        out = cls(about["inputs"], about["label"])
        out.fitted = {n: PipelineModel.load(f"{path}/{column_name(n)}") for n in about["names"]}
        out.fit_seconds = about["seconds"]
        return out

    def save_cross_val_scores(self, path: str) -> None:
        self.cross_val_scores.write.mode("overwrite").parquet(path)

    def load_cross_val_scores(self, path: str) -> DataFrame:
        self.cross_val_scores = SparkSession.getActiveSession().read.parquet(path)
        return self.cross_val_scores


def shares_growth(pipeline: Pipeline) -> bool:
    """Whether a model scores many folds and grid points from one growth."""
    return len(pipeline.getStages()) == 1 and hasattr(pipeline.getStages()[-1], "staged_scores")


def points_r2(pipeline: Pipeline, points: Sequence[dict], evaluator: RegressionEvaluator, rows: DataFrame, n_folds: int, parallel: int) -> list[float]:
    """Mean R2 over the folds, a fit for each point and fold."""

    def score(task: tuple[int, dict]) -> float:
        fold, point = task
        model = pipeline.fit(rows.filter(F.col("_fold") != fold), point)
        return evaluator.evaluate(model.transform(rows.filter(F.col("_fold") == fold)))

    with ThreadPool(parallel) as pool:
        found = pool.map(inheritable_thread_target(rows.sparkSession)(score), [(f, p) for p in points for f in range(n_folds)])
    return [float(np.mean(found[k * n_folds:(k + 1) * n_folds])) for k in range(len(points))]


def _accepted(model: str, param: str, values: Sequence) -> list:
    good = [v for v in values if not (param in ("stepSize", "learningRate") and v <= 0)]
    if len(good) < len(values):
        warnings.warn(f"{model}: {param} must be above zero, other values are left out", stacklevel=3)
    return good


class ModelStack:
    """The mean prediction of the best few models of a collection."""

    def __init__(self, collection: ModelCollection, scores: DataFrame, criterion: str = "rmse", n: int = 3) -> None:
        """``scores`` has one row per model, named as its prediction column."""
        best = {r["model"] for r in summaries.top_models(scores, criterion, n).collect()}  # n names
        names = [m for m in collection.models if column_name(m) in best]
        self.collection = ModelCollection(collection.inputs, collection.label, {m: collection.models[m] for m in names})

    def fit(self, df: DataFrame) -> ModelStack:
        self.collection.fit(df)
        return self

    def predict(self, df: DataFrame, name: str = "stacked") -> DataFrame:
        columns = [column_name(m) for m in self.collection.models]
        return self.collection.predict(df).withColumn(name, stacked(columns)).drop(*columns)

    def compute_scores(self, df: DataFrame, name: str = "stacked") -> DataFrame:
        return summaries.regression_scores(self.predict(df, name), self.collection.label, [name])


def scaled(inputs: str, output: str) -> StandardScaler:
    """Scaling stage for estimators that do not scale themselves."""
    return StandardScaler(inputCol=inputs, outputCol=output, withMean=True, withStd=True)


def feature_importances(model: PipelineModel, inputs: Sequence[str], spark: SparkSession) -> DataFrame:
    """Impurity importance of every input of a fitted tree ensemble."""
    last = model.stages[-1]
    values = last.importances()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(inputs, values)], "feature string, importance double")


def tree_lines(model: PipelineModel, spark: SparkSession, tree: int = 0, depth: int = 2) -> DataFrame:
    """The upper levels of one tree as numbered lines of text."""
    last = model.stages[-1]
    return spark.createDataFrame(last.tree_lines(tree, depth), "line int, level int, text string")
