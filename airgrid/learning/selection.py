"""Cross-validation, learning curves and feature selection."""

from __future__ import annotations

import time
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import TYPE_CHECKING

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.learning.base import feature_means, moments
from airgrid.learning.linear import BayesianRidge, centred, elastic_net_weights, evidence_ridge
from airgrid.operators import summaries
from airgrid.operators.ranking import with_running_totals
from airgrid.session import materialise, scratch_path

if TYPE_CHECKING:
    from airgrid.learning.collection import ModelCollection


def _fold_scores(scores: DataFrame) -> DataFrame:
    return scores.select("model", "fold", "r2", (-F.col("mae")).alias("neg_mae"), (-F.col("rmse")).alias("neg_rmse"), "n")


def cross_val_scores(collection: ModelCollection, df: DataFrame, fold: str, n_folds: int, parallel: int = 1) -> DataFrame:
    """(model, fold, r2, neg_mae, neg_rmse, n, fit_time) for every model and fold.

    Tree ensembles grow all folds together.  Fits of the others are Spark jobs,
    ``parallel`` of them submitted at a time; their predictions meet in one wide
    table that is scored in one aggregate.  Rows without a fold are learned from
    by the tree ensembles only, and scored by none.
    """
    from airgrid.learning.collection import column_name, shares_growth

    rows = collection.training_table(df, F.col(fold).cast("int").alias("fold")).persist()
    together = [n for n in collection.models if shares_growth(collection.models[n])]
    alone = [n for n in collection.models if n not in together]
    results, times = [], []

    def fit(task: tuple[str, int]):
        name, f = task
        start = time.perf_counter()
        model = collection.models[name].fit(rows.filter(F.col("fold") != f))
        return name, f, model, time.perf_counter() - start

    try:
        for name in together:  # all folds in one growth, each with its share of the time
            start = time.perf_counter()
            found = materialise(collection.models[name].getStages()[-1].staged_scores(rows, "fold", n_folds, [{}]))
            results.append(_fold_scores(found.withColumn("model", F.lit(column_name(name)))))
            times += [(column_name(name), f, (time.perf_counter() - start) / n_folds) for f in range(n_folds)]
        if alone:
            with ThreadPool(parallel) as pool:
                fits = pool.map(inheritable_thread_target(df.sparkSession)(fit), [(name, f) for f in range(n_folds) for name in alone])
            parts = []
            for f in range(n_folds):
                part, added = rows.filter(F.col("fold") == f), []
                for name, g, model, _ in fits:
                    if g == f:
                        added.append(column_name(name))
                        part = model.transform(part).select("features", collection.label, "fold", *added)
                parts.append(part.drop("features"))
            wide = reduce(DataFrame.unionByName, parts)
            results.append(materialise(_fold_scores(summaries.regression_scores(wide, collection.label, [column_name(n) for n in alone], by=["fold"]))))
            times += [(column_name(n), f, s) for n, f, _, s in fits]
    finally:
        rows.unpersist()
    seconds = df.sparkSession.createDataFrame(times, "model string, fold int, fit_time double")
    return reduce(DataFrame.unionByName, results).join(seconds, ["model", "fold"])


def learning_curve(pipeline: Pipeline, df: DataFrame, inputs: Sequence[str], label: str, fold: str, n_folds: int,
                   keys: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(fold, train_size, train_r2, test_r2): models fitted on growing parts of the other folds.

    The rows are put in one hashed order, and a training part is the exact
    leading share of it, so larger parts contain the smaller ones.  Plain least squares takes all parts of a fold from
    the Gram matrices of the stretches between them.
    """
    table = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(df)
    ordered = table.select("features", label, F.col(fold).cast("int").alias("fold"), *keys,
                           F.xxhash64(*keys).alias("_hash"))
    # position of a row among the training rows of each fold, all folds in one pass
    places = {f"_rank{f}": F.when(F.col("fold") != f, 1).otherwise(0) for f in range(n_folds)} | {"_place": F.lit(1)}
    path = scratch_path(df.sparkSession, "ranked")  # as Parquet, a third of a checkpoint
    with_running_totals(ordered, ["_hash", *keys], places).write.parquet(path)
    ranked = df.sparkSession.read.parquet(path)
    sizes = ranked.agg(*[F.max(c).alias(c) for c in places]).first()
    prediction = pipeline.getStages()[-1].getPredictionCol()
    results = []
    if len(pipeline.getStages()) == 1 and hasattr(pipeline.getStages()[-1], "curve"):
        return grown_curve(pipeline.getStages()[-1], ranked, n_folds, [[max(1, int(round(s * sizes[f"_rank{f}"]))) for s in shares] for f in range(n_folds)])
    plain = plain_least_squares(pipeline)
    if plain:
        arrays = ranked.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), "fold", *places)
        center = feature_means(arrays)
    for f in range(n_folds):
        if plain:
            parts = [max(1, int(round(share * sizes[f"_rank{f}"]))) for share in shares]
            ends = sorted(set(parts))
            stretch = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e < F.col(f"_rank{f}")))
            cut = arrays.withColumn("stretch", F.when(F.col("fold") == f, len(ends) + 1).otherwise(stretch))
            grams = moments(cut, len(center), center, "stretch", len(ends) + 2)
            upto = dict(zip(ends, np.cumsum(grams, axis=0)))
            for size in parts:
                n, means, xx, xy, _, label_mean = centred(upto[size])
                weights = np.linalg.lstsq(xx, xy, rcond=None)[0]
                line = weights, label_mean - means @ weights
                scores = [form_r2(gram, *line) for gram in (upto[size], grams[-1])]
                results.append((f, size, *[r if np.isfinite(r) else None for r in scores]))
            continue
        for share in shares:
            size = max(1, int(round(share * sizes[f"_rank{f}"])))
            part = ranked.filter((F.col("fold") != f) & (F.col(f"_rank{f}") <= size))
            model = pipeline.fit(part.select("features", label))
            scored = model.transform(ranked.filter((F.col("fold") == f) | (F.col(f"_rank{f}") <= size))
                                     .select("features", label, (F.col("fold") == f).alias("held_out")))
            scores = {r["held_out"]: r["r2"] for r in
                      summaries.regression_scores(scored, label, [prediction], by=["held_out"]).collect()}  # two rows
            results.append((f, size, scores[False], scores[True]))
    return df.sparkSession.createDataFrame(results, "fold int, train_size int, train_r2 double, test_r2 double")


def grown_curve(last, ranked: DataFrame, n_folds: int, sizes: Sequence[Sequence[int]]) -> DataFrame:
    """The curve of an estimator that grows all its points in one pass; ``ranked`` has ``_place``, in one order, and ``_rank`` per fold."""
    tasks, about = [], []
    for f in range(n_folds):
        ends = ranked.filter((F.col("fold") != f) & F.col(f"_rank{f}").isin(sorted(set(sizes[f])))).select(f"_rank{f}", "_place").collect()  # a row a size
        last_place = {r[0]: r["_place"] for r in ends}
        for size in sizes[f]:
            about.append((len(tasks), f, size))
            tasks.append((f, last_place[size]))
    scores = last.curve(ranked, "fold", "_place", tasks)
    wide = scores.groupBy("task").agg(F.max(F.when(~F.col("held"), F.col("r2"))).alias("train_r2"), F.max(F.when(F.col("held"), F.col("r2"))).alias("test_r2"))
    points = ranked.sparkSession.createDataFrame(about, "task int, fold int, train_size int")
    return points.join(wide, "task").select("fold", "train_size", "train_r2", "test_r2")


def plain_least_squares(pipeline: Pipeline) -> bool:
    last = pipeline.getStages()[-1]
    return (len(pipeline.getStages()) == 1 and isinstance(last, LinearRegression) and not last.getRegParam() and last.getFitIntercept()
            and last.getLoss() == "squaredError" and not last.isDefined("weightCol"))


def fold_moments(df: DataFrame, inputs: Sequence[str], label: str, fold: str, n_folds: int) -> np.ndarray:
    """Gram matrices per fold around the overall means: one pass for every linear model to come."""
    rows = df.select(F.array(*[F.col(c).cast("double") for c in inputs]).alias("x"),
                     F.col(label).cast("double").alias("y"), F.col(fold).cast("int").alias("fold"))
    return moments(rows, len(inputs), feature_means(rows), "fold", n_folds)


def form_r2(gram: np.ndarray, weights: np.ndarray, intercept: float) -> float:
    """R2 of a linear form on the rows of one Gram matrix of [1, x, y]."""
    form = np.concatenate([[-intercept], -weights, [1.0]])  # residual as a linear form in [1, x, y]
    return float(1.0 - form @ gram @ form / (gram[-1, -1] - gram[0, -1] ** 2 / gram[0, 0]))


def takes_grams(pipeline: Pipeline, names: Sequence[str]) -> bool:
    """Whether a model can be searched over these parameters from Gram matrices alone."""
    if len(pipeline.getStages()) > 1:
        return False
    last = pipeline.getStages()[-1]
    if isinstance(last, BayesianRidge):
        return set(names) <= {"alpha_1", "alpha_2", "lambda_1", "lambda_2", "maxIter", "tol"}
    return (isinstance(last, LinearRegression) and not last.getStandardization() and last.getFitIntercept() and last.getLoss() == "squaredError"
            and not last.isDefined("weightCol") and set(names) <= {"regParam", "elasticNetParam"})


def grid_r2(last: LinearRegression | BayesianRidge, points: Sequence[dict], grams: np.ndarray) -> list[float]:
    """Mean held-out R2 over the folds at every grid point, without reading the data again."""
    if empty := [f for f, gram in enumerate(grams) if not gram[0, 0]]:
        raise ValueError(f"folds without rows: {empty}")
    total, scores = grams.sum(axis=0), np.zeros((len(points), len(grams)))
    for f, gram in enumerate(grams):
        n, means, xx, xy, yy, label_mean = centred(total - gram)
        weights = None
        for k, point in enumerate(points):
            at = {p.name: v for p, v in last.extractParamMap(point).items()}
            if isinstance(last, BayesianRidge):
                priors = (at["alpha_1"], at["alpha_2"], at["lambda_1"], at["lambda_2"])
                weights, _, _ = evidence_ridge(xx, xy, yy, n, priors, at["maxIter"], at["tol"])
            else:
                weights = elastic_net_weights(xx, xy, yy, n, at["regParam"], at["elasticNetParam"], weights)
            scores[k, f] = form_r2(gram, weights, label_mean - means @ weights)
    return scores.mean(axis=1).tolist()


def subset_r2(grams: np.ndarray, chosen: Sequence[int]) -> list[float]:
    """Held-out R2 per fold of the least-squares model on some of the inputs, from the Gram matrices alone."""
    total, scores = grams.sum(axis=0), []
    picked = np.array(chosen)
    for gram in grams:
        n, means, xx, xy, _, label_mean = centred(total - gram)
        w = np.linalg.lstsq(xx[np.ix_(picked, picked)], xy[picked], rcond=None)[0]
        form = np.zeros(len(gram))  # residual as a linear form in [1, x, y]
        form[0] = -(label_mean - means[picked] @ w)
        form[1 + picked] = -w
        form[-1] = 1.0
        sse = form @ gram @ form
        scores.append(1.0 - sse / (gram[-1, -1] - gram[0, -1] ** 2 / gram[0, 0]))
    return scores


def forward_selection(df: DataFrame, inputs: Sequence[str], label: str, fold: str, n_folds: int,
                      upto: int | None = None) -> DataFrame:
    """(step, added, features, r2): the input that helps cross-validated R2 most, added one at a time."""
    grams = fold_moments(df, inputs, label, fold, n_folds)
    chosen: list[int] = []
    steps = []
    for step in range(1, (upto or len(inputs) - 1) + 1):
        candidates = [k for k in range(len(inputs)) if k not in chosen]
        best = max(candidates, key=lambda k: float(np.mean(subset_r2(grams, [*chosen, k]))))
        chosen.append(best)
        steps.append((step, inputs[best], [inputs[k] for k in chosen], float(np.mean(subset_r2(grams, chosen)))))
    return df.sparkSession.createDataFrame(steps, "step int, added string, features array<string>, r2 double")


def inclusion_curve(df: DataFrame, ranked_inputs: Sequence[str], label: str, fold: str, n_folds: int) -> DataFrame:
    """(n_features, fold, r2): linear models on the most important input, the two most important, and so on."""
    grams = fold_moments(df, ranked_inputs, label, fold, n_folds)
    rows = [(k, f, float(r)) for k in range(1, len(ranked_inputs) + 1)
            for f, r in enumerate(subset_r2(grams, list(range(k))))]
    return df.sparkSession.createDataFrame(rows, "n_features int, fold int, r2 double")
