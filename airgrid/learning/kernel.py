"""Support vector regression behind a Nystroem kernel map, for many folds and settings in the same passes.

Landmarks are the rows of least hash among those a model learns from.  A row's similarities to them, times the inverse root of
the landmarks' own kernel, approximate the radial-basis kernel.  All settings of one kernel width see the same similarities:
a pass works them out once per row and fold, and gives the subgradients of every number of landmarks and every C.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.learning.base import Supervised, feature_means, summed
from airgrid.learning.forest import matrix, scores_of_stages, training_rows
from airgrid.learning.network import LAST, statistics
from airgrid.session import materialise

FLATTEST = 1e-6  # directions of the mapped inputs below this share of the widest are not stretched further


def inverse_root(kernel: np.ndarray, least: float) -> np.ndarray:
    scales, basis = np.linalg.eigh(kernel)
    return (basis / np.sqrt(np.clip(scales, least, None))) @ basis.T


def similarities(z: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    square = (z**2).sum(axis=1)[:, None] - 2 * z @ landmarks.T + (landmarks**2).sum(axis=1)[None, :]
    return np.exp(-gamma * np.maximum(square, 0))


@dataclass(frozen=True)
class Part:
    """One model to fit: what it leaves out, and its settings."""

    fold: int
    landmarks: int
    C: float
    epsilon: float
    upto: int = LAST


@dataclass
class Fitted:
    """Weights on the similarities, and the offset, in units of the label's deviation."""

    landmarks: np.ndarray
    weights: np.ndarray
    offset: float


def chosen_landmarks(rows: DataFrame, fold: int, most: int) -> np.ndarray:
    """Up to ``most`` different inputs of the rows outside a fold, in hash order."""
    first = rows.filter(F.col("fold") != fold).orderBy(F.xxhash64("id"), "id").select("x").limit(8 * most).collect()  # a bounded sample
    x = np.array([r["x"] for r in first])
    _, kept = np.unique(x, axis=0, return_index=True)
    return x[np.sort(kept)[:most]]


def fit_parts(rows: DataFrame, parts: Sequence[Part], gamma: float, passes: int, stats: dict[int, np.ndarray], n_rows: dict[int, float],
              points: dict[int, np.ndarray]) -> list[Fitted]:
    """All parts of one kernel width: one pass for the spread of the mapped inputs, then ``passes`` for subgradients."""
    folds = sorted({p.fold for p in parts})
    scaled_points = {f: (points[f] - stats[f][0, :-1]) / stats[f][1, :-1] for f in folds}
    sizes = {f: len(scaled_points[f]) for f in folds}

    def led(pdf: pd.DataFrame, f: int) -> tuple[np.ndarray, np.ndarray]:
        mine = pdf["fold"].to_numpy() != f
        x, y = np.stack(pdf["x"].to_numpy())[mine], pdf["y"].to_numpy()[mine]
        z = (x - stats[f][0, :-1]) / stats[f][1, :-1]
        return similarities(z, scaled_points[f], gamma), (y - stats[f][0, -1]) / stats[f][1, -1]

    def spread(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        total = {f: np.zeros((sizes[f] + 1, sizes[f] + 1)) for f in folds}
        for pdf in batches:
            for f in folds if len(pdf) else []:
                k, _ = led(pdf, f)
                k = np.column_stack([k, np.ones(len(k))])
                total[f] += k.T @ k
        return np.concatenate([total[f].ravel() for f in folds])

    grams = dict(zip(folds, np.split(summed(rows, spread), np.cumsum([(sizes[f] + 1) ** 2 for f in folds])[:-1])))
    maps, stretch = {}, {}
    for p in parts:
        m = min(p.landmarks, sizes[p.fold])
        if (p.fold, m) in maps:
            continue
        own = inverse_root(similarities(scaled_points[p.fold][:m], scaled_points[p.fold][:m], gamma), 1e-12)
        gram = grams[p.fold].reshape(sizes[p.fold] + 1, -1)[:m, :m] / max(n_rows[p.fold], 1)
        widths, basis = np.linalg.eigh(own @ gram @ own)
        # steps are taken along the main directions of the mapped inputs, each stretched to about the same width
        stretch[p.fold, m] = 1.0 / np.sqrt(np.maximum(widths, FLATTEST * max(widths[-1], 1e-300)))
        maps[p.fold, m] = own @ basis * stretch[p.fold, m]
    at = [(p.fold, min(p.landmarks, sizes[p.fold])) for p in parts]
    state = [np.zeros(m + 1) for _, m in at]
    mean = [np.zeros(m + 1) for _, m in at]
    for step in range(passes):
        onto = [np.append(maps[a] @ w[:-1], w[-1]) for a, w in zip(at, state)]

        def pull(batches: Iterator[pd.DataFrame], onto=onto) -> np.ndarray:
            total = [np.zeros(sizes[p.fold] + 1) for p in parts]
            for pdf in batches:
                for f in folds if len(pdf) else []:
                    k, y = led(pdf, f)
                    mine = [n for n, p in enumerate(parts) if p.fold == f]
                    weights = np.zeros((sizes[f], len(mine)))
                    for c, n in enumerate(mine):
                        weights[:len(onto[n]) - 1, c] = onto[n][:-1]
                    error = k @ weights + np.array([onto[n][-1] for n in mine]) - y[:, None]
                    band = np.array([parts[n].epsilon for n in mine]) / stats[f][1, -1]
                    sign = np.sign(error) * (np.abs(error) > band)
                    gradient, offsets = k.T @ sign, sign.sum(axis=0)
                    for c, n in enumerate(mine):
                        total[n][:-1] += gradient[:, c]
                        total[n][-1] += offsets[c]
            return np.concatenate(total)

        pulls = np.split(summed(rows, pull), np.cumsum([sizes[p.fold] + 1 for p in parts])[:-1])
        for n, (p, a, g) in enumerate(zip(parts, at, pulls)):
            rows_of = max(n_rows[p.fold], 1)
            size = 1.0 / np.sqrt(1.0 + step)
            state[n] = state[n] - size * np.append(maps[a].T @ g[:a[1]], g[-1]) / rows_of
            state[n][:-1] /= 1.0 + size * stretch[a] ** 2 / (p.C * rows_of)  # the penalty's own step, taken in full
            if step >= passes // 2:
                mean[n] += state[n] / (passes - passes // 2)
    return [Fitted(points[f][:m], maps[f, m] @ w[:-1], float(w[-1])) for (f, m), w in zip(at, mean)]


class KernelFormModel(Model, Supervised, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ``KernelSVR``."""

    points = Param(Params._dummy(), "points", "landmarks, scaled, one after the other", TypeConverters.toListFloat)
    weights = Param(Params._dummy(), "weights", "weight of the similarity to each landmark", TypeConverters.toListFloat)
    offset = Param(Params._dummy(), "offset", "constant term", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    middle = Param(Params._dummy(), "middle", "input means", TypeConverters.toListFloat)
    scale = Param(Params._dummy(), "scale", "input deviations", TypeConverters.toListFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights, offset, gamma = np.array(self.getOrDefault(self.weights)), self.getOrDefault(self.offset), self.getOrDefault(self.gamma)
        middle, scale = np.array(self.getOrDefault(self.middle)), np.array(self.getOrDefault(self.scale))
        points = np.array(self.getOrDefault(self.points)).reshape(len(weights), -1)

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            if x.empty:
                return pd.Series([], dtype="float64")
            return pd.Series(similarities((np.stack(x.to_numpy()) - middle) / scale, points, gamma) @ weights + offset)

        return dataset.withColumn(self.getPredictionCol(), predict(vector_to_array(F.col(self.getFeaturesCol()))))


class KernelSVR(Estimator, Supervised, DefaultParamsReadable, DefaultParamsWritable):
    """Epsilon-insensitive linear regression on a Nystroem map of the standardised inputs.

    Averaged subgradient steps; a step is one pass.  A ``gamma`` of 0 stands for one over the number of inputs.
    """

    landmarks = Param(Params._dummy(), "landmarks", "rows that span the kernel map", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    C = Param(Params._dummy(), "C", "weight of the loss", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "half-width of the band without loss", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "number of passes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", landmarks=100, gamma=0.0, C=1.0, epsilon=0.0,
                 maxIter=60) -> None:
        super().__init__()
        self._setDefault(landmarks=100, gamma=0.0, C=1.0, epsilon=0.0, maxIter=60)
        self._set(**self._input_kwargs)

    def fitted(self, dataset: DataFrame, folds: Sequence[int], points: Sequence[dict], fold: str | None = None):
        """Rows, scales, and for each kernel width the (point, fold) it serves with their fits."""
        base = {p.name: v for p, v in self.extractParamMap().items()}
        full = [base | p for p in points]
        rows = training_rows(dataset, self.getFeaturesCol(), self.getLabelCol(), fold).persist(StorageLevel.MEMORY_AND_DISK)
        center = feature_means(rows)
        whole = [Part(f, 0, 1.0, 0.0) for f in folds]
        scales, sizes = statistics(rows, whole, center)
        stats, n_rows = dict(zip(folds, scales)), dict(zip(folds, sizes))
        marks = {f: chosen_landmarks(rows, f, max(p["landmarks"] for p in full)) for f in folds}
        found = []
        for gamma in sorted({p["gamma"] for p in full}):
            asked = [(k, f) for k, p in enumerate(full) if p["gamma"] == gamma for f in folds]
            parts = [Part(f, full[k]["landmarks"], full[k]["C"], full[k]["epsilon"]) for k, f in asked]
            width = gamma or 1.0 / len(center)
            found.append((width, asked, fit_parts(rows, parts, width, base["maxIter"], stats, n_rows, marks)))
        return rows, stats, found

    def _fit(self, dataset: DataFrame) -> KernelFormModel:
        rows, stats, found = self.fitted(dataset, [-1], [{}])
        rows.unpersist()
        gamma, _, (fit,) = found[0]
        (middle, scale), (label_mean, label_scale) = stats[-1][:, :-1], stats[-1][:, -1]
        model = self._copyValues(KernelFormModel())
        model._set(points=((fit.landmarks - middle) / scale).ravel().tolist(), weights=(fit.weights * label_scale).tolist(), gamma=float(gamma),
                   offset=float(fit.offset * label_scale + label_mean), middle=middle.tolist(), scale=scale.tolist())
        return model

    def staged_scores(self, dataset: DataFrame, fold: str, n_folds: int, points: Sequence[dict]) -> DataFrame:
        """(point, fold, r2, mae, rmse, n); every point of one kernel width and every fold go through the same passes."""
        rows, stats, found = self.fitted(dataset, list(range(n_folds)), points, fold)
        told = None
        for gamma, asked, fits in found:
            sent = dataset.sparkSession.sparkContext.broadcast((asked, fits))

            def run(batches: Iterator[pa.RecordBatch], sent=sent, gamma=gamma) -> Iterator[pa.RecordBatch]:
                where, fitted = sent.value
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    y, folds, x = batch.column("y").to_numpy(), batch.column("fold").to_numpy(), matrix(batch.column("x"))
                    for f in np.unique(folds[(folds >= 0) & (folds < n_folds)]):
                        mine = folds == f
                        z = (x[mine] - stats[f][0, :-1]) / stats[f][1, :-1]
                        most = max((fit.landmarks for (_, g), fit in zip(where, fitted) if g == f), key=len)
                        near = similarities(z, (most - stats[f][0, :-1]) / stats[f][1, :-1], gamma)
                        for (k, g), fit in zip(where, fitted):
                            if g == f:
                                p = (near[:, :len(fit.weights)] @ fit.weights + fit.offset) * stats[f][1, -1] + stats[f][0, -1]
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), k, np.int32)), pa.array(np.full(len(p), f, np.int32)), pa.array(y[mine]), pa.array(p)],
                                                                 ["point", "fold", "y", "p"])

            part = rows.select("y", "fold", "x").mapInArrow(run, "point int, fold int, y double, p double").withColumn("copies", F.lit(1))
            part = scores_of_stages(part, ["point", "fold"], ["p"]).drop("stage")
            told = part if told is None else told.unionByName(part)
        scored = materialise(told)
        rows.unpersist()
        return scored
