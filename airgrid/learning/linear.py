"""Linear regressors: Bayesian ridge and a support vector regressor."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.learning.base import LinearFormModel, Supervised, feature_means, moments, summed


def evidence_ridge(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, priors: tuple[float, float, float, float],
                   max_iter: int, tol: float) -> tuple[np.ndarray, float, float]:
    """Weights, noise precision and weight precision that maximise the evidence, from centred moments."""
    noise_shape, noise_rate, weight_shape, weight_rate = priors
    scales, basis = np.linalg.eigh(xx)
    scales = np.clip(scales, 0.0, None)
    projected = basis.T @ xy
    noise, precision = n / max(yy, np.finfo(float).tiny), 1.0
    weights = np.zeros(len(xy))
    for _ in range(max_iter):
        updated = basis @ (projected / (scales + precision / noise))
        sse = max(yy - 2 * updated @ xy + updated @ xx @ updated, np.finfo(float).tiny)
        effective = np.sum(noise * scales / (precision + noise * scales))
        precision = (effective + 2 * weight_shape) / (updated @ updated + 2 * weight_rate)
        noise = (n - effective + 2 * noise_shape) / (sse + 2 * noise_rate)
        moved = np.abs(updated - weights).sum()
        weights = updated
        if moved < tol:
            break
    weights = basis @ (projected / (scales + precision / noise))
    return weights, noise, precision


def centred(gram: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """n, feature means, centred XX, centred Xy, centred yy and label mean from a Gram matrix of [1, x, y]."""
    n = gram[0, 0]
    sums, label_sum = gram[0, 1:-1], gram[0, -1]
    xx = gram[1:-1, 1:-1] - np.outer(sums, sums) / n
    xy = gram[1:-1, -1] - sums * label_sum / n
    return int(round(n)), sums / n, xx, xy, gram[-1, -1] - label_sum**2 / n, label_sum / n


def elastic_net_weights(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, penalty: float, mix: float, start: np.ndarray | None = None,
                        max_iter: int = 100_000, tol: float = 1e-10) -> np.ndarray:
    """Weights of Spark's elastic net on inputs as they are, from centred moments, by coordinate descent.

    The squared penalty is taken relative to the label's deviation, as Spark does.
    """
    weights = np.zeros(len(xy)) if start is None else start.copy()
    deviation = np.sqrt(max(yy, 0.0) / max(n - 1, 1))
    if not deviation:
        return np.zeros(len(xy))
    xx, xy, l1, l2 = xx / n, xy / n, penalty * mix, penalty * (1.0 - mix) / deviation
    reach = np.sqrt(np.diag(xx))  # a step counts by what it moves the prediction
    for _ in range(max_iter):
        moved = 0.0
        for j in range(len(xy)):
            rest = xy[j] - xx[j] @ weights + xx[j, j] * weights[j]
            value = np.sign(rest) * max(abs(rest) - l1, 0.0) / (xx[j, j] + l2) if xx[j, j] else 0.0
            moved = max(moved, abs(value - weights[j]) * reach[j])
            weights[j] = value
        if moved <= tol * deviation:
            break
    return weights


class BayesianRidge(Estimator, Supervised, DefaultParamsReadable, DefaultParamsWritable):
    """Ridge regression whose penalty and noise come from the data (evidence maximisation).

    Two passes over the data: the means, and the Gram matrix around them.  The
    iteration works on that matrix alone.
    """

    alpha_1 = Param(Params._dummy(), "alpha_1", "shape of the noise prior", TypeConverters.toFloat)
    alpha_2 = Param(Params._dummy(), "alpha_2", "rate of the noise prior", TypeConverters.toFloat)
    lambda_1 = Param(Params._dummy(), "lambda_1", "shape of the weight prior", TypeConverters.toFloat)
    lambda_2 = Param(Params._dummy(), "lambda_2", "rate of the weight prior", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "most iterations", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "change of weights to stop at", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", alpha_1=1e-6,
                 alpha_2=1e-6, lambda_1=1e-6, lambda_2=1e-6, maxIter=300, tol=1e-3) -> None:
        super().__init__()
        self._setDefault(alpha_1=1e-6, alpha_2=1e-6, lambda_1=1e-6, lambda_2=1e-6, maxIter=300, tol=1e-3)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LinearFormModel:
        rows = self.training_rows(dataset)
        center = feature_means(rows)
        n, offset, xx, xy, yy, label_mean = centred(moments(rows, len(center), center)[0])
        priors = tuple(self.getOrDefault(p) for p in (self.alpha_1, self.alpha_2, self.lambda_1, self.lambda_2))
        weights, noise, precision = evidence_ridge(xx, xy, yy, n, priors, self.getOrDefault(self.maxIter),
                                                   self.getOrDefault(self.tol))
        model = self._copyValues(LinearFormModel())
        model._set(coefficients=weights.tolist(), intercept=float(label_mean - (offset + center) @ weights))
        model.noise_precision, model.weight_precision = noise, precision
        return model


class LinearSVR(Estimator, Supervised, DefaultParamsReadable, DefaultParamsWritable):
    """Linear regression under the epsilon-insensitive loss.

    Averaged subgradient steps on standardised inputs; a step is one pass whose
    tasks send a single gradient vector each.
    """

    C = Param(Params._dummy(), "C", "weight of the loss", TypeConverters.toFloat)
    epsilon = Param(Params._dummy(), "epsilon", "half-width of the band without loss", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "number of passes", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", predictionCol="prediction", C=1.0, epsilon=0.0,
                 maxIter=60) -> None:
        super().__init__()
        self._setDefault(C=1.0, epsilon=0.0, maxIter=60)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> LinearFormModel:
        rows = self.training_rows(dataset).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            center = feature_means(rows)
            n, offset, xx, _, yy, label_mean = centred(moments(rows, len(center), center)[0])
            middle, scale = center + offset, np.sqrt(np.diag(xx) / n)
            scale[scale == 0] = 1.0
            spread = np.sqrt(yy / n) or 1.0
            band, penalty = self.getOrDefault(self.epsilon) / spread, 1.0 / (self.getOrDefault(self.C) * n)
            weights, mean = np.zeros(len(center) + 1), np.zeros(len(center) + 1)
            steps = self.getOrDefault(self.maxIter)
            for step in range(steps):
                current = weights.copy()

                def partial(batches: Iterator[pd.DataFrame], w: np.ndarray = current) -> np.ndarray:
                    total = np.zeros(len(w))
                    for pdf in batches:
                        z = np.column_stack([(np.stack(pdf["x"].to_numpy()) - middle) / scale, np.ones(len(pdf))])
                        error = z @ w - (pdf["y"].to_numpy() - label_mean) / spread
                        total += z.T @ (np.sign(error) * (np.abs(error) > band))
                    return total

                gradient = summed(rows, partial) / n
                gradient[:-1] += penalty * weights[:-1]
                weights = weights - gradient / np.sqrt(1.0 + step)
                if step >= steps // 2:
                    mean += weights / (steps - steps // 2)
        finally:
            rows.unpersist()
        coefficients = mean[:-1] / scale * spread
        model = self._copyValues(LinearFormModel())
        model._set(coefficients=coefficients.tolist(),
                   intercept=float(label_mean + mean[-1] * spread - middle @ coefficients))
        return model


def nystroem_features(df: DataFrame, features: str, landmarks: np.ndarray, gamma: float, output: str) -> DataFrame:
    """Approximate radial-basis kernel map: similarity to each landmark, whitened by the landmarks' own kernel."""
    from airgrid.learning.kernel import inverse_root, similarities

    whiten = inverse_root(similarities(landmarks, landmarks, gamma), 1e-12)

    @F.pandas_udf("array<double>")
    def mapped(x: pd.Series) -> pd.Series:
        if x.empty:
            return pd.Series([], dtype="object")
        return pd.Series(list(similarities(np.stack(x.to_numpy()), landmarks, gamma) @ whiten))

    return df.withColumn(output, array_to_vector(mapped(vector_to_array(F.col(features)))))
