"""Pieces shared by the estimators that Spark ML does not have."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Supervised(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    """Column parameters every regressor here has."""

    def training_rows(self, dataset: DataFrame, *extra: Column) -> DataFrame:
        """Features as an array ``x`` and label ``y``: what the Arrow tasks read."""
        return dataset.select(vector_to_array(F.col(self.getFeaturesCol())).alias("x"),
                              F.col(self.getLabelCol()).cast("double").alias("y"), *extra)


PIECE = 4096  # numbers of a summed vector that travel as one row


def summed(rows: DataFrame, partial: Callable[[Iterator[pd.DataFrame]], np.ndarray]) -> np.ndarray:
    """Sum of one numpy vector per partition.

    Each task folds its rows, batch by batch, into a vector; the vectors are
    cut into pieces that meet in a shuffle and are added up as they stream by,
    so the driver gets one vector however many partitions there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.asarray(partial(batches), dtype="float64")
        pieces = [total[at:at + PIECE].tobytes() for at in range(0, len(total), PIECE)]
        yield pd.DataFrame({"k": np.arange(len(pieces), dtype="int32"), "v": pieces})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for pdf in batches:
            for k, v in zip(pdf["k"], pdf["v"]):
                if k != now and now is not None:
                    yield pd.DataFrame({"k": np.array([now], dtype="int32"), "v": [total.tobytes()]})
                total, now = np.frombuffer(v) if k != now else total + np.frombuffer(v), k
        if now is not None:
            yield pd.DataFrame({"k": np.array([now], dtype="int32"), "v": [total.tobytes()]})

    kind = "k int, v binary"
    met = rows.mapInPandas(run, kind).repartition("k").sortWithinPartitions("k").mapInPandas(add, kind)
    return np.concatenate([np.frombuffer(bytes(r["v"])) for r in sorted(met.collect(), key=lambda r: r["k"])])


def moments(rows: DataFrame, n_features: int, center: np.ndarray, fold: str | None = None, n_folds: int = 1) -> np.ndarray:
    """Gram matrices of [1, x - center, y] per fold, shape (folds, p + 2, p + 2).

    One pass over the data.  Everything linear models need, for every fold and
    every subset of the features, can be worked out from these small matrices.
    """
    size = n_features + 2

    def partial(batches: Iterator[pd.DataFrame]) -> np.ndarray:
        total = np.zeros((n_folds, size, size))
        for pdf in batches:
            if pdf.empty:
                continue
            z = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy()) - center, pdf["y"].to_numpy()])
            if fold is None:
                total[0] += z.T @ z
                continue
            number = pdf[fold].to_numpy()
            for f in np.unique(number):
                part = z[number == f]
                total[f] += part.T @ part
        return total.ravel()

    return summed(rows, partial).reshape(n_folds, size, size)


def feature_means(rows: DataFrame) -> np.ndarray:
    """Mean of each element of ``x``: the centre that keeps the Gram matrices well scaled."""
    first = rows.select(F.size("x")).first()
    if first is None:
        raise ValueError("no rows to fit on")
    size = first[0]
    return np.array(rows.agg(*[F.avg(F.col("x")[k]) for k in range(size)]).first(), dtype="float64")


def linear_expression(features: str, coefficients: Sequence[float], intercept: float) -> Column:
    """intercept + w . x as a column expression."""
    x = vector_to_array(F.col(features))
    products = F.zip_with(x, F.array(*[F.lit(float(c)) for c in coefficients]), lambda a, b: a * b)
    return F.aggregate(products, F.lit(float(intercept)), lambda acc, v: acc + v)


class LinearFormModel(Model, Supervised, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted linear form."""

    coefficients = Param(Params._dummy(), "coefficients", "weights", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "constant term", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getPredictionCol(), linear_expression(
            self.getFeaturesCol(), self.getOrDefault(self.coefficients), self.getOrDefault(self.intercept)))
