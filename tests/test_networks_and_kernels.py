"""The perceptron and the kernel regressor: the same for any partitioning, and side by side as alone."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Window
from pyspark.sql import functions as F

from airgrid.learning import network
from airgrid.learning.base import summed
from airgrid.learning.kernel import KernelSVR
from airgrid.learning.network import Perceptron, gradient_sum


def table_of(spark, n, partitions=3):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(n, 2)), 3)
    y = np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2 + 0.05 * rng.normal(size=n)
    rows = [(*map(float, a), float(b), int(k % 3)) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int").repartition(partitions)
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def weights(spark, partitions):
    model = Perceptron(labelCol="y", hidden=[8, 4], maxIter=6, batchSize=20).fit(table_of(spark, 300, partitions))
    return np.array(model.getOrDefault(model.weights))


def test_weights_do_not_depend_on_partitions_or_size(spark, monkeypatch):
    want = weights(spark, 1)
    for partitions in (4, 16):
        assert weights(spark, partitions) == pytest.approx(want, abs=1e-8)
    monkeypatch.setattr(network, "LOCAL_BYTES", 0)
    monkeypatch.setattr(network, "BATCHES", 8)  # the jobs of six epochs
    large = weights(spark, 4)
    monkeypatch.setattr(network, "LOCAL_BYTES", 128 << 20)
    assert weights(spark, 4) == pytest.approx(large, abs=1e-8)


def test_gradient_is_that_of_differences():
    rng = np.random.default_rng(1)
    layers, z, y = [3, 5, 4, 1], rng.normal(size=(20, 3)), rng.normal(size=20)
    flat = rng.normal(size=3 * 5 + 5 + 5 * 4 + 4 + 4 + 1)

    def loss(w):
        return 0.5 * ((network.forward(z, network.unpack(w, layers))[-1][:, 0] - y) ** 2).sum()

    steps = np.eye(len(flat)) * 1e-6
    want = [(loss(flat + s) - loss(flat - s)) / 2e-6 for s in steps]
    assert gradient_sum(z, y, flat, layers) == pytest.approx(want, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("estimator, points", [
    (Perceptron(labelCol="y", hidden=[4], maxIter=4, batchSize=50), [{}, {"hidden": [3, 3]}, {"alpha": 1.0}]),
    (KernelSVR(labelCol="y", landmarks=20, maxIter=8), [{}, {"landmarks": 8, "C": 10.0}, {"gamma": 2.0}, {"gamma": 2.0, "C": 0.01}])],
    ids=["perceptron", "kernel"])
def test_side_by_side_is_as_alone(spark, estimator, points):
    df = table_of(spark, 240)
    got = {(r["point"], r["fold"]): (r["r2"], r["n"]) for r in estimator.staged_scores(df, "fold", 3, points).collect()}
    assert len(got) == 3 * len(points)
    for k, point in enumerate(points):
        model = estimator.copy({estimator.getParam(n): v for n, v in point.items()}).fit(df.filter("fold <> 1"))
        e = np.array([(r["y"], r["prediction"]) for r in model.transform(df.filter("fold = 1")).collect()])
        r2 = 1 - ((e[:, 0] - e[:, 1]) ** 2).sum() / ((e[:, 0] - e[:, 0].mean()) ** 2).sum()
        assert got[k, 1] == (pytest.approx(r2, abs=1e-6), 80), point


def test_the_kernel_bends(spark, tmp_path):
    df = table_of(spark, 400)
    scores = []
    for model in (Pipeline(stages=[KernelSVR(labelCol="y", landmarks=60, gamma=0.5, C=100.0)]).fit(df),):
        rows = model.transform(df)
        scores.append(rows.select(1 - F.sum((F.col("y") - F.col("prediction")) ** 2) / (F.var_pop("y") * F.count("*"))).first()[0])
        model.write().overwrite().save(str(tmp_path / "m"))
        again = PipelineModel.load(str(tmp_path / "m")).transform(df).agg(F.sum("prediction")).first()[0]
        assert again == pytest.approx(rows.agg(F.sum("prediction")).first()[0])
    assert scores[0] > 0.9


def test_curve_of_the_perceptron_grows_with_its_rows(spark):
    df = table_of(spark, 300).withColumn("place", F.row_number().over(Window.orderBy("a", "b")))
    got = Perceptron(labelCol="y", hidden=[4], maxIter=3).curve(df, "fold", "place", [(0, 150), (0, 300), (1, 300)]).collect()
    n = {(r["task"], r["held"]): r["n"] for r in got}
    assert n[0, True] == n[1, True] == 100 and n[1, False] == 200 and 60 < n[0, False] < 140 and n[2, False] == 200


def test_summed_vectors_of_several_pieces(spark):
    rows = spark.range(50).repartition(7)
    got = summed(rows, lambda batches: sum((np.arange(10_000.0) * b["id"].sum() for b in batches if len(b)), np.zeros(10_000)))
    assert got == pytest.approx(np.arange(10_000.0) * 1225)


@pytest.mark.parametrize("estimator", [Perceptron(labelCol="y"), KernelSVR(labelCol="y")], ids=lambda e: type(e).__name__)
def test_no_rows_is_named(spark, estimator):
    with pytest.raises(ValueError, match="no rows"):
        estimator.fit(table_of(spark, 3).limit(0))
