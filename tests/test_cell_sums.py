"""Models fitted from sums per cell against the same models fitted on rows, on tables whose rows share their codes."""

import itertools

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from airgrid.learning import boosting, cells, forest, growing, network
from airgrid.learning.boosting import AdaBoost, BoostedTrees
from airgrid.learning.forest import ExtraTrees, RandomForest
from airgrid.learning.network import Perceptron


def table_of(spark, n=3000, seed=2, partitions=5):
    """Few distinct inputs; a third of the rows are alike in them."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, (5, 4, 6), (n, 3)).astype(float)
    x[: n // 3] = (1.0, 2.0, 3.0)
    y = np.round(x[:, 0] * 2 - np.abs(x[:, 1] - 2) * x[:, 2] + rng.normal(size=n), 3)
    rows = [(*map(float, a), float(b), int(k % 4), k + 1) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, fold int, place long").repartition(partitions)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)


def predictions(model, df):
    return {tuple(r)[:3]: r["prediction"] for r in model.transform(df).select("a", "b", "c", "prediction").distinct().collect()}


def no_copies(*_):
    raise AssertionError("rows are copied for each tree")


@pytest.fixture
def on_rows(monkeypatch):
    """Call it to have the models fitted on rows from then on; until then copies of rows are an error."""
    kept = forest.packed
    monkeypatch.setattr(forest, "packed", no_copies)
    monkeypatch.setattr(forest, "upper_levels", no_copies)

    def back():
        monkeypatch.setattr(forest, "packed", kept)
        monkeypatch.setattr(forest, "by_cells", lambda *_: False)

    return back


FORESTS = [RandomForest(labelCol="y", numTrees=12, maxDepth=6), ExtraTrees(labelCol="y", numTrees=12, featuresPerSplit=2)]


@pytest.mark.parametrize("estimator", FORESTS, ids=lambda e: type(e).__name__)
def test_forests_from_cells_are_those_of_the_rows(spark, monkeypatch, on_rows, estimator):
    df = table_of(spark)
    monkeypatch.setattr(cells, "ROWS", 300)  # several sums a task
    monkeypatch.setattr(forest, "LOCAL_ROWS", 2000)  # a table past what a task takes
    model = estimator.fit(df)
    assert predictions(estimator.fit(table_of(spark, partitions=2)), df) == pytest.approx(predictions(model, df), abs=1e-9)
    on_rows()
    monkeypatch.setattr(forest, "LOCAL_ROWS", 200_000)
    want = estimator.fit(df)
    assert predictions(model, df) == pytest.approx(predictions(want, df), abs=1e-9)
    assert model.importances() == pytest.approx(want.importances(), abs=1e-9)
    assert model.tree_lines(0, 2)[0] == want.tree_lines(0, 2)[0] and model.table.count() == 12


@pytest.mark.parametrize("estimator", FORESTS, ids=lambda e: type(e).__name__)
def test_scores_from_cells_are_those_of_the_rows(spark, monkeypatch, on_rows, estimator):
    df = table_of(spark, 1600)
    grid = {"numTrees": [4, 11], "minSplit": [2, 40], "minInstancesPerNode": [1, 9], "maxDepth": [2, 20]}
    points = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    monkeypatch.setattr(cells, "SENT_BYTES", 40_000)  # several passes

    def told():
        staged = {(r["point"], r["fold"]): (r["r2"], r["mae"], r["rmse"], r["n"]) for r in estimator.staged_scores(df, "fold", 4, points).collect()}
        curve = {(r["task"], r["held"]): (r["r2"], r["n"]) for r in estimator.curve(df, "fold", "place", [(0, 700), (0, 1600), (2, 1200)]).collect()}
        return staged, curve

    monkeypatch.setattr(forest, "by_cells", lambda *_: True)
    staged, curve = told()
    on_rows()
    wanted, curve_wanted = told()
    assert len(staged) == 4 * len(points) and staged.keys() == wanted.keys() and curve.keys() == curve_wanted.keys()
    assert all(staged[k] == pytest.approx(wanted[k], abs=1e-9) for k in wanted)
    assert all(curve[k] == pytest.approx(curve_wanted[k], abs=1e-9) for k in curve_wanted)


def test_keys_keep_the_order_of_rows():
    rng = np.random.default_rng(0)
    for width in (1, 3, 8, 11):
        codes = rng.integers(0, 3, (200, width)).astype(np.uint8) * 100
        found, which = growing.cells_of(codes)
        assert [tuple(r) for r in found] == sorted({tuple(r) for r in codes}) and (found[which] == codes).all()
        assert (np.searchsorted(growing.keys_of(found), growing.keys_of(codes)) == which).all()


@pytest.fixture
def boosted_on_rows(monkeypatch, on_rows):
    monkeypatch.setattr(boosting, "packed", no_copies)

    def back():
        on_rows()
        monkeypatch.setattr(boosting, "packed", forest.packed)
        monkeypatch.setattr(boosting, "draws_by_cell", lambda *_: 0)
        monkeypatch.setattr(boosting, "ada_takes_cells", lambda *_: False)
        monkeypatch.setattr(forest, "LOCAL_ROWS", 200_000)

    return back


BOOSTED = [BoostedTrees(labelCol="y", maxIter=5, maxDepth=3), BoostedTrees(labelCol="y", maxIter=5, maxDepth=3, rowShare=0.8, columnShare=0.7, l2=1.0), AdaBoost(labelCol="y", numTrees=5)]
GRIDS = [{"maxIter": [2, 5], "stepSize": [0.1, 1.0], "minInstancesPerNode": [1, 60]}, {"maxIter": [2, 5], "stepSize": [0.1, 1.0]}, {"numTrees": [2, 5], "learningRate": [0.5, 1.0]}]


@pytest.mark.parametrize("estimator, grid", list(zip(BOOSTED, GRIDS)), ids=["gradient", "drawn", "ada"])
def test_rounds_from_cells_are_those_of_the_rows(spark, monkeypatch, boosted_on_rows, estimator, grid):
    df = table_of(spark, 2400)
    monkeypatch.setattr(cells, "ROWS", 300)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 1500)  # before: a Spark job for every level of every round
    monkeypatch.setattr(boosting, "ROUNDS_PER_WRITE", 2)
    points = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]

    def told():
        staged = {(r["point"], r["fold"]): (r["r2"], r["mae"], r["rmse"], r["n"]) for r in estimator.staged_scores(df, "fold", 4, points).collect()}
        return predictions(estimator.fit(df), df), staged

    fit, staged = told()
    boosted_on_rows()
    fit_wanted, staged_wanted = told()
    assert fit == pytest.approx(fit_wanted, abs=1e-9)
    assert len(staged) == 4 * len(points) and staged.keys() == staged_wanted.keys()
    assert all(staged[k] == pytest.approx(staged_wanted[k], abs=1e-9) for k in staged)


def test_a_step_of_the_perceptron_is_one_stage(spark, monkeypatch):
    df, context = table_of(spark, 2000), spark.sparkContext
    monkeypatch.setattr(network, "LOCAL_BYTES", 0)
    monkeypatch.setattr(network, "BATCHES", 8)
    monkeypatch.setattr(network, "PART_ROWS", 60)  # several tasks a step
    estimator = Perceptron(labelCol="y", hidden=[6], maxIter=4, batchSize=20)
    context.setJobGroup("steps", "")
    try:
        large = estimator.fit(df)
        tracker = context.statusTracker()
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("steps")]
    finally:
        context._jsc.sc().clearJobGroup()
    assert len(jobs) >= 4 * 9
    # a shuffle in each would make it two stages and more; the first steps also deal the rows
    infos = [tracker.getStageInfo(k) for k in {k for j in jobs for k in j.stageIds}]
    assert sum(bool(i and i.numCompletedTasks) for i in infos) <= len(jobs) + 8
    monkeypatch.setattr(network, "LOCAL_BYTES", 1 << 40)
    small = estimator.fit(df)
    assert large.getOrDefault(large.weights) == pytest.approx(small.getOrDefault(small.weights), abs=1e-8)
