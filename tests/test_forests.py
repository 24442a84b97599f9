"""Grown trees against plain Python, and every shared growth against a fit of its own."""

import itertools

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from airgrid.learning import boosting, forest
from airgrid.learning.boosting import AdaBoost, BoostedTrees
from airgrid.learning.collection import DEFAULT_GRIDS, ModelCollection, default_models
from airgrid.learning.forest import ExtraTrees, RandomForest
from airgrid.learning.growing import Growth, cell_sums, cells_of, grow, root_path


def table_of(spark, n, seed=0, partitions=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    y = np.round(3 * x[:, 0] - 2 * np.abs(x[:, 1]) + 0.3 * rng.normal(size=n), 3)
    rows = [(*map(float, a), float(b), int(k % 4)) for k, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double, fold int").repartition(partitions)
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df), x, y


def plain_tree(x, y, rows, depth, most, min_leaf, min_split, l2=0.0):
    """Predictions of the training rows by trying every cut."""
    def cost(part):
        return -y[part].sum() ** 2 / (len(part) + l2)

    if depth >= most or len(rows) < max(2, min_split):
        return {r: y[rows].sum() / (len(rows) + l2) for r in rows}
    best = None
    for f in range(x.shape[1]):
        for v in np.unique(x[rows, f])[:-1]:
            left, right = rows[x[rows, f] <= v], rows[x[rows, f] > v]
            if min(len(left), len(right)) >= min_leaf:
                now = cost(left) + cost(right)
                if best is None or now < best[0] - 1e-9:
                    best = now, left, right
    if best is None or best[0] > cost(rows) - 1e-12:
        return {r: y[rows].sum() / (len(rows) + l2) for r in rows}
    return {k: v for part in best[1:] for k, v in plain_tree(x, y, part, depth + 1, most, min_leaf, min_split, l2).items()}


@pytest.mark.parametrize("growth", [Growth(), Growth(max_depth=3), Growth(min_leaf=4), Growth(min_split=9, max_depth=6), Growth(max_depth=4, l2=1.0)])
def test_a_tree_is_that_of_all_cuts(growth):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (200, 3)).astype(float)
    y = np.round(x[:, 0] * 0.3 + (x[:, 1] > 20) * 4 + rng.normal(size=200), 4)
    values = [np.unique(x[:, f]) for f in range(3)]
    cells, which = cells_of(forest.codes_of(x, values))
    tree = grow(cells, cell_sums(which, len(cells), np.ones(200), y), growth, values, root_path(42, 0))
    want = plain_tree(x, y, np.arange(200), 0, growth.max_depth, growth.min_leaf, growth.min_split, growth.l2)
    assert tree.value[tree.descend(cells)][which] == pytest.approx([want[k] for k in range(200)], abs=1e-9)


def test_drawn_cuts_lie_within_the_node():
    values = [np.arange(50.0)]
    codes = np.arange(50, dtype=np.uint8)[:, None]
    sums = np.stack([np.ones(50), np.ones(50), np.arange(50.0)])
    roots = {int(grow(codes, sums, Growth(random_cuts=True), values, root_path(42, t)).cut[0]) for t in range(40)}
    assert len(roots) > 10  # a new draw for each tree
    tree = grow(codes, sums, Growth(random_cuts=True), values, root_path(42, 0))
    assert (tree.feature < 0).sum() == 50 and (tree.n[tree.feature < 0] == 1).all()


def predictions(model, df):
    rows = model.transform(df).select("a", "b", "c", "prediction").collect()
    return {tuple(r)[:3]: r["prediction"] for r in rows}


@pytest.mark.parametrize("estimator", [RandomForest(labelCol="y", numTrees=3), ExtraTrees(labelCol="y", numTrees=3, featuresPerSplit=2),
                                       BoostedTrees(labelCol="y", maxIter=4, maxDepth=3, rowShare=0.8, columnShare=0.7, l2=1.0), AdaBoost(labelCol="y", numTrees=4)],
                         ids=lambda e: type(e).__name__)
def test_large_tables_give_the_same_trees_whatever_their_partitions(spark, monkeypatch, estimator):
    df, _, _ = table_of(spark, 400)
    want = predictions(estimator.fit(df), df)
    again, _, _ = table_of(spark, 400, partitions=7)
    assert predictions(estimator.fit(again), df) == pytest.approx(want, abs=1e-9)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 60)
    monkeypatch.setattr(forest, "SUMS_BYTES", 60_000)
    monkeypatch.setattr(forest, "MODEL_BYTES", 3_000)
    monkeypatch.setattr(boosting, "ROUNDS_PER_WRITE", 2)
    assert predictions(estimator.fit(df), df) == pytest.approx(want, abs=1e-9)


POINTS = {
    "forest": (RandomForest(labelCol="y", numTrees=2), {"numTrees": [2, 4], "minSplit": [1, 4], "minInstancesPerNode": [1, 2], "featuresPerSplit": [1, 3], "maxDepth": [3, 20]}),
    "extra": (ExtraTrees(labelCol="y", numTrees=2), {"numTrees": [1, 3], "minSplit": [2, 6], "maxDepth": [2, 30]}),
    "boost": (BoostedTrees(labelCol="y"), {"maxIter": [2, 5], "stepSize": [0.1, 1.0], "minInstancesPerNode": [1, 30], "minSplit": [2, 4]}),
    "ada": (AdaBoost(labelCol="y"), {"numTrees": [2, 5], "learningRate": [0.5, 1.0]})}


@pytest.mark.parametrize("name", sorted(POINTS))
@pytest.mark.parametrize("large", [False, True])
def test_every_staged_score_is_that_of_a_fit_of_its_own(spark, monkeypatch, name, large):
    df, _, _ = table_of(spark, 240, seed=1)
    estimator, grid = POINTS[name]
    points = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]
    if large:
        monkeypatch.setattr(forest, "LOCAL_ROWS", 50)
        points = points[::5]
    got = {(r["point"], r["fold"]): (r["r2"], r["mae"], r["rmse"], r["n"]) for r in estimator.staged_scores(df, "fold", 4, points).collect()}
    assert len(got) == 4 * len(points)
    monkeypatch.setattr(forest, "LOCAL_ROWS", 200_000)
    monkeypatch.setattr(forest, "feature_cuts", lambda rows, cuts=forest.feature_cuts(forest.training_rows(df, "features", "y")): cuts)
    monkeypatch.setattr(boosting, "feature_cuts", forest.feature_cuts)
    for k in range(0, len(points), 3):
        model = estimator.copy({estimator.getParam(n): v for n, v in points[k].items()}).fit(df.filter("fold <> 1"))
        e = np.array([(r["y"], r["prediction"]) for r in model.transform(df.filter("fold = 1")).collect()])
        error = e[:, 0] - e[:, 1]
        want = 1 - error @ error / ((e[:, 0] - e[:, 0].mean()) ** 2).sum(), np.abs(error).mean(), np.sqrt((error ** 2).mean()), len(e)
        assert got[k, 1] == pytest.approx(want, abs=1e-9), points[k]


def test_boosted_leaves_are_gradient_over_hessian(spark):
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(
        spark.createDataFrame([(0.0, 1.0), (0.0, 3.0), (1.0, 10.0), (1.0, 14.0), (1.0, 12.0)], "a double, y double"))
    model = BoostedTrees(labelCol="y", maxIter=2, stepSize=0.5, maxDepth=1, l2=1.0).fit(df)
    # start at the mean of 8; residual sums -12 of two rows and 12 of three; then what is left of them
    first = 8 + 0.5 * -12 / 3, 8 + 0.5 * 12 / 4
    second = first[0] + 0.5 * (4 - 2 * first[0]) / 3, first[1] + 0.5 * (36 - 3 * first[1]) / 4
    got = {r["a"]: r["prediction"] for r in model.transform(df).collect()}
    assert got == pytest.approx({0.0: second[0], 1.0: second[1]})


def test_adaboost_takes_the_weighted_median():
    values, says = np.array([[3.0, 1.0, 2.0], [1.0, 1.0, 5.0]]), np.array([1.0, 1.0, 3.0])
    assert boosting.weighted_median(values, says).tolist() == [2.0, 5.0]


@pytest.mark.parametrize("estimator", [RandomForest(labelCol="y"), BoostedTrees(labelCol="y"), AdaBoost(labelCol="y")], ids=lambda e: type(e).__name__)
def test_no_rows_is_named(spark, estimator):
    df, _, _ = table_of(spark, 5)
    with pytest.raises(ValueError, match="no rows"):
        estimator.fit(df.limit(0))


def test_alike_rows_nulls_and_constants(spark):
    df, _, _ = table_of(spark, 30)
    twice = df.unionByName(df).unionByName(df.limit(3).withColumn("y", F.lit(None).cast("double")).withColumn("fold", F.lit(None).cast("int")))
    scores = ExtraTrees(labelCol="y", numTrees=2).staged_scores(twice, "fold", 4, [{}]).collect()
    assert sum(r["n"] for r in scores) == 60
    flat = df.withColumn("y", F.lit(2.5))
    assert set(predictions(RandomForest(labelCol="y", numTrees=2).fit(flat), df).values()) == {2.5}


def test_learning_curve_of_trees_is_that_of_fits(spark, tables, monkeypatch):
    from airgrid.learning import selection

    rows = tables.features.withColumn("fold", F.pmod(F.xxhash64("l_orderkey"), F.lit(2)).cast("int"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    cuts = forest.feature_cuts(rows.select(F.array("AOD", "t2m", "blh").alias("x")))
    monkeypatch.setattr(forest, "feature_cuts", lambda _: cuts)
    ask = (Pipeline(stages=[ExtraTrees(labelCol="PM25", numTrees=2, maxDepth=5)]), rows, ["AOD", "t2m", "blh"], "PM25", "fold", 2, keys, [0.1, 0.5])
    got = sorted(tuple(r) for r in selection.learning_curve(*ask).collect())
    monkeypatch.delattr(ExtraTrees.__mro__[1], "curve")
    want = sorted(tuple(r) for r in selection.learning_curve(*ask).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(g == pytest.approx(w, abs=1e-9) for g, w in zip(got, want))


def test_default_grids_name_parameters_of_their_models():
    models = default_models("y")
    for name, grid in DEFAULT_GRIDS.items():
        last = models[name].getStages()[-1]
        assert all(last.hasParam(p) for p in grid), name


def test_a_collection_cross_validates_and_tunes_trees(spark):
    df, _, _ = table_of(spark, 120)
    models = default_models("y", trees=3)
    collection = ModelCollection(["a", "b", "c"], "y", {n: models[n] for n in ("Random Forest", "XGBoost", "Ada Boost", "Linear Regression")})
    scores = collection.cross_validate(df.drop("features"), "fold", 4).collect()
    assert len(scores) == 16 and all(r["fit_time"] > 0 and r["n"] == 30 for r in scores)
    found = collection.tune(df.drop("features"), "fold", {"Random Forest": {"numTrees": [1, 5]}, "XGBoost": {"maxIter": [1, 20]}, "Ada Boost": {"numTrees": [1, 5]}})
    assert [len(found[n]["metrics"]) for n in ("Random Forest", "XGBoost", "Ada Boost")] == [2, 2, 2]
    collection.update_models()
    assert collection.models["Random Forest"].getStages()[-1].getOrDefault("numTrees") == 5
