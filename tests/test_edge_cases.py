"""Parts and holes, ties, uneven axes, constant and empty inputs, and results without caps."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airgrid.operators import features, matching, ranking, regions, summaries
from airgrid.sources import grids, stations

OUTER, HOLE, APART = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [3, 1], [3, 3], [1, 3], [1, 1]], [[6, 1], [8, 1], [7, 3], [6, 1]]


def crossings(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_regions_of_several_parts_with_holes(spark, tmp_path):
    def feature(name, kind, coordinates):
        return {"type": "Feature", "properties": {"name": name}, "geometry": {"type": kind, "coordinates": coordinates}}

    found = [feature("many", "MultiPolygon", [[OUTER, HOLE], [APART]]), feature("one", "Polygon", [OUTER, HOLE]),
             feature("place", "Point", [1, 2]), {"type": "Feature", "properties": {"name": "none"}, "geometry": None}]
    (tmp_path / "r.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": found}))
    loaded = stations.load_regions(spark, str(tmp_path / "r.geojson"))
    assert {r.name for r in loaded.collect()} == {"many", "one"}
    others = stations.other_features(spark, str(tmp_path / "r.geojson")).collect()
    assert sorted((r.name, r.type) for r in others) == [("none", None), ("place", "Point")]
    draw = random.Random(1)
    points = [(k, draw.uniform(-1, 9), draw.uniform(-1, 5)) for k in range(400)]
    got = regions.point_in_region_join(spark.createDataFrame(points, "id int, lon double, lat double"), loaded)
    shapes = {"many": [OUTER, HOLE, APART], "one": [OUTER, HOLE]}
    assert {(r.id, r.name) for r in got.collect()} == {(k, n) for k, x, y in points for n, s in shapes.items() if crossings(s, x, y)}
    cells = spark.createDataFrame([(0, 0, 2.0, 2.0), (0, 1, 1.05, 2.0), (0, 2, 5.0, 2.0)], "y int, x int, lon double, lat double")
    touched = regions.clip_all_touched(cells, loaded, 0.2, 0.2)
    assert {r.x for r in touched.collect()} == {1}  # neither the hole nor the gap between the parts
    bounds = regions.with_bounds(loaded).filter("name = 'many'").first()
    assert (bounds.minx, bounds.miny, bounds.maxx, bounds.maxy) == (0.0, 0.0, 8.0, 4.0)


def test_dense_grid_holds_every_hour(spark):
    hours = spark.range(30).select((F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id"))).alias("time"),
                                   F.lit(0).alias("y"), F.lit(0).alias("x"), F.col("id").alias("v"))
    cells = spark.createDataFrame([(0, 0), (0, 1)], "y int, x int")
    dense = matching.densify_grid(hours, cells)
    assert dense.count() == 60 and dense.filter("v IS NOT NULL").count() == 30


def test_uneven_axes_are_refused_and_matched_otherwise(spark):
    uneven = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 4.0), (3, 9.0)], "i int, v double")
    with pytest.raises(ValueError, match="evenly"):
        matching.RegularAxis.of(uneven, "i", "v")
    places = spark.createDataFrame([(4.0,), (0.5,), (6.5,), (-3.0,), (20.0,)], "p double")
    got = {r.p: r.node for r in matching.nearest_on_axis(places, uneven.withColumnRenamed("v", "node"), "p", "node").collect()}
    assert got == {4.0: 4.0, 0.5: 1.0, 6.5: 9.0, -3.0: 0.0, 20.0: 9.0}  # halfway, the larger


def test_ties_go_to_the_larger_node_on_falling_axes_too(spark):
    one = spark.range(1).select(F.lit(1.5).alias("v"))
    for nodes in ([(0, 0.0), (1, 1.0), (2, 2.0), (3, 3.0)], [(0, 3.0), (1, 2.0), (2, 1.0), (3, 0.0)]):
        axis = matching.RegularAxis.of(spark.createDataFrame(nodes, "i int, v double"), "i", "v")
        assert dict(nodes)[one.select(axis.nearest(F.col("v"))).first()[0]] == 2.0


def test_nothing_is_dropped_from_long_selections(spark):
    wide = spark.range(1500).select(F.lit("m").alias("model"), F.format_string("f%05d", "id").alias("feature"), (-F.col("id")).alias("importance"))
    ranked = summaries.top_features(wide)
    sets = ranked.select("model", F.col("rank").alias("step"), F.array("feature").alias("features"))
    added = summaries.added_features(sets)
    assert added.count() == 1500 and added.filter("added = ''").count() == 0
    nested = spark.createDataFrame([("m", 1, ["a"]), ("m", 2, ["a", "b", "c"]), ("m", 3, ["c", "a", "b"])], "model string, step int, features array<string>")
    assert sorted((r.step, r.added) for r in summaries.added_features(nested).collect()) == [(1, "a"), (2, "b,c"), (3, "")]


def test_constant_and_empty_inputs(spark):
    same = spark.createDataFrame([("a", 2.0)] * 4 + [("b", 1.0), ("b", 3.0)], "g string, v double")
    curve = summaries.kde_curve(same, ["g"], "v", 0.0, 4.0, 5)
    assert curve.filter("g = 'a' AND density IS NOT NULL").count() == 0 and curve.filter("g = 'b' AND density > 0").count() == 5
    whole = {r.x: r.density for r in summaries.kde_curve(same.filter("g = 'b'"), ["g"], "v", -90.0, 90.0, 5).collect()}
    assert len(whole) == 5 and all(d is not None for d in whole.values())
    constant = same.filter("g = 'a'")
    for f in (summaries.histogram, summaries.histogram_right_closed):
        rows = f(constant, "v", 4).collect()
        assert sum(r.n for r in rows) == 4 and min(r.lower for r in rows) == 1.5
        assert f(constant.limit(0), "v", 4).count() == 0
    assert sum(r.n for r in summaries.hexbin_counts(constant.withColumn("w", F.col("v")), "v", "w", 10).collect()) == 4
    assert summaries.hexbin_counts(constant.limit(0).withColumn("w", F.col("v")), "v", "w", 10).count() == 0


def test_axes_that_rise_are_turned_round(spark):
    axes = spark.createDataFrame([(g, k, v) for g, vs in (("up", [1.0, 2.0, 5.0]), ("down", [9.0, 4.0, 0.0])) for k, v in enumerate(vs)],
                                 "g string, k int, v double")
    turned = ranking.with_falling_axis(axes, ["g"], "k", "v")
    assert {(r.g, r.k): r.v for r in turned.collect()} == {("up", 2): 1.0, ("up", 1): 2.0, ("up", 0): 5.0, ("down", 0): 9.0, ("down", 1): 4.0,
                                                          ("down", 2): 0.0}
    assert ranking.monotonic_axis(turned, ["g"], "k", "v").filter("NOT decreasing").count() == 0


def test_unreadable_files_are_listed(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 3.0)], "k int, v double").coalesce(1).write.parquet(str(tmp_path / "d"))
    (tmp_path / "d" / "part-bad.parquet").write_text("no grid")
    rows, unread = grids.scan_surviving(spark, str(tmp_path / "d"), "k int, v double")
    assert sorted(map(tuple, rows.collect())) == [(1, None), (2, 3.0)]
    assert [r.file.rsplit("/", 1)[1] for r in unread.collect() if not r.file.endswith(("_SUCCESS", ".crc"))] == ["part-bad.parquet"]


def test_levelling_a_size_class_equals_placing_group_by_group():
    draw = random.Random(6)
    for _ in range(300):
        loads, size, n = [draw.randrange(30) for _ in range(draw.randrange(1, 7))], draw.randrange(1, 9), draw.randrange(40)
        now, want = list(loads), [0] * len(loads)
        for _ in range(n):
            fold = min(range(len(now)), key=lambda f: (now[f], f))
            now[fold], want[fold] = now[fold] + size, want[fold] + 1
        assert features.levelled(loads, size, n) == want


def test_quantiles_of_large_groups_are_exact(spark):
    draw = random.Random(8)
    data = [("even", draw.gauss(0, 1)) for _ in range(25_000)] + [("ties", float(draw.choice([1, 1, 1, 2, 2, 9]))) for _ in range(15_000)]
    data += [("few", draw.random()) for _ in range(9)]
    wanted = {"a": 0.0, "b": 0.01, "c": 0.25, "d": 0.5, "e": 0.99, "f": 1.0}
    got = {r.g: r for r in summaries.exact_quantiles(spark.createDataFrame(data, "g string, v double"), ["g"], "v", wanted).collect()}
    for g in ("even", "ties", "few"):
        values = np.array([v for h, v in data if h == g])
        assert [got[g][k] for k in wanted] == pytest.approx([np.quantile(values, p) for p in wanted.values()])
