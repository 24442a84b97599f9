"""Properties of projections, regridding, clipping and matching."""

import math
import random

import pytest
from pyspark.sql import functions as F

from airgrid.functions import projection
from airgrid.functions.projection import Geostationary
from airgrid.operators import matching, regions, regrid
from airgrid.operators.matching import RegularAxis


def test_geostationary_worked_example(spark):
    view = Geostationary(-75.0)
    h = projection.SATELLITE_HEIGHT_M
    lon, lat = view.to_lonlat(F.lit(-0.024052 * h), F.lit(0.095340 * h))
    got = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert got["lat"] == pytest.approx(33.846162, abs=1e-4)
    assert got["lon"] == pytest.approx(-84.690932, abs=1e-4)


def test_geostationary_round_trip_and_edges(spark):
    view = Geostationary(-75.0)
    points = spark.createDataFrame([(float(lon), float(lat)) for lon in range(-130, -20, 10) for lat in range(-50, 51, 10)],
                                   "lon double, lat double")
    x, y = view.from_lonlat(F.col("lon"), F.col("lat"))
    lon2, lat2 = view.to_lonlat(F.col("x"), F.col("y"))
    back = points.select("lon", "lat", x.alias("x"), y.alias("y")).select("lon", "lat", lon2.alias("a"), lat2.alias("b"))
    for r in back.collect():
        assert r["a"] == pytest.approx(r["lon"], abs=1e-9) and r["b"] == pytest.approx(r["lat"], abs=1e-9)
    hidden = view.from_lonlat(F.lit(105.0), F.lit(0.0))
    off = view.to_lonlat(F.lit(6e6), F.lit(6e6))
    assert spark.range(1).select(*hidden, *off).first() == (None, None, None, None)


def test_sinusoidal_round_trip(spark):
    points = spark.createDataFrame([(-95.3, 29.7), (-170.2, 61.0), (12.5, -33.1), (0.1, 0.1)], "lon double, lat double")
    h, v, i, j = projection.to_sinusoidal_tile(F.col("lon"), F.col("lat"))
    lon, lat = projection.from_sinusoidal_tile(F.col("h"), F.col("v"), F.col("i"), F.col("j"))
    tiled = points.select("lon", "lat", h.alias("h"), v.alias("v"), i.alias("i"), j.alias("j"))
    for r in tiled.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert r["a"] == pytest.approx(r["lon"], abs=1e-9) and r["b"] == pytest.approx(r["lat"], abs=1e-9)
    names = spark.createDataFrame([("h12v08",)], "s string").select(*projection.parse_tile(F.col("s"))).first()
    assert tuple(names) == (12, 8)


def test_bilinear_is_exact_on_a_linear_field(spark):
    lat_axis, lon_axis = RegularAxis(20.0, 0.5, 41), RegularAxis(-120.0, 1.0, 31)
    field = (spark.range(41 * 31).select((F.col("id") / 31).cast("int").alias("i"), (F.col("id") % 31).cast("int").alias("j"))
             .withColumn("v", 3.0 + 2.0 * lat_axis.value(F.col("i")) - 0.7 * lon_axis.value(F.col("j"))).withColumn("time", F.lit(1)))
    random.seed(5)
    cells = [(k, 0, random.uniform(20, 40), random.uniform(-120, -90)) for k in range(200)]
    cells += [(200, 0, 40.0, -90.0), (201, 0, 20.0, -120.0), (202, 0, 41.0, -100.0)]  # corners and one outside
    target = spark.createDataFrame(cells, "y int, x int, lat double, lon double")
    got = {r["y"]: r["v"] for r in regrid.apply_weights(field, regrid.bilinear_weights(target, lat_axis, lon_axis), ["v"]).collect()}
    assert len(got) == 202
    for y, _, lat, lon in cells[:202]:
        assert got[y] == pytest.approx(3.0 + 2.0 * lat - 0.7 * lon, abs=1e-9)


def test_missing_corner_gives_missing_value(spark):
    axis = RegularAxis(0.0, 1.0, 3)
    field = spark.createDataFrame([(1, i, j, None if (i, j) == (1, 1) else 1.0) for i in range(3) for j in range(3)],
                                  "time int, i int, j int, v double")
    target = spark.createDataFrame([(0, 0, 0.5, 0.5), (1, 0, 0.0, 0.5), (2, 0, 2.0, 2.0)], "y int, x int, lat double, lon double")
    got = {r["y"]: r["v"] for r in regrid.apply_weights(field, regrid.bilinear_weights(target, axis, axis), ["v"]).collect()}
    assert got == {0: None, 1: 1.0, 2: 1.0}


def test_clip_with_a_rectangle_is_a_bounding_box(spark):
    ring = [(-3.0, -7.0), (12.0, -7.0), (12.0, 8.5), (-3.0, 8.5), (-3.0, -7.0)]
    vertices = spark.createDataFrame([("box", k, *p) for k, p in enumerate(ring)], "name string, k int, lon double, lat double")
    cells = spark.range(60 * 60).select((F.col("id") / 60).cast("int").alias("y"), (F.col("id") % 60).cast("int").alias("x")) \
        .withColumns({"lon": F.col("x") * 0.7 - 20.05, "lat": F.col("y") * 0.6 - 17.03})
    inside = regions.clip(cells, regions.rings(vertices), side=2.0).select("y", "x")
    box = cells.filter("lon > -3 AND lon < 12 AND lat > -7 AND lat < 8.5").select("y", "x")
    assert inside.exceptAll(box).count() == 0 and box.exceptAll(inside).count() == 0
    touched = regions.clip_all_touched(cells, regions.rings(vertices), 0.7, 0.6, side=2.0).select("y", "x")
    wider = cells.filter("lon >= -3.35 AND lon <= 12.35 AND lat >= -7.3 AND lat <= 8.8").select("y", "x")
    assert touched.exceptAll(wider).count() == 0 and wider.exceptAll(touched).count() == 0


def crossing(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_point_in_region_against_brute_force(spark):
    random.seed(3)
    shapes = {}
    for n in range(12):
        cx, cy, size = random.uniform(-100, -80), random.uniform(25, 45), random.uniform(0.5, 9)
        corners = [(cx + size * random.uniform(0.3, 1) * math.cos(a), cy + size * random.uniform(0.3, 1) * math.sin(a))
                   for a in [2 * math.pi * k / 9 for k in range(9)]]
        shapes[f"s{n}"] = [*corners, corners[0]]
    vertices = spark.createDataFrame([(n, k, *p) for n, ring in shapes.items() for k, p in enumerate(ring)],
                                     "name string, k int, lon double, lat double")
    points = [(k, random.uniform(-110, -70), random.uniform(20, 50)) for k in range(800)]
    got = regions.point_in_region_join(spark.createDataFrame(points, "id int, lon double, lat double"), regions.rings(vertices))
    want = {(k, n) for k, x, y in points for n, ring in shapes.items() if crossing(ring, x, y)}
    rows = [(r["id"], r["name"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("most", [12, 64])
def test_index_of_a_long_outline(spark, monkeypatch, most):
    """A star of many vertices with a hole, a part touching lattice lines, and a rectangle on them."""
    monkeypatch.setattr(regions.cells, "__defaults__", (regions.BLOCK_DEGREES, most))
    draw = random.Random(8)

    def star(n, cx, cy, size):
        turns = [2 * math.pi * k / n for k in range(n)]
        corners = [(cx + size * f * math.cos(a), cy + size * f * math.sin(a)) for a, f in ((a, draw.uniform(0.9, 1)) for a in turns)]
        return [*corners, corners[0]]

    shapes = {"long": [star(4000 if most == 64 else 300, 2.0, 1.0, 9.0), star(60, 2.5, 1.5, 4.0),
                       [(15.0, 5.0), (20.0, 5.0), (20.0, 10.0), (15.0, 10.0), (15.0, 5.0)]],
              "box": [[(-10.0, -5.0), (10.0, -5.0), (10.0, 5.0), (-10.0, 5.0), (-10.0, -5.0)]]}
    vertices = spark.createDataFrame([(n, p, 3 * k, *v) for n, shape in shapes.items() for p, ring in enumerate(shape)
                                      for k, v in enumerate(ring)], "name string, part int, k int, lon double, lat double")
    points = [(k, draw.uniform(-12, 22), draw.uniform(-12, 14)) for k in range(1500)]
    points += [(2000 + 40 * i + j, -12.5 + 2.5 * i / 2, -12.5 + 2.5 * j / 2) for i in range(30) for j in range(22)]  # on lines and corners
    points += [(9000 + k, *v) for k, v in enumerate(shapes["long"][0][:150])]
    edges = regions.edges(vertices, part="part")
    index, sides = regions.cells(edges)
    assert index.selectExpr("max(size(edges)) AS n").first().n <= most and len(sides) > 1
    placed = spark.createDataFrame(points, "id int, lon double, lat double")
    want = {(k, n) for k, x, y in points for n, shape in shapes.items() if sum(crossing(ring, x, y) for ring in shape) % 2}
    rows = [(r["id"], r["name"]) for r in regions.point_in_region_join(placed, edges).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert sorted(r["id"] for r in regions.clip(placed, regions.rings(vertices, part="part")).collect()) == sorted({k for k, _ in want})
    assert regions.clip(placed, edges.limit(0)).count() == 0


def test_nearest_cell_keeps_to_the_tolerance(spark):
    random.seed(1)
    axis = RegularAxis(0.0, 10.0, 20)
    points = spark.createDataFrame([(k, random.uniform(-20, 220), random.uniform(-20, 220)) for k in range(500)],
                                   "id int, x_m double, y_m double")
    placed = matching.with_nearest_cell(points, axis, axis, 2.0).collect()
    assert len(placed) == 500
    for r in placed:
        want_y, want_x = round(r["y_m"] / 10), round(r["x_m"] / 10)
        near = abs(r["y_m"] - 10 * want_y) <= 2 and abs(r["x_m"] - 10 * want_x) <= 2 and 0 <= want_y < 20 and 0 <= want_x < 20
        assert (r["cell_y"], r["cell_x"]) == ((want_y, want_x) if near else (None, None))


def test_unmatched_points_stay(spark):
    axis = RegularAxis(0.0, 10.0, 3)
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 14.9, 0.0), (1, 500.0, 0.0), (1, 10.0, 10.0)], "time int, x_m double, y_m double")
    grid = spark.createDataFrame([(1, 0, 0, 7.0), (1, 1, 1, None)], "time int, y int, x int, AOD double")
    joined = matching.nearest_cell_join(points, grid, axis, axis, 2.0).withColumn("outcome", matching.match_outcome(axis, axis))
    assert sorted((r["outcome"], r["AOD"]) for r in joined.collect()) == [
        ("matched", 7.0), ("matched_null", None), ("out_of_bounds", None), ("unmatched", None)]


def test_uneven_axis_against_brute_force(spark, ranges):
    random.seed(2)
    nodes = sorted({round(random.expovariate(0.05), 3) for _ in range(60)} | {500.0, 500.001, 500.002})
    values = [random.uniform(-10, 600) for _ in range(400)] + [nodes[3]] * 300 + [(nodes[0] + nodes[1]) / 2, None]
    points = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id int, v double")
    axis = spark.createDataFrame([(n,) for n in nodes], "node double")
    for r in matching.nearest_on_axis(points, axis, "v", "node").collect():
        want = None if r["v"] is None else min(nodes, key=lambda n, v=r["v"]: (abs(n - v), -n))
        assert r["node"] == want


def test_focal_mean_uses_rows_and_columns(spark):
    grid = spark.createDataFrame([(1, y, x, float(10 * y + x)) for y in range(10) for x in range(20)],
                                 "time int, y int, x int, v double")
    points = spark.createDataFrame([(0, 19), (5, 5)], "y int, x int")
    got = {(r["point_y"], r["point_x"]): r["v"] for r in matching.focal_mean(points, grid, ["v"], reach=1).collect()}
    assert got[(5, 5)] == pytest.approx(55.0)
    assert got[(0, 19)] == pytest.approx((18 + 19 + 28 + 29) / 4)


def test_merge_products_first_wins(spark):
    a = spark.createDataFrame([(1, 1.0, None)], "k int, u double, v double")
    b = spark.createDataFrame([(1, 9.0, 5.0), (2, 8.0, 6.0)], "k int, u double, w double")
    got = {r["k"]: (r["u"], r["v"], r["w"]) for r in matching.merge_products([a, b], ["k"]).collect()}
    assert got == {1: (1.0, None, 5.0), 2: (None, None, 6.0)}
