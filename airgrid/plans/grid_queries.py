"""Queries over grids: projections, tiles, clips and regridding."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from airgrid.functions import optics, projection
from airgrid.functions.projection import Geostationary
from airgrid.operators import masking, matching, regions, regrid, temporal, training
from airgrid.operators.binding import if_small, with_bound
from airgrid.operators.matching import RegularAxis
from airgrid.operators.ranking import monotonic_axis, with_falling_axis
from airgrid.plans.catalog import register
from airgrid.plans.matching_queries import EAST_VIEW, PLACED, TOLERANCE_M, cell_axes, met_axes, site_days
from airgrid.plans.sql_text import (CELL_AXES, EDGES, MET_AXES, from_geostationary, inside_pairs, to_geostationary)
from airgrid.plans.text import rounded
from airgrid.session import scratch_path
from airgrid.sources import sinks

WEST_VIEW = Geostationary(-137.0)
# scan grid of the second satellite: column and row axes in metres
B_COLUMNS, B_ROWS = (-6e5, 3.6e5), (4.6e6, -2.6e6)


@register("geos_to_latlon", f"""WITH g AS ({from_geostationary("grid_cells", -75.0, "y, x")})
    SELECT y, x, round(lat_g, 6) AS lat_g, round(lon_g, 6) AS lon_g FROM g""")
def _(t):
    lon, lat = EAST_VIEW.to_lonlat(F.col("x_m"), F.col("y_m"))
    return rounded(t.grid_cells.select("y", "x", lat.alias("lat_g"), lon.alias("lon_g")))


@register("latlon_to_geos", f"""WITH g AS ({to_geostationary("(SELECT y, x, lat, lon FROM grid_cells)", "lon", "lat", -75.0, "y, x")})
    SELECT y, x, round(x_m, 3) AS x_m, round(y_m, 3) AS y_m FROM g""")
def _(t):
    x, y = EAST_VIEW.from_lonlat(F.col("lon"), F.col("lat"))
    return rounded(t.grid_cells.select("y", "x", x.alias("x_m"), y.alias("y_m")), 3)


@register("latlon_to_webmercator", f"""
    SELECT y, x, round(6378137e0 * radians(lon), 3) AS merc_x,
           round(6378137e0 * ln(tan({math.pi / 4!r} + radians(lat) / 2)), 3) AS merc_y FROM grid_cells""")
def _(t):
    mx, my = projection.to_web_mercator(F.col("lon"), F.col("lat"))
    return rounded(t.grid_cells.select("y", "x", mx.alias("merc_x"), my.alias("merc_y")), 3)


SINUSOIDAL = """
  SELECT y, x, CAST(floor(e / 1111950e0) AS INT) AS tile_h, CAST(floor(s / 1111950e0) AS INT) AS tile_v,
         (s - floor(s / 1111950e0) * 1111950e0) / 926.625e0 - 5e-1 AS i,
         (e - floor(e / 1111950e0) * 1111950e0) / 926.625e0 - 5e-1 AS j
  FROM (SELECT y, x, 6371007.181e0 * radians(lon) * cos(radians(lat)) + 20015109.354e0 AS e,
               10007554.677e0 - 6371007.181e0 * radians(lat) AS s FROM grid_cells)"""


@register("lonlat_to_sinusoidal_tile", f"""
    SELECT y, x, tile_h, tile_v, round(i, 6) AS i, round(j, 6) AS j FROM ({SINUSOIDAL})""")
def _(t):
    h, v, i, j = projection.to_sinusoidal_tile(F.col("lon"), F.col("lat"))
    return rounded(t.grid_cells.select("y", "x", h.alias("tile_h"), v.alias("tile_v"), i.alias("i"), j.alias("j")))


@register("sinusoidal_tile_to_lonlat", f"""
    SELECT y, x, round(degrees(ex / (6371007.181e0 * cos(la))), 6) AS lon_t, round(degrees(la), 6) AS lat_t FROM (
      SELECT y, x, (round(j) + 5e-1) * 926.625e0 + tile_h * 1111950e0 - 20015109.354e0 AS ex,
             (10007554.677e0 - (round(i) + 5e-1) * 926.625e0 - tile_v * 1111950e0) / 6371007.181e0 AS la
      FROM ({SINUSOIDAL}))""")
def _(t):
    h, v, i, j = projection.to_sinusoidal_tile(F.col("lon"), F.col("lat"))
    tiled = with_bound(t.grid_cells, {"h": h, "v": v, "i": i, "j": j})
    lon, lat = projection.from_sinusoidal_tile(F.col("h"), F.col("v"), F.round("i"), F.round("j"))
    return rounded(tiled.select("y", "x", lon.alias("lon_t"), lat.alias("lat_t")))


@register("grid_tile", """
    SELECT time, y // 40 AS tile_y, x // 5 AS tile_x, CAST(count(*) AS BIGINT) AS n_cells, round(avg(AOD), 6) AS AOD
    FROM daily_grid WHERE x BETWEEN 2 AND 11 GROUP BY 1, 2, 3""")
def _(t):
    tiled = masking.with_tile(t.daily_grid.filter(F.col("x").between(2, 11)), side=40)
    tiled = tiled.withColumn("tile_x", F.floor(F.col("x") / 5).cast("int"))
    return rounded(tiled.groupBy("time", "tile_y", "tile_x").agg(F.count("*").alias("n_cells"), F.avg("AOD").alias("AOD")))


@register("axis_monotonic_check", """
    WITH axis AS (SELECT x, y, y_m + CASE WHEN (y * 7 + x) % 11 = 0 THEN 4e4 ELSE 0 END AS v FROM grid_cells),
    steps AS (SELECT x, v - lag(v) OVER (PARTITION BY x ORDER BY y) AS step FROM axis)
    SELECT x, bool_and(step < 0) AS decreasing, count(*) FILTER (step >= 0) AS n_violations
    FROM steps WHERE step IS NOT NULL GROUP BY 1""")
def _(t):
    bump = F.when((F.col("y") * 7 + F.col("x")) % 11 == 0, 4e4).otherwise(0.0)
    axis = t.grid_cells.select("x", "y", (F.col("y_m") + bump).alias("v"))
    return monotonic_axis(axis, ["x"], "y", "v")


@register("axis_reversal", """
    WITH axis AS (SELECT x, y, CASE WHEN x % 2 = 0 THEN y_m ELSE -y_m END AS v FROM grid_cells),
    ends AS (SELECT x, min(y) + max(y) AS both_ends, arg_min(v, y) < arg_max(v, y) AS rises FROM axis GROUP BY 1)
    SELECT x, CASE WHEN rises THEN both_ends - y ELSE y END AS y, round(v, 6) AS v FROM axis JOIN ends USING (x)""")
def _(t):
    axis = t.grid_cells.select("x", "y", F.when(F.col("x") % 2 == 0, F.col("y_m")).otherwise(-F.col("y_m")).alias("v"))
    return rounded(with_falling_axis(axis, ["x"], "y", "v"))


def region_edges(t):
    return regions.edges(t.region_vertices, part="part")


@register("region_bounds", """
    SELECT name, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM region_vertices GROUP BY 1""")
def _(t):
    return regions.bounds(t.region_vertices)


@register("point_in_polygon_join", f"""WITH {EDGES}, sites AS (SELECT DISTINCT latitude, longitude FROM monitors)
    {inside_pairs("sites", "latitude, longitude", "longitude", "latitude")}""")
def _(t):
    sites = t.monitors.select("latitude", "longitude").distinct()
    return regions.point_in_region_join(sites, region_edges(t), "longitude", "latitude")


@register("clip_to_region", f"""WITH {EDGES}, pairs AS ({inside_pairs("grid_cells", "y, x", "lon", "lat")}),
    kept AS (SELECT DISTINCT y, x FROM pairs)
    SELECT time, y, x, round(AOD, 6) AS AOD FROM daily_grid JOIN kept USING (y, x)""")
def _(t):
    clipped = regions.clip(t.grid_cells, region_edges(t))
    return rounded(regions.clip_field(t.daily_grid, clipped).select("time", "y", "x", "AOD"))


CELL_WIDTH, CELL_HEIGHT = 1.3, 0.17


@register("clip_all_touched", f"""WITH {EDGES},
    centres AS ({inside_pairs("grid_cells", "y, x", "lon", "lat")}),
    boxes AS (SELECT y, x, lon - {CELL_WIDTH / 2} AS w, lon + {CELL_WIDTH / 2} AS e, lat - {CELL_HEIGHT / 2} AS s,
                     lat + {CELL_HEIGHT / 2} AS n FROM grid_cells),
    sides AS (
      SELECT y, x, (x2 - x1) * (s - y1) - (y2 - y1) * (w - x1) AS c1, (x2 - x1) * (s - y1) - (y2 - y1) * (e - x1) AS c2,
             (x2 - x1) * (n - y1) - (y2 - y1) * (w - x1) AS c3, (x2 - x1) * (n - y1) - (y2 - y1) * (e - x1) AS c4
      FROM boxes JOIN edges ON greatest(x1, x2) >= w AND least(x1, x2) <= e AND greatest(y1, y2) >= s AND least(y1, y2) <= n)
    SELECT y, x FROM centres UNION SELECT y, x FROM sides
    WHERE least(c1, c2, c3, c4) <= 0 AND greatest(c1, c2, c3, c4) >= 0""")
def _(t):
    return regions.clip_all_touched(t.grid_cells, region_edges(t), CELL_WIDTH, CELL_HEIGHT).select("y", "x")


@register("to_geojson", f"""WITH {EDGES}, sites AS (SELECT DISTINCT latitude, longitude, site_name FROM monitors),
    inside AS ({inside_pairs("sites", "latitude, longitude, site_name", "longitude", "latitude")})
    SELECT '{{"type":"Feature","properties":{{"site_name":"' || site_name || '","name":"' || name
           || '"}},"geometry":{{"type":"Point","coordinates":[' || CAST(longitude AS VARCHAR) || ',' || CAST(latitude AS VARCHAR) || ']}}}}' AS feature
    FROM inside""")
def _(t):
    sites = t.monitors.select("latitude", "longitude", "site_name").distinct()
    inside = regions.point_in_region_join(sites, region_edges(t), "longitude", "latitude")
    return inside.select(sinks.to_geojson(inside, ["site_name", "name"], "longitude", "latitude").alias("feature"))


BILINEAR_W = f"""{MET_AXES},
targets AS (SELECT y, x, (lat - lat0) / dlat AS fi, (lon - lon0) / dlon AS fj, ni, nj FROM grid_cells, met_axes),
corners AS (
  SELECT y, x, CAST(floor(fi) + di AS INT) AS i, CAST(floor(fj) + dj AS INT) AS j,
         (1 - abs(fi - (floor(fi) + di))) * (1 - abs(fj - (floor(fj) + dj))) AS w
  FROM targets, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(di, dj)
  WHERE fi BETWEEN 0 AND ni - 1 AND fj BETWEEN 0 AND nj - 1),
weights AS (SELECT *, count(*) OVER (PARTITION BY y, x) AS n_corners FROM corners WHERE w > 0)"""
APPLIED = """SELECT time, y, x, round(CASE WHEN count(t2m) = any_value(n_corners) THEN sum(w * t2m) END, 6) AS t2m,
       round(CASE WHEN count(blh) = any_value(n_corners) THEN sum(w * blh) END, 6) AS blh
FROM met_daily JOIN weights USING (i, j) GROUP BY 1, 2, 3"""


@register("bilinear_regrid", f"WITH {BILINEAR_W} {APPLIED}")
def _(t):
    lon_axis, lat_axis = met_axes(t)
    weights = regrid.bilinear_weights(t.grid_cells, lat_axis, lon_axis)
    return rounded(regrid.apply_weights(t.met_daily, weights, ["t2m", "blh"]))


@register("apply_regrid_weights", f"""WITH {BILINEAR_W}, regridded AS ({APPLIED})
    SELECT y, x, round(avg(t2m), 4) AS t2m, count(blh) AS n_blh FROM regridded GROUP BY 1, 2""")
def _(t):
    lon_axis, lat_axis = met_axes(t)
    path = scratch_path(t.spark, "regrid-weights")
    regrid.bilinear_weights(t.grid_cells, lat_axis, lon_axis).write.parquet(path)
    cached = t.spark.read.parquet(path)
    applied = regrid.apply_weights(t.met_daily, cached, ["t2m", "blh"])
    return rounded(applied.groupBy("y", "x").agg(F.avg("t2m").alias("t2m"), F.count("blh").alias("n_blh")), 4)


@register("regrid_between_satellites", f"""
    WITH located AS ({from_geostationary("grid_cells", -75.0, "y, x, lon_g, lat_g").replace("SELECT y, x, lon_g, lat_g,", "SELECT y, x,", 1)}),
    seen AS ({to_geostationary("located", "lon_g", "lat_g", -137.0, "y, x")}),
    placed AS (SELECT y, x, (y_m - {B_ROWS[0]!r}) / ({B_ROWS[1]!r} / ny) AS fi, (x_m - ({B_COLUMNS[0]!r})) / {B_COLUMNS[1]!r} AS fj, ny
               FROM seen, (SELECT max(y) + 1 AS ny FROM grid_cells) WHERE x_m IS NOT NULL),
    corners AS (
      SELECT y, x, CAST(floor(fi) + di AS INT) AS i, CAST(floor(fj) + dj AS INT) AS j,
             (1 - abs(fi - (floor(fi) + di))) * (1 - abs(fj - (floor(fj) + dj))) AS w
      FROM placed, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(di, dj)
      WHERE fi BETWEEN 0 AND ny - 1 AND fj BETWEEN 0 AND 14),
    weights AS (SELECT *, count(*) OVER (PARTITION BY y, x) AS n_corners FROM corners WHERE w > 0),
    field AS (SELECT y AS i, x AS j, avg(AOD) AS AOD FROM daily_grid GROUP BY 1, 2)
    SELECT w.y, w.x, round(CASE WHEN count(f.AOD) = any_value(n_corners) THEN sum(w * f.AOD) END, 5) AS AOD, true AS remapped
    FROM field f JOIN weights w USING (i, j) GROUP BY 1, 2
    UNION ALL SELECT y, x, round(avg(AOD), 5), false FROM daily_grid GROUP BY 1, 2""")
def _(t):
    field = t.daily_grid.groupBy("y", "x").agg(F.avg("AOD").alias("AOD"))
    _, y_axis = cell_axes(t)
    rows = RegularAxis(B_ROWS[0], B_ROWS[1] / y_axis.size, y_axis.size)
    columns = RegularAxis(B_COLUMNS[0], B_COLUMNS[1], 15)
    weights = regrid.between_satellites_weights(t.grid_cells, EAST_VIEW, WEST_VIEW, rows, columns)
    on_a = regrid.apply_weights(field.withColumnsRenamed({"y": "i", "x": "j"}), weights, ["AOD"], by=[])
    return rounded(regrid.combine_satellites(field, on_a, "AOD", by=[]), 5)


@register("composite_pm", """
    SELECT time, lat, lon, round(1e9 * avg(DUSMASS25 + SSSMASS25 + BCSMASS + 1.4e0 * OCSMASS + 1.375e0 * SO4SMASS), 6) AS PM25,
           count(OCSMASS) AS n_values FROM aerosol GROUP BY 1, 2, 3""")
def _(t):
    mass = t.aerosol.withColumn("PM25", optics.composite_mass())
    daily = mass.groupBy("time", "lat", "lon").agg(F.avg("PM25").alias("PM25"), F.count("PM25").alias("n_values"))
    return rounded(masking.scale_columns(daily, {"PM25": 1e9}))


@register("apply_scale_factors", """
    SELECT time, lat, lon, round(DUSMASS25 * 1e9, 6) AS DUSMASS25, round(BCSMASS * 1e9, 6) AS BCSMASS FROM aerosol""")
def _(t):
    scaled = masking.scale_columns(t.aerosol, {"DUSMASS25": 1e9, "BCSMASS": 1e9})
    return rounded(scaled.select("time", "lat", "lon", "DUSMASS25", "BCSMASS"))


@register("scan_with_preprocess", """
    SELECT lat, lon, last_day(CAST(time AS DATE)) AS time, round(1e9 * avg(DUSMASS25 + SSSMASS25 + BCSMASS), 6) AS dust_salt_soot
    FROM aerosol GROUP BY 1, 2, 3""")
def _(t):
    def preprocess(df):
        derived = df.withColumn("dust_salt_soot", (F.col("DUSMASS25") + F.col("SSSMASS25") + F.col("BCSMASS")) * 1e9)
        return temporal.resample_mean(derived, "time", "month", ["lat", "lon"], ["dust_salt_soot"])

    # the hook runs on each source before they are stacked; the halves share no cell
    halves = [t.aerosol.filter("lat < 2"), t.aerosol.filter("lat >= 2")]
    return rounded(temporal.union_all([half.transform(preprocess) for half in halves]))


@register("site_time_series", f"""WITH {CELL_AXES},
    projected AS ({to_geostationary("(SELECT DISTINCT latitude, longitude, site_name FROM monitors)", "longitude", "latitude", -75.0, "site_name")}),
    placed AS (SELECT site_name, CAST(floor((x_m - x0) / dx + 5e-1) AS INT) AS x, CAST(floor((y_m - y0) / dy + 5e-1) AS INT) AS y
               FROM projected, cell_axes)
    SELECT site_name, time, round(avg(AOD), 6) AS AOD FROM placed JOIN daily_grid USING (y, x) GROUP BY 1, 2""")
def _(t):
    x_axis, y_axis = cell_axes(t)
    places = matching.with_projected(t.monitors.select("site_name", "latitude", "longitude").distinct(),
                                     EAST_VIEW, "longitude", "latitude")
    placed = matching.with_nearest_cell(places, x_axis, y_axis, float("inf")).select(
        "site_name", F.col("cell_y").alias("y"), F.col("cell_x").alias("x"))
    series = t.daily_grid.join(if_small(placed), ["y", "x"])
    return rounded(temporal.resample_mean(series, "time", "day", ["site_name"], ["AOD"]))


MATCHED = f"""{PLACED}, {BILINEAR_W},
    means AS (SELECT time, iy AS y, ix AS x, avg(value) AS PM25 FROM placed WHERE near GROUP BY 1, 2, 3),
    regridded AS (
      SELECT time, y, x, CASE WHEN count(t2m) = any_value(n_corners) THEN sum(w * t2m) END AS t2m,
             CASE WHEN count(blh) = any_value(n_corners) THEN sum(w * blh) END AS blh
      FROM met_daily JOIN weights USING (i, j) GROUP BY 1, 2, 3),
    joined AS (
      SELECT g.time, lat, lon, AOD, t2m, blh, PM25, n_snapshots
      FROM daily_grid g JOIN means USING (time, y, x) JOIN grid_cells USING (y, x) LEFT JOIN regridded USING (time, y, x)
      WHERE AOD IS NOT NULL)"""


def matched(t):
    x_axis, y_axis = cell_axes(t)
    lon_axis, lat_axis = met_axes(t)
    weights = regrid.bilinear_weights(t.grid_cells, lat_axis, lon_axis)
    sites = matching.with_projected(site_days(t), EAST_VIEW, "longitude", "latitude")
    placed = matching.with_nearest_cell(sites, x_axis, y_axis, TOLERANCE_M)
    means = matching.mean_per_cell(placed, "value").withColumnRenamed("value", "PM25")
    return training.matched_table(t.daily_grid, t.grid_cells, t.met_daily, weights, means, ["t2m", "blh"])


@register("matched_table", f"""WITH {MATCHED}
    SELECT time, round(lat, 6) AS lat, round(lon, 6) AS lon, round(AOD, 6) AS AOD, round(t2m, 6) AS t2m, round(blh, 6) AS blh,
           round(PM25, 6) AS PM25, n_snapshots FROM joined""")
def _(t):
    return rounded(matched(t))


@register("training_table", f"""WITH {MATCHED}
    SELECT time, round(lat, 6) AS lat, round(lon, 6) AS lon, round(AOD, 6) AS AOD, round(t2m, 6) AS t2m, round(blh, 6) AS blh,
           round(PM25, 6) AS PM25, n_snapshots, {", ".join(f"CAST(month(time) = {m} AS INT) AS month_{m}" for m in range(1, 13))}
    FROM joined WHERE t2m IS NOT NULL AND blh IS NOT NULL""")
def _(t):
    return rounded(training.training_table(matched(t)))
