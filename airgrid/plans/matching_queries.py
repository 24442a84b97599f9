"""Queries that match monitors, cells, weather nodes and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.functions import projection, text
from airgrid.functions.projection import Geostationary
from airgrid.operators import masking, matching
from airgrid.operators.binding import if_small
from airgrid.operators.matching import RegularAxis
from airgrid.plans.catalog import register
from airgrid.plans.sql_text import CELL_AXES, MET_AXES, to_geostationary
from airgrid.plans.temporal_queries import DAILY, daily
from airgrid.plans.text import rounded
from airgrid.sources import sinks

EAST_VIEW = Geostationary(-75.0)
TOLERANCE_M = 60000.0
MONITOR_NAMES = {"Date Local": "time", "Latitude": "latitude", "Longitude": "longitude",
                 "Arithmetic Mean": "value", "State Name": "state_name", "Local Site Name": "site_name"}


def cell_axes(t) -> tuple[RegularAxis, RegularAxis]:
    cells = t.grid_cells
    return RegularAxis.of(cells, "x", "x_m"), RegularAxis.of(cells, "y", "y_m")


def met_axes(t) -> tuple[RegularAxis, RegularAxis]:
    met = t.met_daily
    return RegularAxis.of(met, "j", "lon"), RegularAxis.of(met, "i", "lat")


def site_days(t):
    """Valid readings, instruments of a site averaged per day."""
    return masking.valid_readings(t.monitors).groupBy("time", "latitude", "longitude").agg(F.avg("value").alias("value"))


def projected_sites(t):
    return matching.with_projected(site_days(t), EAST_VIEW, "longitude", "latitude")


SITE_DAYS = """site_days AS (
  SELECT time, latitude, longitude, avg(value) AS value FROM monitors WHERE value >= 0 GROUP BY 1, 2, 3)"""
PLACED = f"""{SITE_DAYS}, {CELL_AXES},
projected AS ({to_geostationary("site_days", "longitude", "latitude", -75.0, "time, latitude, longitude, value")}),
snapped AS (
  SELECT *, CAST(floor((x_m - x0) / dx + 5e-1) AS INT) AS ix, CAST(floor((y_m - y0) / dy + 5e-1) AS INT) AS iy
  FROM projected, cell_axes),
placed AS (
  SELECT *, (ix BETWEEN 0 AND nx - 1) AND (iy BETWEEN 0 AND ny - 1) AS in_bounds,
         ix BETWEEN 0 AND nx - 1 AND iy BETWEEN 0 AND ny - 1 AND abs(x_m - (x0 + dx * ix)) <= {TOLERANCE_M}
         AND abs(y_m - (y0 + dy * iy)) <= {TOLERANCE_M} AS near
  FROM snapped),
matched AS (
  SELECT p.*, g.AOD, g.time IS NOT NULL AS has_cell
  FROM placed p LEFT JOIN daily_grid g ON p.near AND g.time = p.time AND g.y = p.iy AND g.x = p.ix)"""


@register("normalise_monitors", "SELECT time, latitude, longitude, round(value, 6) AS value, site_name FROM monitors")
def _(t):
    published = t.monitors.withColumnsRenamed({v: k for k, v in MONITOR_NAMES.items()})
    return rounded(masking.normalise_monitors(published, MONITOR_NAMES,
                                              ["time", "latitude", "longitude", "value", "site_name"]))


@register("valid_readings", "SELECT time, site_name, POC, round(value, 6) AS value FROM monitors WHERE value >= 0")
def _(t):
    return rounded(masking.valid_readings(t.monitors).select("time", "site_name", "POC", "value"))


@register("attribute_filter", """
    SELECT site_name, time, round(value, 6) AS value FROM monitors WHERE state_name = 'Nebraska' AND POC <> 7""")
def _(t):
    named = t.monitors.filter((F.col("state_name") == "Nebraska") & (F.col("POC") != 7))
    return rounded(named.select("site_name", "time", "value"))


@register("single_day_lookup", "SELECT y, x, round(AOD, 6) AS AOD, n_snapshots FROM daily_grid WHERE time = DATE '2024-01-09'")
def _(t):
    day = F.lit("2024-01-09").cast("date")
    return rounded(t.daily_grid.filter(F.col("time") == day).select("y", "x", "AOD", "n_snapshots"))


@register("dropna_subset", "SELECT time, y, x, round(AOD, 6) AS AOD FROM daily_grid WHERE AOD IS NOT NULL")
def _(t):
    return rounded(t.daily_grid.dropna(subset=["AOD"]).select("time", "y", "x", "AOD"))


@register("bbox_filter", f"""
    WITH {SITE_DAYS}, projected AS ({to_geostationary("site_days", "longitude", "latitude", -75.0, "time, latitude, longitude, value")})
    SELECT time, latitude, longitude, round(value, 6) AS value FROM projected
    WHERE x_m BETWEEN -3e6 AND -2e5 AND y_m BETWEEN 2.2e6 AND 4.2e6""")
def _(t):
    boxed = masking.bounding_box(projected_sites(t), "x_m", "y_m", (-3e6, 2.2e6, -2e5, 4.2e6))
    return rounded(boxed.select("time", "latitude", "longitude", "value"))


# Named extents as (minlat, maxlat, minlon, maxlon).
EXTENTS = {
    "US": (25.0, 49.0, -120.0, -73.0),
    "USBbox": (24.396308, 49.384358, -124.848974, -66.885444),
    "Houston": (29.3, 30.08910587, -95.81349756, -94.73398897),
    "LA": (33.5, 34.2152144, -117.8, -116.7522488),
    "Pittsburgh": (40.14211, 40.62940, -80.29827, -79.46404),
    "Nebraska": (40.000102, 43.00037, -104.053729, -95.317255),
    "Fargo": (46.35421, 47.34895, -97.33842, -95.75006),
}


@register("points_in_extents", "WITH extents AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', {a}e0, {b}e0, {c}e0, {d}e0)" for n, (a, b, c, d) in EXTENTS.items()) + """
    ) AS v(extent, minlat, maxlat, minlon, maxlon))
    SELECT extent, time, latitude, longitude, count(*) AS n_readings
    FROM monitors JOIN extents ON latitude > minlat AND latitude < maxlat AND longitude > minlon AND longitude < maxlon
    GROUP BY ALL""")
def _(t):
    # a point carries the names of the extents it lies in: a projection, not a join
    inside = F.array_compact(F.array(*[
        F.when(masking.within("latitude", a, b, False) & masking.within("longitude", c, d, False), n)
        for n, (a, b, c, d) in EXTENTS.items()]))
    named = t.monitors.select("time", "latitude", "longitude", F.explode(inside).alias("extent"))
    return named.groupBy("extent", "time", "latitude", "longitude").agg(F.count("*").alias("n_readings"))


@register("mean_by_site_day", f"""WITH {SITE_DAYS}
    SELECT time, latitude, longitude, round(value, 6) AS value FROM site_days""")
def _(t):
    return rounded(site_days(t))


@register("nearest_cell_join", f"""WITH {PLACED}
    SELECT time, latitude, longitude, round(value, 6) AS value, CASE WHEN near THEN iy END AS cell_y,
           CASE WHEN near THEN ix END AS cell_x, round(AOD, 6) AS AOD FROM matched""")
def _(t):
    x_axis, y_axis = cell_axes(t)
    joined = matching.nearest_cell_join(projected_sites(t), t.daily_grid, x_axis, y_axis, TOLERANCE_M)
    return rounded(joined.select("time", "latitude", "longitude", "value", "cell_y", "cell_x", "AOD"))


@register("match_counts", f"""WITH {PLACED}
    SELECT CASE WHEN x_m IS NULL OR NOT in_bounds THEN 'out_of_bounds' WHEN NOT near OR NOT has_cell THEN 'unmatched'
                WHEN AOD IS NULL THEN 'matched_null' ELSE 'matched' END AS outcome, count(*) AS n_points
    FROM matched GROUP BY 1""")
def _(t):
    x_axis, y_axis = cell_axes(t)
    joined = matching.nearest_cell_join(projected_sites(t), t.daily_grid, x_axis, y_axis, TOLERANCE_M)
    return joined.groupBy(matching.match_outcome(x_axis, y_axis).alias("outcome")).agg(F.count("*").alias("n_points"))


@register("mean_by_cell_day", f"""WITH {CELL_AXES},
    projected AS ({to_geostationary("(SELECT * FROM monitors WHERE value >= 0)", "longitude", "latitude", -75.0, "time, value")}),
    snapped AS (SELECT *, CAST(floor((x_m - x0) / dx + 5e-1) AS INT) AS x, CAST(floor((y_m - y0) / dy + 5e-1) AS INT) AS y
                FROM projected, cell_axes)
    SELECT time, y, x, round(avg(value), 6) AS value FROM snapped
    WHERE x BETWEEN 0 AND nx - 1 AND y BETWEEN 0 AND ny - 1 AND abs(x_m - (x0 + dx * x)) <= {TOLERANCE_M}
      AND abs(y_m - (y0 + dy * y)) <= {TOLERANCE_M} GROUP BY 1, 2, 3""")
def _(t):
    x_axis, y_axis = cell_axes(t)
    return rounded(matching.mean_of_readings(masking.valid_readings(t.monitors), "value", "longitude", "latitude",
                                             EAST_VIEW, x_axis, y_axis, TOLERANCE_M))


@register("assign_points_to_grid", f"""WITH {PLACED},
    means AS (SELECT time, iy, ix, avg(value) AS PM25 FROM placed WHERE near GROUP BY 1, 2, 3)
    SELECT g.time, g.y, g.x, round(g.AOD, 6) AS AOD, round(PM25, 6) AS PM25
    FROM daily_grid g LEFT JOIN means m ON m.time = g.time AND m.iy = g.y AND m.ix = g.x""")
def _(t):
    x_axis, y_axis = cell_axes(t)
    placed = matching.with_nearest_cell(projected_sites(t), x_axis, y_axis, TOLERANCE_M)
    return rounded(matching.assign_points_to_grid(t.daily_grid, placed, "value", "PM25")
                   .select("time", "y", "x", "AOD", "PM25"))


@register("align_by_day", f"""WITH {MET_AXES}, {SITE_DAYS}, monitor_days AS (
      SELECT time, avg(value) AS PM25 FROM site_days GROUP BY 1)
    SELECT g.time, g.y, g.x, round(g.AOD, 6) AS AOD, round(m.t2m, 6) AS t2m, round(m.blh, 6) AS blh, round(PM25, 6) AS PM25
    FROM daily_grid g JOIN grid_cells c ON c.y = g.y AND c.x = g.x CROSS JOIN met_axes
    JOIN met_daily m ON m.time = g.time
      AND m.i = least(greatest(CAST(floor((c.lat - lat0) / dlat + 5e-1) AS INT), 0), ni - 1)
      AND m.j = least(greatest(CAST(floor((c.lon - lon0) / dlon + 5e-1) AS INT), 0), nj - 1)
    JOIN monitor_days d ON d.time = g.time""")
def _(t):
    lon_axis, lat_axis = met_axes(t)
    located = t.daily_grid.join(t.grid_cells.select("y", "x", "lat", "lon"), ["y", "x"])
    weather = matching.nearest_node_join(located, t.met_daily, lon_axis, lat_axis, ["time"], ["t2m", "blh"], how="inner")
    monitor_days = if_small(site_days(t).groupBy("time").agg(F.avg("value").alias("PM25")))
    return rounded(weather.join(monitor_days, "time")
                   .select("time", "y", "x", "AOD", "t2m", "blh", "PM25"))


@register("days_with_data", """
    SELECT time, y, x, n_snapshots FROM daily_grid
    WHERE time IN (SELECT time FROM daily_grid GROUP BY 1 HAVING count(AOD) > 0)""")
def _(t):
    days = if_small(t.daily_grid.filter(F.col("AOD").isNotNull()).select("time").distinct())
    return t.daily_grid.join(days, "time", "left_semi").select("time", "y", "x", "n_snapshots")


@register("nearest_node_join", f"""WITH {MET_AXES}, {SITE_DAYS}
    SELECT s.time, latitude, longitude, round(value, 6) AS value, m.i, m.j, round(t2m, 6) AS t2m
    FROM site_days s CROSS JOIN met_axes JOIN met_daily m ON m.time = s.time
      AND m.i = least(greatest(CAST(floor((latitude - lat0) / dlat + 5e-1) AS INT), 0), ni - 1)
      AND m.j = least(greatest(CAST(floor((longitude - lon0) / dlon + 5e-1) AS INT), 0), nj - 1)""")
def _(t):
    lon_axis, lat_axis = met_axes(t)
    joined = matching.nearest_node_join(site_days(t), t.met_daily, lon_axis, lat_axis, ["time"], ["t2m"],
                                        "longitude", "latitude", how="inner")
    return rounded(joined.select("time", "latitude", "longitude", "value", "i", "j", "t2m"))


@register("nearest_node_and_time", f"""WITH {MET_AXES}, {SITE_DAYS}, days AS (SELECT DISTINCT time AS node_time FROM met_daily),
    low AS (SELECT s.*, d.node_time AS lo FROM site_days s ASOF LEFT JOIN days d ON s.time >= d.node_time),
    both_sides AS (SELECT l.*, d.node_time AS hi FROM low l ASOF LEFT JOIN days d ON l.time <= d.node_time),
    near AS (SELECT * EXCLUDE (lo, hi), CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo
        WHEN time - lo < hi - time THEN lo ELSE hi END AS node_time FROM both_sides)
    SELECT n.time, node_time, latitude, longitude, round(value, 6) AS value, round(t2m, 6) AS t2m
    FROM near n CROSS JOIN met_axes LEFT JOIN met_daily m ON m.time = node_time
      AND m.i = least(greatest(CAST(floor((latitude - lat0) / dlat + 5e-1) AS INT), 0), ni - 1)
      AND m.j = least(greatest(CAST(floor((longitude - lon0) / dlon + 5e-1) AS INT), 0), nj - 1)""")
def _(t):
    lon_axis, lat_axis = met_axes(t)
    joined = matching.nearest_node_and_time(site_days(t), t.met_daily, lon_axis, lat_axis, ["t2m"], "time", "longitude", "latitude")
    return rounded(joined.select("time", "node_time", "latitude", "longitude", "value", "t2m"))


@register("nearest_axis_asof", """
    WITH sites AS (SELECT DISTINCT latitude FROM monitors),
    axis AS (SELECT DISTINCT lat * lat / 5e1 AS node FROM met_daily),
    before AS (SELECT latitude, node AS lo FROM sites ASOF LEFT JOIN axis ON latitude >= node),
    both_sides AS (SELECT latitude, lo, node AS hi FROM before ASOF LEFT JOIN axis ON latitude <= node)
    SELECT latitude, round(CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL THEN lo
                                WHEN latitude - lo < hi - latitude THEN lo ELSE hi END, 6) AS node FROM both_sides""")
def _(t):
    axis = t.met_daily.select((F.col("lat") * F.col("lat") / 50.0).alias("node"))
    sites = t.monitors.select("latitude").distinct()
    return rounded(matching.nearest_on_axis(sites, axis, "latitude", "node"))


PARAMETERS = ["wind", "temperature", "humidity"]
READINGS = "CASE POC % 3 WHEN 0 THEN 'wind' WHEN 1 THEN 'temperature' ELSE 'humidity' END"


def met_readings(t):
    poc = F.col("POC") % 3
    name = F.when(poc == 0, "wind").when(poc == 1, "temperature").otherwise("humidity")
    return t.monitors.withColumn("parameter", name)


@register("join_met_parameters", f"""WITH {SITE_DAYS}, readings AS (SELECT *, {READINGS} AS parameter FROM monitors)
    SELECT s.time, s.latitude, s.longitude, round(avg(r.value) FILTER (parameter = 'wind'), 6) AS wind,
           round(avg(r.value) FILTER (parameter = 'temperature'), 6) AS temperature,
           round(avg(r.value) FILTER (parameter = 'humidity'), 6) AS humidity
    FROM site_days s LEFT JOIN readings r ON r.time = s.time AND r.latitude = s.latitude AND r.longitude = s.longitude
    GROUP BY 1, 2, 3""")
def _(t):
    joined = matching.join_parameters(site_days(t).drop("value"), met_readings(t), ["time", "latitude", "longitude"],
                                      "parameter", "value", PARAMETERS)
    return rounded(joined)


@register("pivot_parameters", f"""
    SELECT site_name, time, round(avg(value) FILTER ({READINGS} = 'wind'), 6) AS wind,
           round(avg(value) FILTER ({READINGS} = 'temperature'), 6) AS temperature,
           round(avg(value) FILTER ({READINGS} = 'humidity'), 6) AS humidity
    FROM monitors GROUP BY 1, 2""")
def _(t):
    return rounded(met_readings(t).groupBy("site_name", "time").pivot("parameter", PARAMETERS).agg(F.avg("value")))


@register("outer_align", f"""WITH {DAILY}
    SELECT time, y, x, round(g.AOD, 6) AS grid_aod, round(d.AOD, 6) AS snapshot_aod
    FROM daily_grid g FULL JOIN daily d USING (time, y, x)""")
def _(t):
    grid = t.daily_grid.select("time", "y", "x", F.col("AOD").alias("grid_aod"))
    other = daily(t).select("time", "y", "x", F.col("AOD").alias("snapshot_aod"))
    return rounded(grid.join(other, ["time", "y", "x"], "full"))


# two products that overlap and together hold every row
PRODUCT_A = "SELECT time, lat, lon, avg(DUSMASS25) * 1e9 AS dust, avg(BCSMASS) * 1e9 AS carbon FROM aerosol WHERE lat < 4 GROUP BY 1, 2, 3"
PRODUCT_B = "SELECT time, lat, lon, avg(SSSMASS25) * 1e9 AS salt FROM aerosol WHERE lon > 0 OR lat >= 4 GROUP BY 1, 2, 3"


@register("merge_products", f"""WITH a AS ({PRODUCT_A}), b AS ({PRODUCT_B})
    SELECT time, lat, lon, round(dust, 6) AS dust, round(carbon, 6) AS carbon, round(salt, 6) AS salt
    FROM a FULL JOIN b USING (time, lat, lon)""")
def _(t):
    def product(df, columns):
        return df.groupBy("time", "lat", "lon").agg(*[(F.avg(c) * 1e9).alias(n) for c, n in columns.items()])

    first = product(t.aerosol.filter("lat < 4"), {"DUSMASS25": "dust", "BCSMASS": "carbon"})
    second = product(t.aerosol.filter("lon > 0 OR lat >= 4"), {"SSSMASS25": "salt", "SO4SMASS": "carbon"})
    return rounded(matching.merge_products([first, second], ["time", "lat", "lon"]))


@register("semi_join_keys", """
    SELECT time, latitude, longitude, round(value, 6) AS value FROM monitors m
    WHERE EXISTS (SELECT 1 FROM events e WHERE CAST(e.ts AS DATE) = m.time AND e.event_type = 'error'
                  AND e.user_id % 24 + 25.25e0 = m.latitude)""")
def _(t):
    seen = t.events.filter("event_type = 'error'").select(
        F.to_date("ts").alias("time"), (F.col("user_id") % 24 + 25.25).alias("latitude")).distinct()
    return rounded(t.monitors.join(seen, ["time", "latitude"], "left_semi")
                   .select("time", "latitude", "longitude", "value"))


@register("anti_join_keys", """
    SELECT DISTINCT latitude, longitude FROM monitors m
    WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'error' AND e.user_id % 24 + 25.25e0 = m.latitude
                      AND -119.6e0 + e.event_id % 47 = m.longitude)""")
def _(t):
    seen = t.events.filter("event_type = 'error'").select(
        (F.col("user_id") % 24 + 25.25).alias("latitude"), (F.lit(-119.6) + F.col("event_id") % 47).alias("longitude"))
    return t.monitors.select("latitude", "longitude").distinct().join(seen, ["latitude", "longitude"], "left_anti")


@register("distinct_sites", "SELECT DISTINCT latitude, longitude, site_name, state_name FROM monitors")
def _(t):
    return t.monitors.select("latitude", "longitude", "site_name", "state_name").distinct()


@register("site_key", """
    SELECT latitude, longitude, CAST(latitude AS VARCHAR) || ',' || CAST(longitude AS VARCHAR) AS site,
           count(*) AS n_readings FROM monitors GROUP BY 1, 2""")
def _(t):
    counted = t.monitors.groupBy("latitude", "longitude").agg(F.count("*").alias("n_readings"))
    return counted.withColumn("site", text.site_key(F.col("latitude"), F.col("longitude")))


@register("multi_instrument_sites", """
    SELECT latitude, longitude, site_name, count(DISTINCT POC) AS n_instruments FROM monitors
    GROUP BY 1, 2, 3 HAVING count(DISTINCT POC) > 3""")
def _(t):
    # distinct pairs first: no task ever holds the instruments of a site as a set
    pairs = t.monitors.select("latitude", "longitude", "site_name", "POC").distinct()
    return (pairs.groupBy("latitude", "longitude", "site_name").agg(F.count("POC").alias("n_instruments"))
            .filter("n_instruments > 3"))


@register("instrument_spread", """
    WITH per AS (SELECT latitude, longitude, time, POC, avg(value) AS value FROM monitors WHERE value >= 0 GROUP BY 1, 2, 3, 4),
    site AS (SELECT latitude, longitude, time, avg(value) AS mean_value FROM per GROUP BY 1, 2, 3)
    SELECT latitude, longitude, time, round(any_value(mean_value), 6) AS mean_value, count(*) AS n_instruments,
           round(max(abs(value - mean_value)), 6) AS max_deviation
    FROM per JOIN site USING (latitude, longitude, time) GROUP BY 1, 2, 3""")
def _(t):
    per = masking.valid_readings(t.monitors).groupBy("latitude", "longitude", "time", "POC").agg(
        F.avg("value").alias("value"))
    # the largest deviation from the mean is at the largest or the smallest instrument
    spread = F.greatest(F.max("value") - F.avg("value"), F.avg("value") - F.min("value"))
    return rounded(per.groupBy("latitude", "longitude", "time").agg(
        F.avg("value").alias("mean_value"), F.count("*").alias("n_instruments"), spread.alias("max_deviation")))


FILE_NAMES = """files AS (
  SELECT DISTINCT 'A1.B2.' || strftime(l_shipdate, '%Y%j') || '.v1.h' || lpad(CAST(8 + l_suppkey % 6 AS VARCHAR), 2, '0')
         || 'v' || lpad(CAST(3 + l_partkey % 4 AS VARCHAR), 2, '0') || '.x' AS file_name FROM lineitem)"""


def tile_files(t):
    name = F.format_string("A1.B2.%s.v1.h%02dv%02d.x", F.date_format("l_shipdate", "yyyyDDD"),
                           8 + F.col("l_suppkey") % 6, 3 + F.col("l_partkey") % 4)
    return t.lineitem.select(name.alias("file_name")).distinct()


@register("tile_from_filename", f"""WITH {FILE_NAMES}, tiles AS (
      SELECT file_name, split_part(file_name, '.', 5) AS tile FROM files)
    SELECT file_name, tile, CAST(substr(tile, 2, 2) AS INT) AS tile_h, CAST(substr(tile, 5) AS INT) AS tile_v FROM tiles""")
def _(t):
    named = tile_files(t).withColumn("tile", text.field(F.col("file_name"), 4))
    tile_h, tile_v = projection.parse_tile(F.col("tile"))
    return named.withColumns({"tile_h": tile_h, "tile_v": tile_v})


@register("files_for_tiles", f"""WITH {FILE_NAMES}, sites AS (SELECT DISTINCT latitude AS lat, longitude AS lon FROM monitors),
    wanted AS (SELECT DISTINCT printf('h%02dv%02d',
        CAST(floor((6371007.181e0 * radians(lon) * cos(radians(lat)) + 20015109.354e0) / 1111950e0) AS INT),
        CAST(floor((10007554.677e0 - 6371007.181e0 * radians(lat)) / 1111950e0) AS INT)) AS tile FROM sites)
    SELECT file_name, split_part(file_name, '.', 5) AS tile FROM files
    WHERE split_part(file_name, '.', 5) IN (SELECT tile FROM wanted)""")
def _(t):
    files = tile_files(t).withColumn("tile", text.field(F.col("file_name"), 4))
    return matching.files_for_tiles(files, t.monitors, "longitude", "latitude")


@register("files_with_rows_in_window", """
    SELECT site_name AS file FROM monitors GROUP BY 1
    HAVING bool_or(time > DATE '2024-01-28' AND time < DATE '2024-01-30' AND value > 1e2)""")
def _(t):
    inside = (F.col("time") > F.lit("2024-01-28")) & (F.col("time") < F.lit("2024-01-30")) & (F.col("value") > 100)
    return (t.monitors.groupBy(F.col("site_name").alias("file")).agg(F.bool_or(inside).alias("hit"))
            .filter("hit").select("file"))


@register("first_row_per_file", """
    SELECT CAST(user_id AS VARCHAR) || '.txt' AS file, min_by(event_type, event_id) AS event_type,
           min_by(ts, event_id) AS ts, min(event_id) AS pos FROM events GROUP BY 1""")
def _(t):
    return (t.events.groupBy(F.concat(F.col("user_id").cast("string"), F.lit(".txt")).alias("file"))
            .agg(F.min_by(F.struct("event_type", "ts", F.col("event_id").alias("pos")), "event_id").alias("first"))
            .select("file", "first.*"))


@register("focal_mean", f"""WITH {CELL_AXES},
    projected AS ({to_geostationary("(SELECT DISTINCT latitude, longitude FROM monitors)", "longitude", "latitude", -75.0, "latitude, longitude")}),
    pts AS (SELECT DISTINCT CAST(floor((y_m - y0) / dy + 5e-1) AS INT) AS py, CAST(floor((x_m - x0) / dx + 5e-1) AS INT) AS px, nx, ny
            FROM projected, cell_axes)
    SELECT py AS point_y, px AS point_x, g.time, round(avg(AOD), 6) AS AOD
    FROM pts JOIN daily_grid g ON g.y BETWEEN py - 3 AND py + 3 AND g.x BETWEEN px - 3 AND px + 3
    WHERE py BETWEEN 0 AND ny - 1 AND px BETWEEN 0 AND nx - 1 GROUP BY 1, 2, 3 HAVING count(AOD) > 0""")
def _(t):
    return rounded(matching.focal_mean(monitor_cells(t), t.daily_grid, ["AOD"]))


def monitor_cells(t):
    """Distinct grid cells that hold a monitor."""
    x_axis, y_axis = cell_axes(t)
    sites = matching.with_projected(t.monitors.select("latitude", "longitude").distinct(), EAST_VIEW, "longitude", "latitude")
    placed = matching.with_nearest_cell(sites, x_axis, y_axis, float("inf"))
    return placed.dropna(subset=["cell_y"]).select(F.col("cell_y").alias("y"), F.col("cell_x").alias("x")).distinct()


@register("focal_has_data", """
    SELECT DISTINCT c.y, c.x FROM grid_cells c JOIN daily_grid g
      ON g.y BETWEEN c.y - 3 AND c.y + 3 AND g.x BETWEEN c.x - 3 AND c.x + 3
    WHERE g.AOD IS NOT NULL AND g.n_snapshots > 1""")
def _(t):
    filled = t.daily_grid.withColumn("AOD", F.when(F.col("n_snapshots") > 1, F.col("AOD")))
    return matching.focal_has_data(t.grid_cells, filled, "AOD")


@register("densify_grid", """
    WITH days AS (SELECT DISTINCT time FROM daily_grid)
    SELECT days.time, c.y, c.x, round(AOD, 6) AS AOD, n_snapshots
    FROM days CROSS JOIN grid_cells c LEFT JOIN daily_grid g ON g.time = days.time AND g.y = c.y AND g.x = c.x""")
def _(t):
    return rounded(matching.densify_grid(t.daily_grid, t.grid_cells.select("y", "x"))
                   .select("time", "y", "x", "AOD", "n_snapshots"))


@register("column_footprint", """
    SELECT variable, n_values, n_values * width AS n_bytes FROM (
      SELECT unnest(['time', 'y', 'x', 'AOD', 'n_snapshots']) AS variable,
             unnest([count(time), count(y), count(x), count(AOD), count(n_snapshots)]) AS n_values,
             unnest([4, 4, 4, 8, 8]) AS width FROM daily_grid)""")
def _(t):
    return masking.column_footprint(t.daily_grid, {"time": 4, "y": 4, "x": 4, "AOD": 8, "n_snapshots": 8})


@register("pending_partitions", """
    WITH done AS (SELECT DISTINCT time FROM daily_grid WHERE n_snapshots >= 4)
    SELECT DISTINCT CAST(ts AS DATE) AS time FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT time FROM done)""")
def _(t):
    wanted = t.events.select(F.to_date("ts").alias("time")).distinct()
    return sinks.pending(wanted, t.daily_grid.filter("n_snapshots >= 4"), ["time"])
