"""Queries over snapshots and predictions along time."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid.functions import calendar, optics
from airgrid.operators import masking, temporal
from airgrid.plans.catalog import register
from airgrid.plans.text import rounded

MASKED = """masked AS (
  SELECT event_id, t, sat, y, x,
         CASE WHEN (n_flags = 4 AND DQF < 2) OR (n_flags <> 4 AND DQF = 0) THEN AOD END AS AOD,
         CASE WHEN AE_DQF < 2 THEN AE1 END AS AE1
  FROM snapshots)"""
HOURLY = MASKED + """, hourly AS (
  SELECT date_trunc('hour', t) AS t, y, x, avg(AOD) AS AOD,
         avg(AOD * pow(470e0 / 550e0, -AE1)) AS AOD470, nullif(count(AOD), 0) AS n_snapshots
  FROM masked GROUP BY 1, 2, 3)"""
DAILY = HOURLY + """, daily AS (
  SELECT CAST(t AS DATE) AS time, y, x, sum(n_snapshots * AOD) / sum(n_snapshots) AS AOD,
         sum(n_snapshots * AOD470) / sum(CASE WHEN AOD470 IS NOT NULL THEN n_snapshots END) AS AOD470,
         CAST(sum(n_snapshots) AS BIGINT) AS n_snapshots
  FROM hourly GROUP BY 1, 2, 3)"""


def hourly(t):
    return temporal.hourly_average(masking.quality_mask(t.snapshots))


def daily(t):
    return temporal.daily_weighted_average(hourly(t))


@register("quality_mask", f"WITH {MASKED} SELECT * FROM masked")
def _(t):
    return masking.quality_mask(t.snapshots).select("event_id", "t", "sat", "y", "x", "AOD", "AE1")


@register("select_optional_vars", """
    SELECT t, y, x, AOD, CAST(NULL AS DOUBLE) AS AE1, DQF, CAST(NULL AS INT) AS AE_DQF FROM snapshots""")
def _(t):
    without = t.snapshots.drop("AE1", "AE_DQF")
    return masking.select_optional(without, ["t", "y", "x"], masking.SNAPSHOT_VARIABLES)


@register("angstrom_interpolate", """
    SELECT event_id, round(AOD * pow(470e0 / 550e0, -AE1), 6) AS AOD470,
           round(AOD * pow(550e0 / 675e0, -AE1), 6) AS AOD_550 FROM snapshots""")
def _(t):
    depth, exponent = F.col("AOD"), F.col("AE1")
    return rounded(t.snapshots.select(
        "event_id",
        optics.to_wavelength(depth, exponent, optics.REFERENCE_NM, optics.TARGET_NM).alias("AOD470"),
        optics.to_wavelength(depth, exponent, optics.PHOTOMETER_NM, optics.REFERENCE_NM).alias("AOD_550")))


@register("hourly_average", f"""WITH {HOURLY}
    SELECT t, y, x, round(AOD, 6) AS AOD, round(AOD470, 6) AS AOD470, n_snapshots FROM hourly""")
def _(t):
    return rounded(hourly(t))


@register("daily_weighted_average", f"""WITH {DAILY}
    SELECT time, y, x, round(AOD, 6) AS AOD, n_snapshots FROM daily""")
def _(t):
    return rounded(temporal.daily_weighted_average(hourly(t), values=["AOD"]))


@register("daily_weighted_average_partial", f"""WITH {DAILY}
    SELECT time, y, x, round(AOD470, 6) AS AOD470 FROM daily""")
def _(t):
    return rounded(daily(t).select("time", "y", "x", "AOD470"))


@register("angstrom_exponent", f"""WITH {DAILY}
    SELECT time, y, x, round(CASE WHEN AOD470 / AOD > 0 THEN -ln(AOD470 / AOD) / ln(470e0 / 550e0) END, 6) AS AE
    FROM daily""")
def _(t):
    return rounded(daily(t).select("time", "y", "x", optics.exponent_between(
        F.col("AOD470"), F.col("AOD"), optics.TARGET_NM, optics.REFERENCE_NM).alias("AE")))


@register("daily_mean", """
    SELECT CAST(t AS DATE) AS t, y, x, round(avg(AOD), 6) AS AOD, round(avg(AE1), 6) AS AE1
    FROM snapshots GROUP BY 1, 2, 3""")
def _(t):
    return rounded(temporal.resample_mean(t.snapshots, "t", "day", ["y", "x"], ["AOD", "AE1"]))


PRED = ["linear", "forest", "trees"]
PRED_AVG = "round(avg(linear), 6) AS linear, round(avg(forest), 6) AS forest, round(avg(trees), 6) AS trees"


@register("monthly_mean", f"SELECT last_day(time) AS time, y, x, {PRED_AVG} FROM pred_grid GROUP BY 1, 2, 3")
def _(t):
    return rounded(temporal.resample_mean(t.pred_grid, "time", "month", ["y", "x"], PRED))


@register("yearly_mean", f"""
    SELECT CAST(year(time) AS INT) AS time, y, x, {PRED_AVG} FROM pred_grid GROUP BY 1, 2, 3""")
def _(t):
    return rounded(temporal.resample_mean(t.pred_grid, "time", "year", ["y", "x"], PRED))


@register("nday_mean", f"""
    WITH origin AS (SELECT min(time) AS first_day FROM pred_grid)
    SELECT first_day + CAST(((time - first_day) // 2) * 2 AS INT) AS time, y, x, {PRED_AVG}
    FROM pred_grid, origin GROUP BY 1, 2, 3""")
def _(t):
    return rounded(temporal.resample_mean(t.pred_grid, "time", "2 days", ["y", "x"], PRED))


@register("seasonal_weighted_mean", """
    WITH monthly AS (
      SELECT last_day(time) AS time, y, x, avg(linear) AS linear, avg(trees) AS trees FROM pred_grid GROUP BY 1, 2, 3),
    axis AS (
      SELECT CAST(unnest(generate_series(date_trunc('month', (SELECT min(time) FROM monthly)),
                                         (SELECT max(time) FROM monthly), INTERVAL 1 MONTH)) AS DATE) AS m),
    days AS (SELECT (month(m) % 12) // 3 AS s, sum(day(last_day(m))) AS season_days FROM axis GROUP BY 1),
    w AS (SELECT monthly.*, s, day(time) / season_days AS weight
          FROM monthly JOIN days ON s = (month(time) % 12) // 3)
    SELECT CASE s WHEN 0 THEN 'DJF' WHEN 1 THEN 'MAM' WHEN 2 THEN 'JJA' ELSE 'SON' END AS season, y, x,
           round(nullif(sum(linear * weight), 0), 6) AS linear, round(nullif(sum(trees * weight), 0), 6) AS trees
    FROM w GROUP BY s, y, x""")
def _(t):
    monthly = temporal.resample_mean(t.pred_grid, "time", "month", ["y", "x"], ["linear", "trees"])
    return rounded(temporal.seasonal_weighted_mean(monthly, "time", ["y", "x"], ["linear", "trees"]))


@register("resample_dense", f"""WITH {HOURLY},
    spine AS (SELECT unnest(generate_series((SELECT min(t) FROM hourly), (SELECT max(t) FROM hourly),
                                            INTERVAL 1 HOUR)) AS t),
    cells AS (SELECT DISTINCT y, x FROM hourly)
    SELECT spine.t, cells.y, cells.x, round(AOD, 6) AS AOD, n_snapshots
    FROM spine CROSS JOIN cells LEFT JOIN hourly ON hourly.t = spine.t AND hourly.y = cells.y AND hourly.x = cells.x""")
def _(t):
    return rounded(temporal.densify_time(hourly(t).drop("AOD470"), "t", "1 HOUR", ["y", "x"]))


@register("mean_timestamp", """
    SELECT CAST(t AS DATE) AS day, y, x,
           date_trunc('second', make_timestamp(CAST(floor(avg(epoch_us(t))) AS BIGINT))) AS mean_t
    FROM snapshots GROUP BY 1, 2, 3""")
def _(t):
    grouped = t.snapshots.groupBy(F.to_date("t").alias("day"), "y", "x").agg(
        calendar.mean_timestamp(F.col("t")).alias("mean_t"))
    return grouped.withColumn("mean_t", F.date_trunc("second", "mean_t").cast("timestamp_ntz"))


@register("time_slice", """
    SELECT event_id, t, AOD FROM snapshots WHERE t >= TIMESTAMP '2024-01-05' AND t < TIMESTAMP '2024-01-13'""")
def _(t):
    return masking.time_slice(t.snapshots, "t", "2024-01-05", "2024-01-12").select("event_id", "t", "AOD")


@register("year_slice", """
    SELECT time, y, x, round(linear, 6) AS linear FROM pred_grid WHERE year(time) = 1998""")
def _(t):
    return rounded(masking.year_slice(t.pred_grid, "time", 1998).select("time", "y", "x", "linear"))


@register("quarters_with_data", """
    WITH quarters AS (SELECT DISTINCT date_trunc('quarter', time) AS q FROM pred_grid)
    SELECT y, x, CAST(q AS DATE) AS quarter_start,
           bool_or(time > q AND time < q + INTERVAL 3 MONTH AND trees IS NOT NULL) AS has_data
    FROM pred_grid JOIN quarters ON date_trunc('quarter', time) = q GROUP BY 1, 2, 3""")
def _(t):
    start = F.trunc("time", "quarter")
    inside = (F.col("time") > start) & (F.col("time") < F.add_months(start, 3)) & F.col("trees").isNotNull()
    return t.pred_grid.groupBy("y", "x", start.alias("quarter_start")).agg(F.bool_or(inside).alias("has_data"))


@register("calendar_features", """
    SELECT l_orderkey, l_linenumber, l_partkey, time, CAST(year(time) AS INT) AS year, CAST(month(time) AS INT) AS month,
           CAST(dayofyear(time) AS INT) AS day_of_year, CAST(day(last_day(time)) AS INT) AS days_in_month,
           make_date(year(time), 1, 1) + CAST(dayofyear(time) - 1 AS INT) AS from_day_number
    FROM features""")
def _(t):
    return t.features.select(
        "l_orderkey", "l_linenumber", "l_partkey", "time", F.year("time").alias("year"), F.month("time").alias("month"),
        F.dayofyear("time").alias("day_of_year"), calendar.days_in_month(F.col("time")).alias("days_in_month"),
        calendar.date_of_day_number(F.year("time"), F.dayofyear("time")).alias("from_day_number"))


@register("date_spine", """
    WITH spans AS (SELECT user_id, date_trunc('hour', min(ts)) AS first_hour, date_trunc('hour', max(ts)) AS last_hour
                   FROM events GROUP BY 1),
    hours AS (SELECT user_id, first_hour, last_hour,
                     unnest(generate_series(first_hour, last_hour, INTERVAL 1 HOUR)) AS time FROM spans)
    SELECT user_id, time, CAST(date_diff('hour', first_hour, time) // 6 AS BIGINT) AS chunk
    FROM hours WHERE time < last_hour""")
def _(t):
    hour = calendar.hour_start(F.col("ts"))
    spans = t.events.groupBy("user_id").agg(F.min(hour).alias("first_hour"), F.max(hour).alias("last_hour"))
    spine = temporal.date_spine(F.col("first_hour"), F.col("last_hour"), "1 HOUR", spans, inclusive="left")
    position = F.timestamp_diff("HOUR", F.col("first_hour"), F.col("time"))
    return spine.select("user_id", "time", F.floor(position / 6).alias("chunk"))


@register("parse_site_timestamps", """
    SELECT event_id, try_strptime(d || ' ' || c, '%d:%m:%Y %H:%M:%S') AS t
    FROM (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'n/a' ELSE strftime(ts, '%d:%m:%Y') END AS d,
                 strftime(ts, '%H:%M:%S') AS c FROM events)""")
def _(t):
    text = t.events.select(
        "event_id", F.when(F.col("event_id") % 17 == 0, "n/a").otherwise(F.date_format("ts", "dd:MM:yyyy")).alias("d"),
        F.date_format("ts", "HH:mm:ss").alias("c"))
    return text.select("event_id", calendar.site_timestamp(F.col("d"), F.col("c")).cast("timestamp_ntz").alias("t"))


@register("parse_orbit_timestamps", """
    SELECT y, x, day, chunk, CAST(pos AS INT) AS orbit, strptime(left(stamp, 11), '%Y%j%H%M') AS t FROM (
      SELECT y, x, day, chunk, unnest(string_split(stamps, '  ')) AS stamp, generate_subscripts(string_split(stamps, '  '), 1) - 1 AS pos
      FROM (SELECT y, x, CAST(t AS DATE) AS day, event_id // 200 AS chunk,
                   string_agg(strftime(t, '%Y%j%H%M') || CASE sat WHEN 16 THEN 'T' ELSE 'A' END, '  ' ORDER BY event_id) AS stamps
            FROM snapshots GROUP BY 1, 2, 3, 4))""")
def _(t):
    stamp = F.concat(F.date_format("t", "yyyyDDDHHmm"), F.when(F.col("sat") == 16, "T").otherwise("A"))
    # the file attribute is a short list: at most as many stamps as a chunk of snapshots
    chunk = F.floor(F.col("event_id") / 200).alias("chunk")
    lists = t.snapshots.groupBy("y", "x", F.to_date("t").alias("day"), chunk).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", stamp.alias("s")))), lambda s: s["s"]),
                     "  ").alias("stamps"))
    parts = lists.select("y", "x", "day", "chunk", F.posexplode(F.split("stamps", "  ")).alias("orbit", "stamp"))
    return parts.select("y", "x", "day", "chunk", "orbit",
                        calendar.orbit_timestamp(F.col("stamp")).cast("timestamp_ntz").alias("t"))


@register("union_satellites", """
    SELECT sat, CAST(t AS DATE) AS day, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(AOD) AS BIGINT) AS n_depths,
           CAST(count(AE1) FILTER (sat = 16) AS BIGINT) AS n_exponents
    FROM snapshots GROUP BY 1, 2""")
def _(t):
    first = t.snapshots.filter("sat = 16")
    second = t.snapshots.filter("sat = 17").drop("AE1")
    return temporal.union_all([first, second]).groupBy("sat", F.to_date("t").alias("day")).agg(
        F.count("*").alias("n_rows"), F.count("AOD").alias("n_depths"), F.count("AE1").alias("n_exponents"))


@register("observation_count", """
    SELECT y, x, nullif(count(linear), 0) AS linear, nullif(count(trees), 0) AS trees FROM pred_grid GROUP BY 1, 2""")
def _(t):
    return t.pred_grid.groupBy("y", "x").agg(temporal.observation_count("linear").alias("linear"),
                                             temporal.observation_count("trees").alias("trees"))
