"""Streaming queries over the event table, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from airgrid import schemas
from airgrid.plans.catalog import register
from airgrid.plans.temporal_queries import DAILY, HOURLY
from airgrid.plans.text import rounded
from airgrid.session import scratch_path
from airgrid.streaming import incremental


def snapshot_days(t) -> str:
    """The snapshots as one folder of files per day, day by day in time order."""
    path = scratch_path(t.spark, "snapshot-days")
    t.snapshots.withColumn("day", F.to_date("t")).write.partitionBy("day").parquet(path)
    return path


def stream(t, files_per_batch=None):
    return incremental.snapshot_stream(t.spark, snapshot_days(t), files_per_batch=files_per_batch)


STREAMED = "t timestamp, y int, x int, AOD double, AOD470 double, n_snapshots bigint, day date"


def streamed_hours(t) -> str:
    """Hourly table written by the stream, partitioned by day: a run over the series, and one after its end."""
    days, path, checkpoint = snapshot_days(t), scratch_path(t.spark, "stream-hourly"), scratch_path(t.spark, "checkpoint")
    hours = incremental.hourly_stream(incremental.snapshot_stream(t.spark, days)).withColumn("day", F.to_date("t"))
    incremental.run_to_table(hours, path, checkpoint, ["day"])
    incremental.end_series(t.spark, f"{days}/day=9999-01-01", schemas.SNAPSHOTS)
    incremental.run_to_table(hours, path, checkpoint, ["day"])
    return path


@register("stream_hourly_average", f"""WITH {HOURLY}
    SELECT t, y, x, round(AOD, 6) AS AOD, round(AOD470, 6) AS AOD470, n_snapshots FROM hourly""")
def _(t):
    written = t.spark.read.schema(STREAMED).parquet(streamed_hours(t)).drop("day")
    return rounded(written.withColumn("t", F.col("t").cast("timestamp_ntz")))


@register("stream_daily_average", f"""WITH {DAILY}
    SELECT time, y, x, round(AOD, 6) AS AOD, round(AOD470, 6) AS AOD470, n_snapshots FROM daily""")
def _(t):
    path = scratch_path(t.spark, "stream-daily")
    incremental.daily_from_hourly(t.spark, streamed_hours(t), STREAMED, path, scratch_path(t.spark, "checkpoint"))
    return rounded(t.spark.read.parquet(path).select("time", "y", "x", "AOD", "AOD470", "n_snapshots"))


@register("stream_rejects", """
    WITH marked AS (SELECT event_id, t, event_id % 97 = 0 AS damaged, event_id % 89 = 0 AS held_back FROM snapshots),
    latest AS (SELECT max(t) AS last FROM marked WHERE NOT damaged AND NOT held_back)
    SELECT event_id, CASE WHEN damaged THEN 'bad_time'
        WHEN held_back AND t < date_trunc('microseconds', last) - INTERVAL 2 HOUR THEN 'late' ELSE 'good' END AS outcome
    FROM marked, latest""")
def _(t):
    # some rows are held back and arrive in a second run over the growing folder
    folder, accepted, rejects, checkpoint = (scratch_path(t.spark, n) for n in ("arriving", "accepted", "rejects", "checkpoint"))
    held_back = F.col("event_id") % 89 == 0
    for arriving in (t.snapshots.filter(~held_back), t.snapshots.filter(held_back)):
        arriving.write.mode("append").parquet(folder)
        broken = incremental.snapshot_stream(t.spark, folder).withColumn(
            "t", F.when(F.col("event_id") % 97 == 0, F.lit("2000-01-01 12:00:00").cast("timestamp")).otherwise(F.col("t")))
        incremental.split_late(t.spark, broken, accepted, rejects, checkpoint)
    good = t.spark.read.parquet(accepted).select("event_id", F.lit("good").alias("outcome"))
    return good.unionByName(t.spark.read.parquet(rejects).select("event_id", F.col("reason").alias("outcome")))


@register("stream_new_partitions", """
    SELECT CAST(ts AS DATE) AS day, count(*) AS n_events FROM events GROUP BY 1""")
def _(t):
    # two runs over a folder that grows in between: the second reads only what was added
    folder, out, checkpoint = (scratch_path(t.spark, n) for n in ("growing", "taken", "checkpoint"))
    days = t.events.select("event_id", F.to_date("ts").alias("day"))
    middle = F.lit("2024-01-16").cast("date")
    for part in (days.filter(F.col("day") < middle), days.filter(F.col("day") >= middle)):
        part.write.mode("append").parquet(folder)
        taken = t.spark.readStream.schema("event_id bigint, day date").parquet(folder)
        incremental.run_to_table(taken, out, checkpoint)
    return t.spark.read.parquet(out).groupBy("day").agg(F.count("*").alias("n_events"))
