"""Incremental forms of the averages, the rejects and the scoring.

The source is a folder of files.  Each run takes what is new and stops
(``availableNow``); the checkpoint remembers what has been done, so a finished
file is never read twice and a run that died is taken up again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid import schemas
from airgrid.operators import masking, temporal
from airgrid.operators.binding import if_small


def snapshot_stream(spark: SparkSession, path: str, schema: str = schemas.SNAPSHOTS, time: str = "t",
                    files_per_batch: int | None = None) -> DataFrame:
    """Snapshot files as a stream; event time gets a zone, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).withColumn(time, F.col(time).cast("timestamp"))


def hourly_stream(snapshots: DataFrame, delay: str = "2 hours", keys: Sequence[str] = ("y", "x")) -> DataFrame:
    """Hourly averages; in append mode an hour comes out once, when the watermark has passed it."""
    masked = masking.quality_mask(snapshots).withWatermark("t", delay)
    return (temporal.with_target_depth(masked).groupBy(F.window("t", "1 hour"), *keys)
            .agg(F.avg("AOD").alias("AOD"), F.avg("AOD470").alias("AOD470"),
                 temporal.observation_count("AOD").alias("n_snapshots"))
            .select(F.col("window.start").alias("t"), *keys, "AOD", "AOD470", "n_snapshots"))


def end_series(spark: SparkSession, path: str, schema: str, time: str = "t", end: str = "9999-01-01 00:00:00") -> None:
    """Add a row of nulls with a far time to a series that has ended: the next run then brings the hours still open.

    What comes after it is late, so a stream that is to go on must not be ended.
    """
    fields = spark.createDataFrame([], schema).schema
    row = spark.range(1).select(*[F.lit(end if f.name == time else None).cast(f.dataType).alias(f.name) for f in fields])
    row.write.mode("append").parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> None:
    """Append everything available to a file table and stop."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format("parquet").start(path).awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch available to ``each`` and stop."""
    (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
     .start().awaitTermination())


def daily_from_hourly(spark: SparkSession, hourly_path: str, hourly_schema: str, daily_path: str, checkpoint: str) -> None:
    """Keep daily averages up to date with a growing table of hours.

    For the days a batch touches, the whole day is averaged again from the
    hourly table, partitioned by ``day``, and its partition replaced.  Doing a
    batch twice gives the same partitions.
    """
    hours = spark.readStream.schema(hourly_schema).parquet(hourly_path)

    def update(batch: DataFrame, _: int) -> None:
        touched = [r[0] for r in batch.select("day").distinct().collect()]  # days of one batch
        if not touched:
            return
        whole = spark.read.schema(hourly_schema).parquet(hourly_path).filter(F.col("day").isin(touched))
        daily = temporal.daily_weighted_average(whole).withColumn("day", F.col("time"))
        (daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(daily_path))

    run_batches(hours, update, checkpoint)


def split_late(spark: SparkSession, snapshots: DataFrame, accepted_path: str, rejects_path: str, checkpoint: str,
               delay: str = "2 hours") -> None:
    """Send rows that come too late, or whose time is damaged, to a rejects table.

    A row is late when its time is more than ``delay`` before the latest time of
    the batches before its own.  Each batch writes its own partition, so doing it
    twice replaces what it wrote.
    """
    seen_path = f"{rejects_path}-seen"

    def split(batch: DataFrame, batch_id: int) -> None:
        seen = None
        if batch_id > 0:
            seen = (spark.read.schema("latest timestamp, batch bigint").parquet(seen_path)
                    .filter(F.col("batch") < batch_id).agg(F.max("latest").cast("string")).first()[0])
        kept = batch.persist()
        damaged = F.year("t") == 2000
        late = F.lit(False) if seen is None else F.col("t") < F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        reason = F.when(damaged, "bad_time").when(late, "late")
        marked = kept.withColumns({"reason": reason, "batch": F.lit(batch_id)})

        def write(rows: DataFrame, path: str) -> None:
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))

        write(marked.filter("reason IS NULL").drop("reason"), accepted_path)
        write(marked.filter("reason IS NOT NULL"), rejects_path)
        write(marked.filter("reason IS NULL").agg(F.max("t").alias("latest")).withColumn("batch", F.lit(batch_id)), seen_path)
        kept.unpersist()

    run_batches(snapshots, split, checkpoint)


def scored_stream(observations: DataFrame, cells: DataFrame, score: Callable[[DataFrame], DataFrame], inputs: Sequence[str],
                  outputs: Sequence[str]) -> DataFrame:
    """Join a stream to the static cell table and score its complete rows with a fitted model's transform.

    Rows that lack an input, or a cell, stay with null ``outputs``.  Adaptive plans do not split skewed keys in a stream,
    so the cell table is broadcast if it is measured to be small.
    """
    placed = observations.join(if_small(cells), ["y", "x"], "left")
    whole = F.lit(True)
    for c in inputs:
        whole = whole & F.col(c).isNotNull()
    kept = placed.columns
    rest = placed.filter(~whole).select(*kept, *[F.lit(None).cast("double").alias(o) for o in outputs])
    return score(placed.filter(whole)).select(*kept, *outputs).unionByName(rest)
