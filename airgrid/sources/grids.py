"""Readers of gridded tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions.optics import null_nan
from airgrid.operators.temporal import union_all


def without_nan(df: DataFrame) -> DataFrame:
    """Missing values are null from here on."""
    return df.withColumns({f.name: null_nan(f.name) for f in df.schema.fields
                           if f.dataType.typeName() in ("double", "float")})


def scan_grid(spark: SparkSession, *paths: str, where: Column | None = None, nan: bool = True) -> DataFrame:
    """Grid files with missing values as null.

    ``where`` is a comparison, which missing values fail.  It is put to the files
    as it stands, so that they can skip what it rules out, and again once NaN is
    null.  Tables written by this engine hold no NaN and can be read with
    ``nan=False``; any filter then reaches the files.
    """
    table = spark.read.parquet(*paths)
    if not nan:
        return table if where is None else table.filter(where)
    return without_nan(table) if where is None else without_nan(table.filter(where)).filter(where)


def scan_merged(spark: SparkSession, path: str) -> DataFrame:
    """All files under ``path``; a variable some files lack is null there."""
    return without_nan(spark.read.option("mergeSchema", True).parquet(path))


def scan_each(spark: SparkSession, paths: Sequence[str], preprocess: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``preprocess`` on every source and stack the results."""
    return union_all([scan_grid(spark, p).transform(preprocess) for p in paths])


def scan_surviving(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The rows of the Parquet files under ``path`` that can be read, and the files that gave none.

    A file that can't be read costs its rows, not the job.  A readable file without rows is listed as well.
    """
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(path)
    given = rows.select(F.col("_metadata.file_path").alias("file")).distinct()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
    place = F.regexp_replace("file", "^file:/+", "/")
    return without_nan(rows), files.withColumn("file", place).join(given.withColumn("file", place), "file", "left_anti")


def scan_days(spark: SparkSession, path: str, start: str, stop: str) -> DataFrame:
    """Days ``start`` to ``stop`` of a table ``write_grid`` wrote by year and day of year; other partitions are not read."""
    first, last = F.to_date(F.lit(start)), F.to_date(F.lit(stop))
    key = F.col("year") * 1000 + F.col("doy")
    return scan_grid(spark, path, nan=False).filter(
        key.between(F.year(first) * 1000 + F.dayofyear(first), F.year(last) * 1000 + F.dayofyear(last)))


def split_rejects(df: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The good rows, and the bad ones with the first reason that applies to each."""
    reason = F.coalesce(*[F.when(test, name) for name, test in reasons.items()])
    marked = df.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def bad_time(t: str) -> Column:
    """The year a damaged file decodes to."""
    return F.year(t) == 2000
