"""Readers of station files, payloads and region files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid import schemas
from airgrid.functions import calendar, polygons
from airgrid.operators.binding import if_small


def scan_csv(spark: SparkSession, paths: str | Sequence[str], schema: str, glob: str | None = None,
             columns: Sequence[str] | None = None) -> DataFrame:
    """CSV files with a header and a known schema; only ``columns`` are parsed when given."""
    reader = spark.read.schema(schema).option("header", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob).option("recursiveFileLookup", True)
    df = reader.csv(paths if isinstance(paths, str) else list(paths))
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def scan_monitors(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Published daily monitor files in the engine's names."""
    return scan_csv(spark, paths, schemas.MONITOR_CSV).withColumnsRenamed(schemas.MONITOR_NAMES)


def scan_after_preamble(spark: SparkSession, paths: str | Sequence[str], schema: str, skip: int,
                        bad: str | None = None) -> DataFrame:
    """CSV whose first ``skip`` lines of every file (preamble and header) are not data.

    Line numbers within a scan task rise along a file, and a preamble is within
    the first block of its file; so the smallest number seen in that block marks
    the file's first line.  Bytes that are not UTF-8 are replaced.  The text of a
    line that does not fit the schema goes to column ``bad`` if one is named.
    """
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
        F.make_valid_utf8("value").alias("line"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))
    firsts = lines.filter("_block = 0").groupBy("file").agg(F.min("_n").alias("_first"))
    body = lines.join(if_small(firsts), "file").filter((F.col("_block") > 0) | (F.col("_n") >= F.col("_first") + skip))
    options = {"columnNameOfCorruptRecord": bad} if bad else {}
    parsed = F.from_csv("line", f"{schema}, {bad} string" if bad else schema, options)
    return body.select("file", parsed.alias("row")).select("file", "row.*")


def scan_csv_with_rejects(spark: SparkSession, paths: str | Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of headed CSV files that parse, and the file and text of the lines that do not."""
    lines = scan_after_preamble(spark, paths, schema, 1, bad="_bad")
    return lines.filter("_bad IS NULL").drop("_bad"), lines.filter("_bad IS NOT NULL").select("file", "_bad")


def scan_photometer(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Sun-photometer files: five preamble lines, a header, rows with day and clock text."""
    rows = scan_after_preamble(spark, paths, schemas.PHOTOMETER_CSV, 6).withColumnsRenamed(schemas.PHOTOMETER_NAMES)
    return rows.withColumn("t", calendar.site_timestamp(F.col("day"), F.col("clock"))).drop("day", "clock")


def explode_payload(spark: SparkSession, path: str, schema: str, field: str = "Data", lines: bool = False) -> DataFrame:
    """Landed service responses, one per file or one per line: one row per entry of the list ``field``."""
    payload = spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", not lines).json(path)
    return payload.select(F.inline(field))


def _features(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    if lines:
        return spark.read.schema(schemas.FEATURE).json(path)
    return spark.read.schema(schemas.GEOJSON).option("multiLine", True).json(path).select(F.inline("features"))


def load_regions(spark: SparkSession, path: str, name: str = "name", lines: bool = False) -> DataFrame:
    """Regions from GeoJSON, a feature collection per file or one feature per line: polygons of one or many parts, with holes."""
    features = _features(spark, path, lines)
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    parts = F.when(kind == "Polygon", F.from_json(text, schemas.RINGS["Polygon"])).when(
        kind == "MultiPolygon", F.flatten(F.from_json(text, schemas.RINGS["MultiPolygon"])))
    rings = F.transform(parts, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return features.filter(kind.isin(*schemas.RINGS)).select(
        F.col("properties")[name].alias("name"), "properties", polygons.outline(rings).alias("ring"))


def other_features(spark: SparkSession, path: str, name: str = "name", lines: bool = False) -> DataFrame:
    """Features that are no polygons, which ``load_regions`` can't take: name and type."""
    kind = F.col("geometry.type")
    return _features(spark, path, lines).filter(F.coalesce(~kind.isin(*schemas.RINGS), F.lit(True))).select(
        F.col("properties")[name].alias("name"), kind.alias("type"))
