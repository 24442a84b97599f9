"""Quality masks, filters and value preparation on observation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions import optics

SNAPSHOT_VARIABLES = {"AOD": "double", "AE1": "double", "DQF": "int", "AE_DQF": "int"}


def quality_mask(snapshots: DataFrame) -> DataFrame:
    """Set failing depths and exponents to null; the rows stay."""
    return snapshots.withColumns({
        "AOD": optics.masked_by_quality(F.col("AOD"), F.col("DQF"), F.col("n_flags")),
        "AE1": optics.masked_by_exponent_quality(F.col("AE1"), F.col("AE_DQF")),
    })


def select_optional(df: DataFrame, keys: Sequence[str], variables: dict[str, str]) -> DataFrame:
    """A fixed set of columns: variables the input lacks come out as typed nulls."""
    present = set(df.columns)
    return df.select(*keys, *[
        (F.col(v) if v in present else F.lit(None)).cast(t).alias(v) for v, t in variables.items()
    ])


def valid_readings(df: DataFrame, value: str = "value", strict: bool = False) -> DataFrame:
    """Rows with a reading of at least zero (above zero when ``strict``); nulls go."""
    return df.filter(F.col(value) > 0 if strict else F.col(value) >= 0)


def within(column: str, low: float, high: float, inclusive: bool = True) -> Column:
    c = F.col(column)
    return c.between(low, high) if inclusive else (c > low) & (c < high)


def bounding_box(df: DataFrame, x: str, y: str, box: tuple[float, float, float, float],
                 inclusive: bool = True) -> DataFrame:
    """Rows inside ``(west, south, east, north)``."""
    west, south, east, north = box
    return df.filter(within(x, west, east, inclusive) & within(y, south, north, inclusive))


def time_slice(df: DataFrame, time: str, start: str, end: str) -> DataFrame:
    """Rows from the start day to the end day, the whole of both."""
    after = F.date_add(F.lit(end).cast("date"), 1)
    return df.filter((F.col(time) >= F.lit(start).cast("date")) & (F.col(time) < after))


def year_slice(df: DataFrame, time: str, year: int) -> DataFrame:
    """One calendar year, as a range so that it reaches the scan."""
    return df.filter((F.col(time) >= F.make_date(F.lit(year), F.lit(1), F.lit(1)))
                     & (F.col(time) < F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))))


def normalise_monitors(df: DataFrame, names: dict[str, str], keep: Sequence[str]) -> DataFrame:
    """Rename to the engine's names and keep only the listed columns."""
    return df.withColumnsRenamed(names).select(*keep)


def scale_columns(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(k) for c, k in factors.items()})


def log_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Natural logs; a row with any value that has none is dropped."""
    return df.withColumns({c: optics.positive_log(F.col(c)) for c in columns}).dropna("any", subset=list(columns))


def with_tile(df: DataFrame, y: str = "y", x: str = "x", side: int = 500) -> DataFrame:
    """Block index of each cell: the partition key for cell-wise work."""
    return df.withColumns({"tile_y": F.floor(F.col(y) / side).cast("int"),
                           "tile_x": F.floor(F.col(x) / side).cast("int")})


def column_footprint(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Bytes of non-missing values per column, in one pass over the table."""
    counted = df.agg(*[F.count(c).alias(c) for c in widths])
    stacked = ", ".join(f"'{c}', `{c}`, {w}" for c, w in widths.items())
    return counted.selectExpr(f"stack({len(widths)}, {stacked}) AS (variable, n_values, width)").select(
        "variable", "n_values", (F.col("n_values") * F.col("width")).alias("n_bytes"))


def attach_metadata(df: DataFrame, attributes: dict[str, dict]) -> DataFrame:
    """Hang units, long names and the like on columns; they travel with the schema."""
    for column, metadata in attributes.items():
        df = df.withMetadata(column, {**df.schema[column].metadata, **metadata})
    return df


def copy_metadata(df: DataFrame, sources: Sequence[DataFrame]) -> DataFrame:
    """Give each column the attributes of the first source that has it."""
    found: dict[str, dict] = {}
    for source in sources:
        for f in source.schema.fields:
            if f.metadata:
                found.setdefault(f.name, f.metadata)
    return attach_metadata(df, {c: m for c, m in found.items() if c in df.columns})
