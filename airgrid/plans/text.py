"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, so that summation order does not show."""
    return df.withColumns({
        f.name: F.round(f.name, special.get(f.name, digits))
        for f in df.schema.fields if f.dataType.typeName() in ("double", "float")
    })
