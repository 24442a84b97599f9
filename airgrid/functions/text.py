"""Column expressions that build or read text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site_key(lat: Column, lon: Column) -> Column:
    return F.concat_ws(",", lat.cast("string"), lon.cast("string"))


def share_text(count: Column, share: Column) -> Column:
    """``count (share %)``, the share to one place, halves to the even digit."""
    return F.concat(count.cast("string"), F.lit(" ("), F.format_string("%.1f", F.rint(share * 10) / 10), F.lit(" %)"))


def change_text(value: Column, percent: Column) -> Column:
    """``value (percent%)``."""
    return F.format_string("%.2f (%.2f%%)", value, percent)


def field(text: Column, position: int, separator: str = r"\.") -> Column:
    """The ``position``-th (from 0) part of a separated name; null when there are fewer parts."""
    return F.get(F.split(text, separator), F.lit(position))


def hash_percent(*keys: Column) -> Column:
    """A number from 0 to 99 that depends on the keys alone, the same on every run."""
    text = F.concat_ws("-", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
