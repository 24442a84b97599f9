"""Column expressions over dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season of each month.
SEASON_MONTHS = {"winter": (12, 1, 2), "spring": (3, 4, 5), "summer": (6, 7, 8), "fall": (9, 10, 11)}
SEASON_CODES = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}


def _by_month(month: Column, table: dict[str, tuple[int, ...]]) -> Column:
    out = None
    for label, months in table.items():
        out = F.when(month.isin(*months), label) if out is None else out.when(month.isin(*months), label)
    return out


def season_label(date: Column) -> Column:
    return _by_month(F.month(date), SEASON_MONTHS)


def season_code(date: Column) -> Column:
    return _by_month(F.month(date), SEASON_CODES)


def days_in_month(date: Column) -> Column:
    return F.dayofmonth(F.last_day(date))


def date_of_day_number(year: Column, day_number: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), day_number.cast("int") - 1)


def nday_start(date: Column, anchor: Column, days: int) -> Column:
    """First day of the ``days``-long bin that holds ``date``, bins counted from ``anchor``."""
    offset = F.datediff(date, anchor)
    return F.date_add(anchor, (offset - F.pmod(offset, F.lit(days))).cast("int"))


def hour_start(t: Column) -> Column:
    """Start of the hour, in the type of ``t`` (with or without a zone)."""
    return F.window(t, "1 hour")["start"]


def mean_timestamp(t: Column) -> Column:
    """Aggregate: the mean instant of a group."""
    return F.timestamp_micros(F.avg(F.unix_micros(t.cast("timestamp"))).cast("bigint"))


def site_timestamp(day: Column, clock: Column) -> Column:
    """``dd:mm:yyyy`` and ``hh:mm:ss`` text to a timestamp; null when malformed."""
    return F.try_to_timestamp(F.concat_ws(" ", day, clock), F.lit("dd:MM:yyyy HH:mm:ss"))


def orbit_timestamp(text: Column) -> Column:
    """``yyyyDDDHHmm`` with a trailing platform letter to a timestamp; null when malformed."""
    return F.try_to_timestamp(F.substring(text, 1, 11), F.lit("yyyyDDDHHmm"))
