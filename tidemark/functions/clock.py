"""Clock arithmetic. The session zone must be UTC (see ``session.prepare``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TZ = "America/Santiago"


def hour24_to_ts(date: Column, hour: Column) -> Column:
    """Date plus 1-24 hour label -> local wall time at the start of that hour."""
    return date.cast("timestamp_ntz") + F.make_dt_interval(hours=hour.cast("int") - 1)


def local_to_utc(c: Column, tz: str = DEFAULT_TZ) -> Column:
    """Local wall time -> instant.

    A repeated hour is read as daylight-saving time and a skipped whole hour moves forward.
    A skipped half-hour moves forward by the size of the gap.
    """
    return F.to_utc_timestamp(c.cast("timestamp"), tz)


def utc_to_local(c: Column, tz: str = DEFAULT_TZ) -> Column:
    """Instant -> local wall time; feed it to ``hour``, ``month`` and so on."""
    return F.from_utc_timestamp(c.cast("timestamp"), tz)


def normalize_utc(c: Column) -> Column:
    """Text with any offset, naive text or naive timestamp -> instant; naive means UTC."""
    return c.try_cast("timestamp")


def weekday_of(c: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(c)


def is_weekend(c: Column) -> Column:
    return F.weekday(c) >= 5


def month_floor(c: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(c, "MM")


def year_of(c: Column) -> Column:
    return F.year(c)
