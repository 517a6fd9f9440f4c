"""Numeric clean-up expressions. NULL is the only missing marker downstream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.clock import DEFAULT_TZ, utc_to_local

NIGHT_FROM = 21
NIGHT_UNTIL = 6


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def null_if_negative(c: Column) -> Column:
    return F.when(c >= 0, c)


def zero_at_night(
    c: Column, ts: Column, tz: str = DEFAULT_TZ, night_from: int = NIGHT_FROM, night_until: int = NIGHT_UNTIL
) -> Column:
    """0 from ``night_from`` until before ``night_until`` local time, replacing NULL as well."""
    hour = F.hour(utc_to_local(ts, tz))
    return F.when((hour >= night_from) | (hour < night_until), F.lit(0.0)).otherwise(c)


def row_sum(cols: Sequence[Column], min_count: int = 0) -> Column:
    """Sum across columns with NULL as 0; NULL if fewer than ``min_count`` are present."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])
    if min_count <= 0:
        return total
    present = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])
    return F.when(present >= min_count, total)


def round_to(c: Column, digits: int) -> Column:
    """Half-to-even rounding."""
    return F.bround(c, digits)


def is_finite(c: Column) -> Column:
    """True for a number, false for NULL, NaN and infinities."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def signed_error(actual: Column, predicted: Column) -> Column:
    return predicted - actual


def abs_error(actual: Column, predicted: Column) -> Column:
    return F.abs(predicted - actual)
