"""Column expressions: Column in, Column out, all inside whole-stage codegen."""

from tidemark.functions.clock import (
    hour24_to_ts,
    is_weekend,
    local_to_utc,
    month_floor,
    normalize_utc,
    utc_to_local,
    weekday_of,
    year_of,
)
from tidemark.functions.numeric import (
    abs_error,
    is_finite,
    nan_to_null,
    null_if_negative,
    round_to,
    row_sum,
    signed_error,
    zero_at_night,
)
from tidemark.functions.parsing import parse_date_strict, parse_decimal_comma, regex_hour, tidy

__all__ = [
    "abs_error",
    "hour24_to_ts",
    "is_finite",
    "is_weekend",
    "local_to_utc",
    "month_floor",
    "nan_to_null",
    "normalize_utc",
    "null_if_negative",
    "parse_date_strict",
    "parse_decimal_comma",
    "regex_hour",
    "round_to",
    "row_sum",
    "signed_error",
    "tidy",
    "utc_to_local",
    "weekday_of",
    "year_of",
    "zero_at_night",
]
