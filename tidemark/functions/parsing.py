"""Typing of raw text cells. Malformed text becomes NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
# Spark's own cast also takes Java suffixes ("1d") and the word NaN, which are not numbers here.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def tidy(c: Column) -> Column:
    """Strip blanks on both sides."""
    return F.trim(c, F.lit(BLANKS))


def parse_decimal_comma(c: Column) -> Column:
    """``"59,80"`` -> 59.8; a thousands separator or any other text -> NULL."""
    text = F.replace(tidy(c), F.lit(","), F.lit("."))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def parse_date_strict(c: Column, fmt: str) -> Column:
    """Date in exactly the given Spark pattern, otherwise NULL."""
    return F.try_to_timestamp(tidy(c), F.lit(fmt)).cast("date")


def regex_hour(c: Column) -> Column:
    """First run of digits of a label such as ``Hora 17``."""
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("int")
