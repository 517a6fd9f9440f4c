"""National holidays by date arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Holidays on a date of their own, as (month, day).
FIXED_DAYS = ((1, 1), (5, 1), (5, 21), (7, 16), (8, 15), (9, 18), (9, 19), (11, 1), (12, 8), (12, 25))
# Days before Easter Sunday.
EASTER_DAYS = (2, 1)
# Kept on a Monday: the one before if it falls on Tuesday to Thursday, the one after if on Friday.
MONDAY_DAYS = ((6, 29), (10, 12))
SOLSTICE_SINCE = 2021
REFORMATION_SINCE = 2008
BRIDGES_SINCE = 2007
LONG_BRIDGES_SINCE = 2017


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday."""

    def whole(a: Column, b: int) -> Column:
        return F.floor(a / b).cast("int")

    golden, century, rest = year % 19, whole(year, 100), year % 100
    moon = (golden * 19 + century - whole(century, 4) - whole(century - whole(century + 8, 25) + 1, 3) + 15) % 30
    weekday = (F.lit(32) + (century % 4) * 2 + whole(rest, 4) * 2 - moon - rest % 4) % 7
    late = whole(golden + moon * 11 + weekday * 22, 451)
    days = moon + weekday - late * 7 + 114
    return F.make_date(year, whole(days, 31), days % 31 + 1)


def winter_solstice(year: Column) -> Column:
    """Local date of the June solstice, from its mean instant; four hours behind UTC."""
    t = (year - 2000) / 1000
    julian = F.lit(2451716.56767) + t * 365241.62603 + t * t * 0.00325
    return F.date_add(F.lit("2000-01-01").cast("date"), F.floor(julian - 2451544.5 - 4 / 24).cast("int"))


def moved_to_monday(day: Column) -> Column:
    at = F.weekday(day)
    return F.when(at.between(1, 3), F.date_sub(day, at)).when(at == 4, F.date_add(day, 3)).otherwise(day)


def national_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(date) of Chile's national holidays in the years given, both included.

    Rules in force today, each from the year it was introduced: bridge days around 18 September and after
    New Year, the winter solstice, and Reformation Day, which moves from Tuesday and Wednesday to Friday. Days decreed for a
    single year are not rules; add them to the table.
    """
    year = F.col("year")

    def day(month: int, number: int) -> Column:
        return F.make_date(year, F.lit(month), F.lit(number))

    feast, new_year, reformation = F.weekday(day(9, 18)), F.weekday(day(1, 1)), F.weekday(day(10, 31))
    days = [day(m, d) for m, d in FIXED_DAYS]
    days += [F.date_sub(easter(year), n) for n in EASTER_DAYS]
    days += [moved_to_monday(day(m, d)) for m, d in MONDAY_DAYS]
    days += [
        # By law on the 21st in its first year.
        F.when(year == SOLSTICE_SINCE, day(6, 21)).when(year > SOLSTICE_SINCE, winter_solstice(year)),
        F.when(year >= REFORMATION_SINCE, F.when(reformation == 1, day(10, 27)).when(reformation == 2, day(11, 2)).otherwise(day(10, 31))),
        # The 17th is a bridge if it is a Monday, or a Friday; the 20th if it is a Friday.
        F.when((year >= BRIDGES_SINCE) & (feast == 1), day(9, 17)),
        F.when((year >= LONG_BRIDGES_SINCE) & (feast == 5), day(9, 17)),
        F.when((year >= BRIDGES_SINCE) & (feast == 2), day(9, 20)),
        F.when((year >= LONG_BRIDGES_SINCE) & (new_year == 6), day(1, 2)),
    ]
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return years.select(F.explode(F.array_distinct(F.array_compact(F.array(*days)))).alias("date"))
