"""Joins between series of equal and of different resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.clock import DEFAULT_TZ, utc_to_local
from tidemark.operators.buckets import time_slots
from tidemark.operators.gaps import bfill
from tidemark.operators.keyed import keyed_join, require_keys


def join_price_generation(prices: DataFrame, generation: DataFrame, on: str = "datetime") -> DataFrame:
    """Inner join on the instant; callers that need rows check with ``require_rows``."""
    return prices.join(generation, on, "inner")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail if nothing is left; looks at one row only."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")
    return df


def join_drivers(prices: DataFrame, drivers: DataFrame, on: str = "datetime") -> DataFrame:
    """Inner join that keeps complete rows only."""
    return prices.join(drivers, on, "inner").dropna()


def join_feature_store(
    prices: DataFrame,
    generation: DataFrame,
    demand: DataFrame,
    reservoirs: DataFrame,
    weather: DataFrame,
    barra: str | None = None,
    region: str | None = None,
    tz: str = DEFAULT_TZ,
) -> DataFrame:
    """Hourly wide table: every price row, with whatever the other tables know about its hour.

    Slow tables match on the local calendar date. Weather is that of ``region``, which must be given:
    without it a price row would meet the weather of every region.
    """
    if region is None:
        raise ValueError("region must be given")
    base = prices if barra is None else prices.where(F.col("barra") == barra)
    base = base.withColumn("datetime_local", utc_to_local(F.col("datetime"), tz)).withColumn(
        "date_local", F.to_date("datetime_local")
    )
    sky = weather.where(F.col("region") == region)
    levels = reservoirs.select(F.col("date").alias("date_local"), F.col("energy_gwh").alias("reservoir_gwh"))
    sky = sky.select(F.col("date").alias("date_local"), "temp_max_c", "precip_mm")
    wide = (
        base.join(generation, "datetime", "left")
        .join(demand, "datetime", "left")
        .join(levels, "date_local", "left")
        .join(sky, "date_local", "left")
    )
    generated = [c for c in generation.columns if c != "datetime"]
    return wide.select(
        "datetime", "datetime_local", "date_local", "barra", "cmg_usd_mwh",
        F.col("is_imputed").alias("cmg_is_imputed"), *generated, "demand_mw", "reservoir_gwh", "temp_max_c", "precip_mm",
    )


def join_eda(prices: DataFrame, generation: DataFrame, weather: DataFrame, region: str) -> DataFrame:
    """Prices with generation of the same hour and weather of the same UTC date."""
    sky = weather.where(F.col("region") == region).select(F.col("date").alias("_date"), "temp_max_c")
    return (
        prices.join(generation, "datetime", "left")
        .withColumn("_date", F.to_date("datetime"))
        .join(sky, "_date", "left")
        .drop("_date")
    )


def _with_next_time(slow: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``_to``, the time of the next row of the same key after ``_from``.

    Inside a clock slot a window says so; for a slot's last row it is the first time of the next slot
    that has rows, which comes from one summary row per slot. Without keys these summaries are one
    array, as long as the slow table has slots.
    """
    slotted = time_slots(slow, "_from")
    inside = F.lead("_from").over(W.partitionBy(*keys, "_slot").orderBy("_from"))
    firsts = slotted.groupBy(*keys, "_slot").agg(F.min("_from").alias("_first"))
    if keys:
        after = F.lead("_first").over(W.partitionBy(*keys).orderBy("_slot"))
        summary = firsts.select(*keys, "_slot", after.alias("_after"))
        placed = keyed_join(slotted.withColumn("_to", inside), summary, [*keys, "_slot"])
    else:
        every = firsts.agg(F.array_sort(F.collect_list(F.struct("_slot", "_first")))).scalar()
        later = F.get(F.filter("_every", lambda s: s["_slot"] > F.col("_slot")), F.lit(0))
        placed = slotted.withColumns({"_to": inside, "_every": every}).withColumn("_after", later["_first"])
    return placed.withColumn("_to", F.coalesce("_to", "_after")).drop("_slot", "_after", "_every")


def asof_ffill(
    fast: DataFrame,
    slow: DataFrame,
    keys: Sequence[str],
    fast_ts: str,
    slow_ts: str,
    cols: Sequence[str],
    bfill_missing: bool = False,
    series_keys: Sequence[str] | None = None,
) -> DataFrame:
    """For each fast row the latest slow row at or before it, as a left join.

    Each slow row is valid until the next one. Its validity is cut into calendar days up to the
    last slow day, and a fast row looks up its own day or, past the end, that last day. So this
    is an equi-join on (keys, day) with the exact bounds as a residual condition, and only the
    slow side is looked at twice. A matched slow row counts even if its value is NULL.
    ``bfill_missing`` then fills what is still NULL from the next fast row of the same series,
    which looks into the future. Two slow rows of one key at one time are an error.

    ``keys`` may be empty when one slow series serves all fast rows; then at most one slow row
    per time is allowed, so the slow side is bounded by its time span.
    """
    keys = list(keys)
    moment, at = F.col(slow_ts).cast("timestamp"), F.col(fast_ts).cast("timestamp")
    last_day = slow.agg(F.to_date(F.max(moment))).scalar()
    spans = _with_next_time(slow.select(*keys, moment.alias("_from"), *cols), keys)
    twice = F.raise_error(F.lit("several slow rows of one key at one time"))
    spans = spans.withColumn("_to", F.when(F.col("_to") == F.col("_from"), twice.cast("timestamp")).otherwise(F.col("_to")))
    until = F.coalesce(F.to_date("_to"), last_day)
    days = spans.withColumn("_day", F.explode(F.sequence(F.to_date("_from"), until, F.expr("INTERVAL 1 DAY"))))
    names = {k: f"__{k}" for k in keys}
    days = days.withColumnsRenamed(names)
    matches: Column = F.least(F.to_date(at), last_day) == F.col("_day")
    for k, n in names.items():
        matches &= F.col(k) == F.col(n)
    matches &= (F.col("_from") <= at) & (F.col("_to").isNull() | (at < F.col("_to")))
    joined = fast.join(days, matches, "left").drop("_day", "_from", "_to", *names.values())
    if bfill_missing:
        joined = bfill(joined, series_keys or require_keys(keys), fast_ts, cols)
    return joined


def lookup_holiday(
    df: DataFrame, date: str, holidays: DataFrame, name: str = "is_holiday", years: tuple[int, int] | None = None
) -> DataFrame:
    """True where the date occurs in the holiday table's ``date`` column.

    The table covers ``years`` (first and last), or from its first to its last year; a date outside
    is an error, since it is not known whether it is a holiday. NULL dates are none.
    """
    days = holidays.select(F.col("date").cast("date").alias("_holiday")).distinct()
    if years is None:
        known = holidays.agg(F.struct(F.min(F.year("date")).alias("first"), F.max(F.year("date")).alias("last"))).scalar()
        first, last = known["first"], known["last"]
    else:
        first, last = map(F.lit, years)
    at = F.year(F.col(date))
    unknown = F.raise_error(F.concat(F.lit("no holidays are known for the year "), at.cast("string"))).cast("boolean")
    covered = at.isNull() | F.coalesce(at.between(first, last), F.lit(False))
    return df.join(days, F.col(date) == F.col("_holiday"), "left").withColumn(
        name, F.when(covered, F.col("_holiday").isNotNull()).otherwise(unknown)
    ).drop("_holiday")


def anti_existing(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the target yet."""
    return df.join(target.select(*keys), require_keys(keys), "left_anti")


def reindex_domain(df: DataFrame, keys: Sequence[str], column: str, first: int, last: int) -> DataFrame:
    """Give every key a row for each integer of the domain; missing cells are NULL.

    A key has one row per integer at most, so its rows fit into one map, from which the domain is
    read back; the input is read once. Integers outside the domain are left out.
    """
    keys = require_keys(keys)
    kind = df.schema[column].dataType
    rest = [c for c in df.columns if c not in keys and c != column]
    at = F.col(column).cast("int")
    cell = F.struct(at.alias("at"), F.struct(*rest).alias("row") if rest else F.lit(0).alias("row"))
    cells = F.map_from_entries(F.collect_list(F.when(at.between(first, last), cell))).alias("_cells")
    every = df.groupBy(*keys).agg(cells).withColumn("_at", F.explode(F.sequence(F.lit(first), F.lit(last))))
    found = F.try_element_at("_cells", F.col("_at"))
    made = {column: F.col("_at").cast(kind)} | {c: found[c] for c in rest}
    return every.select(*[F.col(c) if c in keys else made[c].alias(c) for c in df.columns])


def regularize_hourly(df: DataFrame, keys: Sequence[str], ts: str, step_hours: int = 1) -> DataFrame:
    """Insert the missing hours between each key's first and last row, with NULL values.

    Hours are generated slot by slot, so a long series is spread over many tasks.
    """
    keys = require_keys(keys)
    slot = 2160 * step_hours
    at = F.col(ts).cast("timestamp")
    ends = df.groupBy(*keys).agg(F.min(at).alias("_min"), F.max(at).alias("_max"))
    jump = F.make_dt_interval(hours=F.lit(slot))
    step = F.make_dt_interval(hours=F.lit(step_hours))
    starts = ends.withColumn("_start", F.explode(F.sequence("_min", "_max", jump))).repartition(*keys, "_start")
    stop = F.least(F.col("_max"), F.col("_start") + jump - step)
    grid = starts.select(*keys, F.explode(F.sequence("_start", stop, step)).alias(ts))
    grid = grid.withColumn(ts, F.col(ts).cast(df.schema[ts].dataType))
    return keyed_join(grid, df, [*keys, ts], "left").select(*df.columns)


def align_actuals(predictions: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of the observed values onto predictions."""
    return keyed_join(predictions, actuals, require_keys(keys), "left")
