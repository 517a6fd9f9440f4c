"""Bounded window partitions.

A window partitioned by the series key alone puts a whole series into one task, which fails
once one series holds a large share of the data. Every ordered operator here instead works on
(key, bucket), where a bucket is a bounded stretch of the series:

* ``time_slots``: stretches of clock time. On a grid (unique key and time, fixed step) their
  size is bounded by the slot length.
* ``row_stretches``: stretches of row positions, for frames counted in rows over series with
  holes. Rows shortly before a boundary are copied to the next stretch, so each row occurs at
  most twice, and the copies are dropped after the window has run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.keyed import require_keys

HOUR = 3600
SLOT_HOURS = 2160
STRETCH_ROWS = 4096


def epoch(ts: str) -> Column:
    """Whole seconds since 1970."""
    return F.col(ts).cast("timestamp").cast("long")


def series_of(keys: Sequence[str]) -> Column:
    """The keys in one value that is never NULL, even if keys are.

    Plain equality then joins NULL keys too, and unlike null-safe equality it can use the
    partitioning that a window on the same columns has just made.
    """
    return F.struct(*require_keys(keys))


def time_slots(df: DataFrame, ts: str, slot_hours: int = SLOT_HOURS) -> DataFrame:
    """Add ``_slot``, the number of the clock stretch."""
    return df.withColumn("_slot", F.floor(epoch(ts) / F.lit(slot_hours * HOUR)).cast("long"))


def numbered_in_slots(
    df: DataFrame, keys: Sequence[str], ts: str, slot_hours: int = SLOT_HOURS
) -> DataFrame:
    """Add ``_series``, ``_slot`` and ``_rn``, the 1-based row number within (keys, slot)."""
    w = W.partitionBy("_series", "_slot").orderBy(ts)
    return time_slots(df, ts, slot_hours).withColumn("_series", series_of(keys)).withColumn("_rn", F.row_number().over(w))


def row_positions(
    df: DataFrame, keys: Sequence[str], ts: str, slot_hours: int = SLOT_HOURS, rows_of: DataFrame | None = None
) -> DataFrame:
    """Add ``_pos``, the 0-based position of the row in its series.

    Only the row counts per slot are summed along the series; the rows themselves are never
    brought together. ``rows_of`` is any frame with the same keys and times that is cheaper to
    count, such as the stored table ``df`` was computed from.
    """
    numbered = numbered_in_slots(df, keys, ts, slot_hours)
    counted = time_slots((rows_of or df).select(series_of(keys).alias("_series"), ts), ts, slot_hours)
    sizes = counted.groupBy("_series", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_series").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_series", "_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    placed = numbered.join(offsets, ["_series", "_slot"]).withColumn("_pos", F.col("_before") + F.col("_rn") - 1)
    return placed.select(*df.columns, "_pos")


def over_rows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    reach: int,
    *stages: Callable[[W], dict[str, Column]],
    rows_of: DataFrame | None = None,
    slot_hours: int = SLOT_HOURS,
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """Add window columns whose frames look back at most ``reach`` rows.

    Each stage receives the ordered window and returns the named expressions to add; later
    stages may use the columns of earlier ones, all within the one shuffle. For ``rows_of`` see
    ``row_positions``.
    """
    keys = require_keys(keys)
    size = max(stretch_rows, 8 * reach)
    home = F.floor(F.col("_pos") / F.lit(size)).cast("long")
    near_end = F.col("_pos") % F.lit(size) >= F.lit(size - reach)
    copied = (
        row_positions(df, keys, ts, slot_hours, rows_of)
        .withColumn("_home", home)
        .withColumn("_stretch", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home))))
    )
    window = W.partitionBy(*keys, "_stretch").orderBy("_pos")
    for stage in stages:
        copied = copied.withColumns(stage(window))
    return copied.where(F.col("_stretch") == F.col("_home")).drop("_pos", "_home", "_stretch")


def over_hours(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    reach: int,
    *stages: Callable[[W], dict[str, Column]],
    slot_hours: int = SLOT_HOURS,
) -> DataFrame:
    """Add window columns whose frames look back at most ``reach`` hours.

    The window handed to each stage is ordered by epoch seconds, for range frames. One
    shuffle, because a clock slot follows from the row alone.
    """
    keys = require_keys(keys)
    hours = max(slot_hours, 8 * reach)
    near_end = (F.col("_slot") + 1) * F.lit(hours * HOUR) - F.col("_sec") <= F.lit(reach * HOUR)
    copied = (
        time_slots(df, ts, hours)
        .withColumn("_sec", epoch(ts))
        .withColumn(
            "_target",
            F.explode(F.when(near_end, F.array("_slot", F.col("_slot") + 1)).otherwise(F.array("_slot"))),
        )
    )
    window = W.partitionBy(*keys, "_target").orderBy("_sec")
    for stage in stages:
        copied = copied.withColumns(stage(window))
    return copied.where(F.col("_target") == F.col("_slot")).drop("_sec", "_slot", "_target")
