"""Filling of missing values along a series.

The last known value before a slot, the next one after it and the number of rows before it
are taken from one summary row per (key, slot); inside a slot ordinary windows apply. So a
gap of any length is filled exactly although no window ever spans a whole series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.buckets import SLOT_HOURS, numbered_in_slots
from tidemark.operators.keyed import require_keys

FILL_LIMIT = 3


def _placed(position: str, value: str, known: str) -> Column:
    """(pos, val) where ``known`` is not NULL; position first, so that min and max go by it."""
    return F.expr(f"CASE WHEN {known} IS NOT NULL THEN named_struct('pos', {position}, 'val', {value}) END")


def _with_neighbours(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], slot_hours: int) -> DataFrame:
    """Add ``_pos``, ``_rows`` and, per column, structs ``_prev_c`` and ``_next_c`` of (pos, val).

    They hold the nearest non-NULL value at or before and at or after the row.
    """
    keys = require_keys(keys)
    numbered = numbered_in_slots(df, keys, ts, slot_hours)

    ends = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        cell = _placed("_rn", f"`{c}`", f"`{c}`")
        ends += [F.min(cell).alias(f"_first_{c}"), F.max(cell).alias(f"_last_{c}")]
    summary = numbered.groupBy("_series", "_slot").agg(*ends)

    along = W.partitionBy("_series").orderBy("_slot")
    back = W.partitionBy("_series").orderBy(F.col("_slot").desc())
    before = along.rowsBetween(W.unboundedPreceding, -1)
    summary = summary.withColumns(
        {
            "_off": F.coalesce(F.sum("_n").over(before), F.lit(0)),
            "_rows": F.sum("_n").over(W.partitionBy("_series")),
        }
    )

    def shifted(name: str) -> Column:
        return _placed(f"_off + `{name}`.pos", f"`{name}`.val", f"`{name}`")

    carried = {}
    for c in cols:
        carried[f"_carry_prev_{c}"] = F.last(shifted(f"_last_{c}"), ignorenulls=True).over(before)
        carried[f"_carry_next_{c}"] = F.last(shifted(f"_first_{c}"), ignorenulls=True).over(
            back.rowsBetween(W.unboundedPreceding, -1)
        )
    summary = summary.withColumns(carried).select("_series", "_slot", "_off", "_rows", *carried)

    joined = numbered.join(summary, ["_series", "_slot"]).withColumn("_pos", F.col("_off") + F.col("_rn"))
    ahead = W.partitionBy("_series", "_slot").orderBy("_rn").rowsBetween(W.unboundedPreceding, 0)
    behind = W.partitionBy("_series", "_slot").orderBy(F.col("_rn").desc()).rowsBetween(W.unboundedPreceding, 0)
    prev, nxt = {}, {}
    for c in cols:
        cell = _placed("_pos", f"`{c}`", f"`{c}`")
        prev[f"_prev_{c}"] = F.coalesce(F.last(cell, ignorenulls=True).over(ahead), F.col(f"_carry_prev_{c}"))
        nxt[f"_next_{c}"] = F.coalesce(F.last(cell, ignorenulls=True).over(behind), F.col(f"_carry_next_{c}"))
    return joined.withColumns(prev).withColumns(nxt)


def _tidy(df: DataFrame, original: DataFrame) -> DataFrame:
    return df.select(*original.columns)


def ffill(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], slot_hours: int = SLOT_HOURS) -> DataFrame:
    """Missing values take the last known one of their key."""
    near = _with_neighbours(df, keys, ts, cols, slot_hours)
    return _tidy(near.withColumns({c: F.col(f"_prev_{c}.val") for c in cols}), df)


def bfill(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], slot_hours: int = SLOT_HOURS) -> DataFrame:
    """Missing values take the next known one of their key."""
    near = _with_neighbours(df, keys, ts, cols, slot_hours)
    return _tidy(near.withColumns({c: F.col(f"_next_{c}.val") for c in cols}), df)


def interpolate_limited(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    cols: Sequence[str],
    limit: int | None = FILL_LIMIT,
    short_gaps_only: bool = False,
    slot_hours: int = SLOT_HOURS,
) -> DataFrame:
    """Linear interpolation by row position, forwards from the last known value.

    The first ``limit`` rows of every gap are filled, also of gaps that are longer; with
    ``short_gaps_only`` longer gaps stay as they are. A gap at the end repeats the last value
    under the same limit, a gap at the start stays. ``limit=None`` fills any length.
    """
    near = _with_neighbours(df, keys, ts, cols, slot_hours)
    filled = {}
    for c in cols:
        prev, nxt, pos = F.col(f"_prev_{c}"), F.col(f"_next_{c}"), F.col("_pos")
        step = pos - prev["pos"]
        value = F.when(nxt.isNull(), prev["val"]).otherwise(
            prev["val"] + (nxt["val"] - prev["val"]) * step / (nxt["pos"] - prev["pos"])
        )
        if limit is not None:
            length = F.coalesce(nxt["pos"], F.col("_rows") + 1) - prev["pos"] - 1
            value = F.when((length if short_gaps_only else step) <= limit, value)
        filled[c] = F.coalesce(F.col(c), value)
    return _tidy(near.withColumns(filled), df)


def interpolate_all(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """Unlimited interpolation, then the first known value for a gap at the start."""
    near = _with_neighbours(df, keys, ts, cols, SLOT_HOURS)
    filled = {}
    for c in cols:
        prev, nxt = F.col(f"_prev_{c}"), F.col(f"_next_{c}")
        line = prev["val"] + (nxt["val"] - prev["val"]) * (F.col("_pos") - prev["pos"]) / (nxt["pos"] - prev["pos"])
        filled[c] = F.coalesce(F.col(c), F.when(prev.isNotNull() & nxt.isNotNull(), line), prev["val"], nxt["val"])
    return _tidy(near.withColumns(filled), df)
