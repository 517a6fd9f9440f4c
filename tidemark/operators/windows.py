"""Lags, rolling statistics, sequences and other row-order operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.buckets import HOUR, epoch, over_hours, over_rows
from tidemark.operators.keyed import keyed_join, require_keys, settled

# The feature names and the model inputs depend on them.
LAG_HOURS = (1, 2, 3, 6, 12, 24, 168)
ROLLING_HOURS = (24, 168)
SEQUENCE_ROWS = 168

Columns = Callable[[W], dict[str, Column]]


def _apply(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    reach: int,
    mode: str,
    stages: Sequence[Columns],
    rows_of: DataFrame | None = None,
) -> DataFrame:
    if mode == "rows":
        found = over_rows(df, keys, ts, reach, *stages, rows_of=rows_of)
    elif mode == "time":
        found = over_hours(df, keys, ts, reach, *stages)
    else:
        raise ValueError("mode must be 'rows' or 'time'")
    return found.drop(*[c for c in found.columns if c.startswith("_part")])


def _lag_columns(value: str, hours: Sequence[int], mode: str) -> Columns:
    def columns(w: W) -> dict[str, Column]:
        if mode == "rows":
            return {f"lag_{value}_{h}h": F.lag(value, h).over(w) for h in hours}
        return {f"lag_{value}_{h}h": F.max(value).over(w.rangeBetween(-h * HOUR, -h * HOUR)) for h in hours}

    return columns


def _rolling_stages(value: str, windows: Sequence[int], mode: str) -> list[Columns]:
    """Rolling mean and deviation, computing a long window from short ones where possible.

    A sliding frame is added up anew for every row. If a window is a multiple of the shortest
    one, its count, mean and squared deviations follow from those of the shortest window at this
    row and at equal steps back; combining them never subtracts, so nothing is lost to rounding.
    """
    base = min(windows)
    composed = [n for n in windows if n != base and n % base == 0 and mode == "rows"]
    direct = [n for n in windows if n not in composed]

    def names(n: int) -> tuple[str, str]:
        return f"rolling_mean_{value}_{n}h", f"rolling_std_{value}_{n}h"

    def direct_columns(w: W) -> dict[str, Column]:
        found = {}
        for n in direct:
            frame = w.rowsBetween(-n, -1) if mode == "rows" else w.rangeBetween(-n * HOUR, -1)
            mean, std = names(n)
            found |= {mean: F.avg(value).over(frame), std: F.stddev_samp(value).over(frame)}
            if n == base and composed:
                found["_part_n"] = F.count(value).over(frame)
        return found

    def moments(_: W) -> dict[str, Column]:
        mean, std = names(base)
        spread = f"coalesce(pow(`{std}`, 2) * (_part_n - 1), 0D)"
        known = f"named_struct('n', _part_n, 'mean', `{mean}`, 'm2', {spread})"
        return {"_part0": F.expr(f"CASE WHEN _part_n > 0 THEN {known} END")}

    def steps_back(w: W) -> dict[str, Column]:
        return {f"_part{j}": F.lag("_part0", base * j).over(w) for j in range(1, max(composed) // base)}

    def added(term: str, n: int, nothing: str) -> str:
        """Sum of a term over the parts of a window, where an absent part adds nothing."""
        return " + ".join(f"coalesce({term.format(p=f'_part{j}')}, {nothing})" for j in range(n // base))

    def means(_: W) -> dict[str, Column]:
        found = {}
        for n in composed:
            count = added("{p}.n", n, "0L")
            found[f"_part_n{n}"] = F.expr(count)
            found[names(n)[0]] = F.expr(f"({added('{p}.n * {p}.mean', n, '0D')}) / nullif({count}, 0L)")
        return found

    def deviations(_: W) -> dict[str, Column]:
        found = {}
        for n in composed:
            mean, std = names(n)
            m2 = added(f"{{p}}.m2 + {{p}}.n * pow({{p}}.mean - `{mean}`, 2)", n, "0D")
            found[std] = F.expr(f"CASE WHEN _part_n{n} > 1 THEN sqrt(({m2}) / (_part_n{n} - 1)) END")
        return found

    return [direct_columns, moments, steps_back, means, deviations] if composed else [direct_columns]


def _rolling_names(value: str, windows: Sequence[int]) -> list[str]:
    return [f"rolling_{stat}_{value}_{n}h" for n in windows for stat in ("mean", "std")]


def lags(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: Sequence[int] = LAG_HOURS, mode: str = "rows"
) -> DataFrame:
    """Earlier values as ``lag_{value}_{h}h``.

    ``rows`` counts rows back, whatever the holes; ``time`` looks up the row exactly ``h`` hours
    earlier. Times must be unique within a key.
    """
    return _apply(df, keys, ts, max(hours), mode, [_lag_columns(value, hours, mode)])


def rolling_stats(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, windows: Sequence[int] = ROLLING_HOURS, mode: str = "rows"
) -> DataFrame:
    """Mean and sample deviation of the preceding rows or hours, current row excluded."""
    found = _apply(df, keys, ts, max(windows), mode, _rolling_stages(value, windows, mode))
    return found.select(*df.columns, *_rolling_names(value, windows))


def lags_and_rolling(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    hours: Sequence[int] = LAG_HOURS,
    windows: Sequence[int] = ROLLING_HOURS,
    mode: str = "rows",
    rows_of: DataFrame | None = None,
) -> DataFrame:
    """Both of the above over one shared bucketing of the rows.

    ``rows_of`` may name a cheaper frame with the same keys and times.
    """
    stages = [_lag_columns(value, hours, mode), *_rolling_stages(value, windows, mode)]
    found = _apply(df, keys, ts, max(*hours, *windows), mode, stages, rows_of)
    lagged = [f"lag_{value}_{h}h" for h in hours]
    return found.select(*df.columns, *lagged, *_rolling_names(value, windows))


def imputer_lags(df: DataFrame, keys: Sequence[str], ts: str, value: str) -> DataFrame:
    """``lag_24h`` and ``lag_168h``, the lagged inputs of the imputation model."""
    return over_rows(
        df, keys, ts, 168, lambda w: {"lag_24h": F.lag(value, 24).over(w), "lag_168h": F.lag(value, 168).over(w)}
    )


def moving_average_full(df: DataFrame, keys: Sequence[str], ts: str, value: str, n: int = 30) -> DataFrame:
    """Mean of the last ``n`` days including this one; NULL unless all ``n`` have a value."""

    def columns(w: W) -> dict[str, Column]:
        frame = w.rangeBetween(-(n - 1) * 24 * HOUR, 0)
        return {f"moving_avg_{value}_{n}d": F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))}

    return over_hours(df, keys, ts, n * 24, columns, slot_hours=n * 24 * 16)


def sliding_sequences(
    df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str], target: str, n: int = SEQUENCE_ROWS
) -> DataFrame:
    """For each row with ``n`` predecessors: those rows as an array of structs, and its target.

    Holes in time are not looked at. To keep sets apart, put the split label among the keys.
    """

    def columns(w: W) -> dict[str, Column]:
        return {"sequence": F.collect_list(F.struct(*cols)).over(w.rowsBetween(-n, -1))}

    found = over_rows(df, keys, ts, n, columns)
    return found.where(F.size("sequence") == n).select(*keys, ts, "sequence", F.col(target).alias("target"))


def dedupe_first(df: DataFrame, keys: Sequence[str], tie_break: Sequence[str]) -> DataFrame:
    """One row per key: the one with the fewest NULLs, then the smallest by ``tie_break`` and the remaining columns.

    NULL is the largest value, so that an unreadable cell never takes the place of a known one.

    An aggregate rather than a ranking window: copies collapse before the shuffle, so a key
    with very many copies costs no more than any other.
    """
    keys = require_keys(keys)
    rest = [c for c in df.columns if c not in keys]
    ordered = [*[c for c in tie_break if c in rest], *[c for c in rest if c not in tie_break]]
    if not ordered:
        return df.select(*keys).distinct()
    holes = sum((F.col(c).isNull().cast("int") for c in rest if c not in tie_break), F.lit(0))
    order = [x for i, c in enumerate(ordered) for x in (F.col(c).isNull().alias(f"_null{i}"), F.col(c).alias(f"_cell{i}"))]
    first = df.groupBy(*keys).agg(F.min(F.struct(holes.alias("_holes"), *order)).alias("_first"))
    cells = {c: F.col(f"_first._cell{i}").alias(c) for i, c in enumerate(ordered)}
    return first.select(*[F.col(c) if c in keys else cells[c] for c in df.columns])


def first_n_days(df: DataFrame, keys: Sequence[str], ts: str, days: int = 30) -> DataFrame:
    """Rows up to ``days`` after the first of their key, both ends included."""
    starts = df.groupBy(*require_keys(keys)).agg(F.min(ts).alias("_start"))
    within = F.col(ts) <= F.col("_start") + F.make_dt_interval(days=F.lit(days))
    return keyed_join(df, settled(starts), keys).where(within).drop("_start")


def last_n_days(df: DataFrame, ts: str, days: int = 30) -> DataFrame:
    """Rows from ``days`` before the overall last one, both ends included."""
    newest = df.agg(F.max(ts)).scalar()
    return df.where(F.col(ts) >= newest - F.make_dt_interval(days=F.lit(days)))


__all__ = [
    "LAG_HOURS",
    "ROLLING_HOURS",
    "SEQUENCE_ROWS",
    "dedupe_first",
    "epoch",
    "first_n_days",
    "imputer_lags",
    "lags",
    "lags_and_rolling",
    "last_n_days",
    "moving_average_full",
    "rolling_stats",
    "sliding_sequences",
]
