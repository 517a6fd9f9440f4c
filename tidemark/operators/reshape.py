"""Wide to long and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import reindex_domain


def unpivot_hours(
    df: DataFrame, ids: Sequence[str], value_cols: Sequence[str], label: str = "hora_col", value: str = "mw"
) -> DataFrame:
    """One row per hour column."""
    return df.unpivot(list(ids), list(value_cols), label, value)


def pivot_category(
    df: DataFrame, by: Sequence[str], category: str, value: str, values: Sequence[str]
) -> DataFrame:
    """Sum per category as columns, from a fixed list, in one aggregation.

    A category without rows stays NULL.
    """
    sums = [F.sum(F.when(F.col(category) == v, F.col(value))).alias(v) for v in values]
    return df.groupBy(*by).agg(*sums)


def pivot_heatmap(
    df: DataFrame, keys: Sequence[str], row: str, column: str, value: str,
    rows: tuple[int, int] = (0, 23), columns: tuple[int, int] = (1, 12), prefix: str = "m",
) -> DataFrame:
    """Mean per (row, column) cell as a full matrix for every key; empty cells NULL."""
    cells = [
        F.avg(F.when(F.col(column) == c, F.col(value))).alias(f"{prefix}{c}")
        for c in range(columns[0], columns[1] + 1)
    ]
    return reindex_domain(df.groupBy(*keys, row).agg(*cells), keys, row, *rows)


def explode_arrays(df: DataFrame, arrays: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Parallel arrays to rows, matched by position."""
    return df.select(*keep, F.inline(F.arrays_zip(*arrays)))
