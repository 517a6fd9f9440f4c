"""Data-quality reports over whole frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_NULL_SHARE = 0.05


def data_quality(
    df: DataFrame, ts: str | None = "datetime", max_null: float = MAX_NULL_SHARE, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per check and column: rows concerned, share of all rows, and whether it passes.

    Checks: a column that is NULL throughout, a column with too many NULLs, times repeated within
    one of the ``keys``. A
    missing time column is reported as a passed ``no_time_column`` row, because it only warns.
    An empty frame passes the share check; its columns count as NULL throughout.
    """
    timed = bool(ts) and ts in df.columns
    counts = [F.count(F.lit(1)).alias("_rows")]
    counts += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_null_{i}") for i, c in enumerate(df.columns)]
    if timed:
        # As a struct, so that NULL keys and times count like any other.
        counts.append((F.count(F.lit(1)) - F.count_distinct(F.struct(*keys, ts))).alias("_repeats"))
    one = df.agg(*counts)
    rows = F.col("_rows")

    def line(check: str, column: str, n, passed):
        share = F.when(rows > 0, n / rows)
        return F.struct(
            F.lit(check).alias("check"), F.lit(column).alias("column"), n.cast("long").alias("n"),
            share.alias("share"), passed.alias("passed"),
        )

    lines = []
    for i, c in enumerate(df.columns):
        n = F.col(f"_null_{i}")
        lines.append(line("all_null", c, n, n < rows))
        lines.append(line("null_share", c, n, F.coalesce(n / F.nullif(rows, F.lit(0)) <= max_null, F.lit(True))))
    if timed:
        lines.append(line("repeated_time", ts, F.col("_repeats"), F.col("_repeats") == 0))
    else:
        lines.append(line("no_time_column", ts or "", F.lit(0), F.lit(True)))
    return one.select(F.inline(F.array(*lines)))


def passes(report: DataFrame) -> bool:
    """True if no check failed; brings one boolean to the driver."""
    return bool(report.agg(F.every("passed").alias("ok")).first()["ok"])


def null_profile(df: DataFrame, ts: str) -> DataFrame:
    """NULL count of each column that has any, with the frame's rows, columns and time range."""
    shape = [F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")]
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    one = df.agg(*[n.alias(f"_null_{i}") for i, n in enumerate(nulls)], *shape)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_null_{i}").alias("n_null"))
            for i, c in enumerate(df.columns)
        ]
    )
    return (
        one.select("n_rows", F.lit(len(df.columns)).alias("n_columns"), "first_ts", "last_ts", F.inline(cells))
        .where(F.col("n_null") > 0)
    )
