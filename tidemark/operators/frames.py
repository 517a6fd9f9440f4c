"""Filters and column-wise clean-up of whole frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import abs_error, is_finite, is_weekend, null_if_negative, signed_error, tidy, utc_to_local
from tidemark.functions.clock import DEFAULT_TZ
from tidemark.operators.keyed import keyed_join, require_keys, settled
from tidemark.operators.quantiles import quantile_exact

# Fixed values.
MISSING_TOKENS = ("", "NA", "N/A", "null")
OUTLIER_QUANTILE = 0.999
OUTLIER_FACTOR = 3.0
# Train ends, validation ends; days are included whole.
TRAIN_START = "2021-01-01"
TRAIN_END = "2023-06-30"
VAL_END = "2023-12-31"
TEST_END = "2024-12-31"


def null_tokens(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Exactly these tokens become NULL in every text column."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in texts})


def normalize_header(df: DataFrame, date_name: str | None = None) -> DataFrame:
    """Strip blanks and byte-order marks from column names.

    A column spelled like ``date_name`` in any case takes exactly that name.
    """
    marks = ("\ufeff", "ï»¿")

    def clean(name: str) -> str:
        for mark in marks:
            name = name.replace(mark, "")
        name = name.strip()
        return date_name if date_name and name.lower() == date_name.lower() else name

    return df.toDF(*[clean(c) for c in df.columns])


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = sorted(set(cols) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}, found {df.columns}")
    return df


def map_category(
    df: DataFrame, mapping: DataFrame, kind: str, subkind: str, name: str = "category", keep_others: bool = False
) -> DataFrame:
    """Attach the category of (kind, subkind) and drop rows that have none, unless ``keep_others``.

    ``mapping`` has columns kind, subkind, category; a NULL subkind there stands for any.
    """
    exact = mapping.where(F.col("subkind").isNotNull()).select(
        F.col("kind").alias("_k1"), F.col("subkind").alias("_s1"), F.col("category").alias("_c1")
    )
    general = mapping.where(F.col("subkind").isNull()).select(
        F.col("kind").alias("_k2"), F.col("category").alias("_c2")
    )
    mapped = (
        df.join(exact, (F.col(kind) == F.col("_k1")) & (F.col(subkind) == F.col("_s1")), "left")
        .join(general, F.col(kind) == F.col("_k2"), "left")
        .withColumn(name, F.coalesce("_c1", "_c2"))
        .drop("_k1", "_s1", "_c1", "_k2", "_c2")
    )
    return mapped if keep_others else mapped.where(F.col(name).isNotNull())


def filter_in_list(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.withColumn(column, tidy(F.col(column))).where(F.col(column).isin(*names))


def filter_year_from(df: DataFrame, column: str, year: int) -> DataFrame:
    """A plain range condition, so that it reaches the scan."""
    return df.where(F.col(column) >= F.lit(f"{year}-01-01").cast(df.schema[column].dataType))


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(subset))


def null_negatives(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: null_if_negative(F.col(c)) for c in cols})


def null_if_outlier(
    df: DataFrame, keys: Sequence[str], value: str, q: float = OUTLIER_QUANTILE, factor: float = OUTLIER_FACTOR,
    approx: bool = False,
) -> DataFrame:
    """NULL above ``factor`` times the key's quantile; the quantile is exact unless ``approx``."""
    keys = require_keys(keys)
    if approx:
        limits = df.groupBy(*keys).agg(F.percentile_approx(value, q).alias("_q"))
    else:
        limits = quantile_exact(df, keys, value, [q], ["_q"])
    limited = keyed_join(df, settled(limits), keys, "left")
    over = F.coalesce(F.col(value) > F.col("_q") * factor, F.lit(False))
    return limited.withColumn(value, F.when(~over, F.col(value))).drop("_q")


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.fillna(0.0, subset=list(cols))


def ensure_columns(df: DataFrame, cols: Sequence[str], default: float = 0.0) -> DataFrame:
    """Add the absent ones with a constant."""
    absent = {c: F.lit(default) for c in cols if c not in df.columns}
    return df.withColumns(absent) if absent else df


def tag_constant(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def rename_proxy(df: DataFrame, source: str, name: str) -> DataFrame:
    return df.withColumnRenamed(source, name)


def cyclic_encode(df: DataFrame, ts: str, tz: str = DEFAULT_TZ) -> DataFrame:
    """Sine and cosine of local hour, weekday and month."""
    local = utc_to_local(F.col(ts), tz)
    turns = {"hora": F.hour(local) / 24, "dow": F.weekday(local) / 7, "mes": (F.month(local) - 1) / 12}
    waves: dict[str, Column] = {}
    for name, turn in turns.items():
        waves[f"{name}_sin"] = F.sin(F.lit(2 * pi) * turn)
        waves[f"{name}_cos"] = F.cos(F.lit(2 * pi) * turn)
    return df.withColumns(waves)


def weekend_flag(df: DataFrame, ts: str, tz: str = DEFAULT_TZ, name: str = "is_weekend") -> DataFrame:
    return df.withColumn(name, is_weekend(utc_to_local(F.col(ts), tz)))


def temporal_features(df: DataFrame, ts: str) -> DataFrame:
    """Hour, weekday and month of the instant in UTC."""
    at = F.col(ts)
    return df.withColumns({"hour_of_day": F.hour(at), "day_of_week": F.weekday(at), "month": F.month(at)})


def time_range(
    df: DataFrame, ts: str, start: str | None = None, end: str | None = None, month_column: str | None = None
) -> DataFrame:
    """Rows from ``start`` up to ``end``, both included.

    ``month_column`` names the table's month partition (yyyy-MM); the same bounds on it prune
    whole partitions.
    """
    kind = df.schema[ts].dataType
    for bound, below in ((start, False), (end, True)):
        if bound is None:
            continue
        limit = F.lit(bound).cast(kind)
        df = df.where(F.col(ts) <= limit if below else F.col(ts) >= limit)
        if month_column:
            month = F.date_format(limit, "yyyy-MM")
            df = df.where(F.col(month_column) <= month if below else F.col(month_column) >= month)
    return df


def split_chronological(
    df: DataFrame,
    ts: str,
    train_end: str = TRAIN_END,
    val_end: str = VAL_END,
    name: str = "split",
    train_start: str | None = TRAIN_START,
    test_end: str | None = TEST_END,
) -> DataFrame:
    """Label rows train, val or test; end days belong whole to the earlier part.

    Rows before ``train_start`` and after the day ``test_end`` belong to no part: NULL. None leaves that side open.
    """
    day = F.expr("INTERVAL 1 DAY")
    at = F.col(ts).cast("timestamp")

    def until(end: str) -> Column:
        return at < F.lit(end).cast("timestamp") + day

    label = F.when(until(train_end), "train").when(until(val_end), "val")
    label = label.otherwise("test") if test_end is None else label.when(until(test_end), "test")
    if train_start is not None:
        label = F.when(at >= F.lit(train_start).cast("timestamp"), label)
    return df.withColumn(name, label)


def error_columns(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Errors, and the masks the metrics use."""
    a, p = F.col(actual), F.col(predicted)
    finite = is_finite(a) & is_finite(p)
    return df.withColumns(
        {
            "abs_error": abs_error(a, p),
            "error": signed_error(a, p),
            "is_finite": finite,
            "is_scorable": finite & (a != 0),
        }
    )


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
