"""Filtered, projected scans. Filters stay plain column conditions so that they reach Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import DEFAULT_TZ, utc_to_local
from tidemark.operators.keyed import keyed_join, require_keys, settled
from tidemark.sources.schemas import GENERATION_COLUMNS


def scan_prices(df: DataFrame, bus: str | None = None) -> DataFrame:
    """Price series of one bus, or of all."""
    rows = df if bus is None else df.where(F.col("barra") == bus)
    return rows.select("datetime", "barra", F.col("cmg_usd_mwh").cast("double").alias("cmg_usd_mwh"), "is_imputed")


def scan_generation(df: DataFrame) -> DataFrame:
    return df.select("datetime", *[F.col(c).cast("double").alias(c) for c in GENERATION_COLUMNS])


def scan_reservoirs(df: DataFrame) -> DataFrame:
    return df.select("date", F.col("energy_gwh").cast("double").alias("energy_gwh"))


def scan_weather(df: DataFrame, region: str) -> DataFrame:
    return df.where(F.col("region") == region).select("date", F.col("temp_max_c").cast("double").alias("temp_max_c"))


def scan_series_range(
    df: DataFrame, keys: Sequence[str], ts: str, start: str | None = None, end: str | None = None,
    last_months: int | None = None,
) -> DataFrame:
    """Rows within [start, end], then only the last calendar months of each key (cutoff included)."""
    kind = df.schema[ts].dataType
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast(kind))
    if last_months is None:
        return df
    newest = settled(df.groupBy(*require_keys(keys)).agg(F.max(ts).alias("_newest")))
    cutoff = F.col("_newest") - F.make_ym_interval(months=F.lit(last_months))
    return keyed_join(df, newest, keys).where(F.col(ts) >= cutoff).drop("_newest")


def scan_predictions(df: DataFrame, bus: str | None, horizon: int = 1, tz: str = DEFAULT_TZ) -> DataFrame:
    """Scored predictions of one horizon with the local hour."""
    rows = df if bus is None else df.where(F.col("barra") == bus)
    return rows.where((F.col("horizon_h") == horizon) & F.col("actual_cmg").isNotNull()).select(
        "datetime", "model_name",
        F.col("predicted_cmg").cast("double").alias("predicted_cmg"),
        F.col("actual_cmg").cast("double").alias("actual_cmg"),
        F.hour(utc_to_local(F.col("datetime"), tz)).alias("hora_santiago"),
    )


def scan_drivers(df: DataFrame, cols: Sequence[str] = ("gen_solar_mw", "gen_gas_mw")) -> DataFrame:
    """Time and the named columns where all of them are known."""
    rows = df
    for c in cols:
        rows = rows.where(F.col(c).isNotNull())
    return rows.select("datetime", *cols)
