"""Keyed aggregations. All of them combine map-side before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import is_finite, month_floor, round_to
from tidemark.operators.joins import regularize_hourly, reindex_domain
from tidemark.operators.keyed import keyed_join, require_keys, settled
from tidemark.operators.quantiles import median_exact, quantile_exact


def agg_sum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*require_keys(keys)).agg(F.sum(value).alias(value))


def agg_month_mean_distinct(
    df: DataFrame, date: str, value: str, name: str, mean_as: str, count_as: str, digits: int = 4
) -> DataFrame:
    """Monthly mean and number of distinct names; a name with only NULL values still counts."""
    return (
        df.groupBy(month_floor(F.col(date)).alias("date"))
        .agg(round_to(F.avg(value), digits).alias(mean_as), F.count_distinct(name).alias(count_as))
    )


def profile_hour(df: DataFrame, keys: Sequence[str], hour: str, value: str) -> DataFrame:
    """Mean, median and sample deviation per hour of day."""
    by = [*require_keys(keys), hour]
    spread = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return keyed_join(spread, median_exact(df, by, value), by, "left").select(*by, "mean", "median", "std")


def profile_mean(df: DataFrame, keys: Sequence[str], part: str, value: str) -> DataFrame:
    """Mean per calendar part such as weekday, or model by hour."""
    return df.groupBy(*require_keys(keys), part).agg(F.avg(value).alias("mean"))


def profile_dow_month(
    df: DataFrame, keys: Sequence[str], dow: str, month: str, value: str
) -> tuple[DataFrame, DataFrame]:
    """Mean per weekday, and mean per month with all twelve months present."""
    weekly = profile_mean(df, keys, dow, value)
    monthly = reindex_domain(profile_mean(df, keys, month, value), keys, month, 1, 12)
    return weekly, monthly


def profile_extremes(profile: DataFrame, keys: Sequence[str], part: str, mean: str = "mean") -> DataFrame:
    """Where a profile is lowest and highest; the earlier part wins a tie."""
    known = F.col(mean).isNotNull()
    lowest = F.min(F.when(known, F.struct(F.col(mean).alias("v"), F.col(part).alias("at"))))
    highest = F.max(F.when(known, F.struct(F.col(mean).alias("v"), (-F.col(part)).alias("at"))))
    found = profile.groupBy(*require_keys(keys)).agg(lowest.alias("_lo"), highest.alias("_hi"))
    return found.select(
        *keys,
        F.col("_lo.at").alias(f"min_{part}"),
        F.col("_lo.v").alias("min_mean"),
        (-F.col("_hi.at")).alias(f"max_{part}"),
        F.col("_hi.v").alias("max_mean"),
    )


def profile_hour_month(df: DataFrame, keys: Sequence[str], hour: str, month: str, value: str) -> DataFrame:
    """Mean per (hour, month) in long form."""
    return df.groupBy(*require_keys(keys), hour, month).agg(F.avg(value).alias("mean"))


def kpi_latest_24h(df: DataFrame, keys: Sequence[str], ts: str, value: str, hours: int = 24) -> DataFrame:
    """Latest value, and mean, max and min since ``hours`` before it (that hour included)."""
    newest = df.groupBy(*require_keys(keys)).agg(F.max(ts).alias("_newest"))
    recent = keyed_join(df, settled(newest), keys).where(F.col(ts) >= F.col("_newest") - F.make_dt_interval(hours=F.lit(hours)))
    return recent.groupBy(*keys).agg(
        F.max(ts).alias("latest_ts"),
        F.max_by(value, ts).alias("latest"),
        F.avg(value).alias("mean_24h"),
        F.max(value).alias("max_24h"),
        F.min(value).alias("min_24h"),
    )


def describe_series(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    below: Sequence[float] = (5,),
    above: Sequence[float] = (100, 200),
    digits: int = 2,
) -> DataFrame:
    """Count, mean, deviation, range and quartiles, with counts past some thresholds."""
    v = F.col(value)
    counts = [F.count_if(v == 0).alias("n_zero")]
    counts += [F.count_if(v < t).alias(f"n_below_{t:g}") for t in below]
    counts += [F.count_if(v > t).alias(f"n_above_{t:g}") for t in above]
    basic = df.groupBy(*require_keys(keys)).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"), *counts,
    )
    quartiles = quantile_exact(df, keys, value, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    rounded = {c: round_to(F.col(c), digits) for c in ("mean", "std", "min", "p25", "p50", "p75", "max")}
    return keyed_join(basic, quartiles, keys, "left").withColumns(rounded)


def split_stats(df: DataFrame, keys: Sequence[str], value: str, split: str = "split") -> DataFrame:
    """Rows, mean and sample deviation per split; the row count includes NULL values."""
    return df.groupBy(*require_keys(keys), split).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Equal-width bins between each key's finite extremes, all bins present, last bin closed.

    If all values are equal the range is widened by one half on either side.
    """
    keys = require_keys(keys)
    number = F.col(value).cast("double")
    known = df.where(is_finite(number)).select(*keys, number.alias("_v"))
    ends = known.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.withColumns(
        {
            "_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
            "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")),
        }
    )
    ends = settled(ends)
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    place = F.floor((F.col("_v") - F.col("_lo")) / width).cast("int")
    counts = (
        keyed_join(known, ends, keys)
        .groupBy(*keys, F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return keyed_join(grid, counts, [*keys, "bin"], "left").select(
        *keys, "bin",
        (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def boxplot_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 interquartile ranges, and outlier count."""
    quartiles = quantile_exact(df, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    v, spread = F.col(value), F.col("q3") - F.col("q1")
    inner = (v >= F.col("q1") - 1.5 * spread) & (v <= F.col("q3") + 1.5 * spread)
    return (
        keyed_join(df.where(v.isNotNull()), settled(quartiles), keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inner, v)).alias("whisker_low"),
            F.max(F.when(inner, v)).alias("whisker_high"),
            F.count_if(~inner).alias("n_outliers"),
        )
    )


def correlations(df: DataFrame, keys: Sequence[str], target: str, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of the target with each column over rows where both are known, largest first."""
    both = [F.corr(F.col(target).cast("double"), F.col(c).cast("double")).alias(c) for c in cols]
    wide = df.groupBy(*require_keys(keys)).agg(*both)
    return wide.unpivot(list(keys), list(cols), "variable", "correlation").orderBy(*keys, F.desc("correlation"), "variable")


def linear_trend(df: DataFrame, keys: Sequence[str], x: str, y: str, points: int = 200) -> DataFrame:
    """Least-squares line per key, as coefficients and evenly spaced points along the x range."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    fit = df.where(both).groupBy(*require_keys(keys)).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.min(x).alias("_lo"), F.max(x).alias("_hi"),
    )
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("point") / F.lit(points - 1)
    return (
        fit.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", at)
        .withColumn("y", F.col("intercept") + F.col("slope") * F.col("x"))
        .drop("_lo", "_hi")
    )


def resample_daily(df: DataFrame, keys: Sequence[str], ts: str, value: str, day: str = "day") -> DataFrame:
    """Mean per UTC day, with NULL for empty days between the first and the last."""
    daily = df.groupBy(*require_keys(keys), F.date_trunc("day", F.col(ts)).alias(day)).agg(F.avg(value).alias(value))
    return regularize_hourly(daily, keys, day, step_hours=24)


def minmax_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with ``{c}_min`` and ``{c}_max``; call it on training rows only."""
    ends: list[Column] = []
    for c in cols:
        ends += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*ends)


def minmax_scale(df: DataFrame, fitted: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale with the fitted range, without clipping; a constant column becomes value - min."""
    ends = fitted.select(F.struct(*fitted.columns)).scalar()
    scaled = {}
    for c in cols:
        low, high = ends[f"{c}_min"], ends[f"{c}_max"]
        span = F.when(high > low, high - low).otherwise(F.lit(1.0))
        scaled[c] = (F.col(c) - low) / span
    return df.withColumns(scaled)


def minmax_inverse(df: DataFrame, fitted: DataFrame, column: str, fitted_as: str) -> DataFrame:
    """Undo the scaling of one column with the range of ``fitted_as``."""
    ends = fitted.select(F.struct(f"{fitted_as}_min", f"{fitted_as}_max")).scalar()
    low, high = ends[f"{fitted_as}_min"], ends[f"{fitted_as}_max"]
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    return df.withColumn(column, F.col(column) * span + low)


__all__ = [
    "agg_month_mean_distinct",
    "agg_sum",
    "boxplot_stats",
    "correlations",
    "describe_series",
    "histogram",
    "kpi_latest_24h",
    "linear_trend",
    "median_exact",
    "minmax_fit",
    "minmax_inverse",
    "minmax_scale",
    "profile_dow_month",
    "profile_extremes",
    "profile_hour",
    "profile_hour_month",
    "profile_mean",
    "quantile_exact",
    "resample_daily",
    "split_stats",
]
