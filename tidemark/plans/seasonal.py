"""Seasonal autoregressive baseline over many series.

The normal equations of every series are sums of products of lagged columns, so one grouped
aggregation builds them whatever the length of a series. What reaches Python is one small row
per series.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.gaps import interpolate_all
from tidemark.operators.joins import regularize_hourly
from tidemark.operators.keyed import keyed_join, require_keys, settled
from tidemark.operators.windows import lags
from tidemark.sources.scans import scan_series_range

# Season length, candidate orders, history used.
SEASON = 24
ORDERS = (0, 1, 2)
LAST_MONTHS = 6


def solve_order(xx: np.ndarray, xy: np.ndarray, yy: float, n: float, p: int) -> tuple[float, np.ndarray] | None:
    """AIC and coefficients (constant, z1, z2, zs) of order ``p``, or None if unsolvable."""
    used = [0, *range(1, p + 1), 3]
    if n <= len(used) + 1:
        return None
    try:
        found = np.linalg.solve(xx[np.ix_(used, used)], xy[used])
    except np.linalg.LinAlgError:
        return None
    if not np.isfinite(found).all():
        return None
    sse = max(yy - float(found @ xy[used]), np.finfo(float).tiny)
    weights = np.zeros(4)
    weights[used] = found
    return n * float(np.log(sse / n)) + 2 * (len(used) + 1), weights


def forecast_path(tail: Sequence[float], weights: np.ndarray, horizon: int) -> list[float]:
    """Run the recursion forward from the last two seasons and two more values."""
    y = list(tail)
    for _ in range(horizon):
        z1, z2, zs = (y[-k] - y[-k - SEASON] for k in (1, 2, SEASON))
        y.append(y[-SEASON] + float(weights @ np.array([1.0, z1, z2, zs])))
    return y[len(tail) :]


def seasonal_ar(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    horizon: int = 24,
    end: str | None = None,
    last_months: int | None = LAST_MONTHS,
) -> DataFrame:
    """Forecast each series ``horizon`` hours past its end.

    The series is differenced over one day, regressed on its last p values and the value one
    day before, with p chosen by AIC; if no order can be solved the last day repeats. Holes
    are interpolated first. Returns keys, the forecast time, ``horizon_h``, ``predicted``,
    the chosen order ``p`` (-1 for the fallback) and its ``aic``. A series shorter than two
    days and two hours yields nothing.
    """
    keys = require_keys(keys)
    window = scan_series_range(df.select(*keys, ts, value), keys, ts, end=end, last_months=last_months)
    whole = regularize_hourly(window, keys, ts)
    series = settled(interpolate_all(whole, keys, ts, [value]).withColumn(value, F.col(value).cast("double")), "series")

    back = (1, 2, SEASON, SEASON + 1, SEASON + 2, 2 * SEASON)
    lagged = lags(series, keys, ts, value, back, mode="time")

    def y(h: int):
        return F.col(f"lag_{value}_{h}h")

    z = lagged.select(
        *keys,
        (F.col(value) - y(SEASON)).alias("_z0"),
        (y(1) - y(SEASON + 1)).alias("_z1"),
        (y(2) - y(SEASON + 2)).alias("_z2"),
        (y(SEASON) - y(2 * SEASON)).alias("_z3"),
    ).dropna(subset=["_z0", "_z1", "_z2", "_z3"])
    x = [F.lit(1.0), F.col("_z1"), F.col("_z2"), F.col("_z3")]
    pairs = [(i, j) for i in range(4) for j in range(i, 4)]
    products = [F.sum(x[i] * x[j]) for i, j in pairs]
    targets = [F.sum(x[i] * F.col("_z0")) for i in range(4)]
    sums = z.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.array(*products).alias("_xx"),
        F.array(*targets).alias("_xy"),
        F.sum(F.col("_z0") * F.col("_z0")).alias("_yy"),
    )

    need = 2 * SEASON + 2
    newest = settled(series.groupBy(*keys).agg(F.max(ts).alias("_newest")))
    recent = keyed_join(series, newest, keys).where(F.col(ts) > F.col("_newest") - F.make_dt_interval(hours=F.lit(need)))
    tails = recent.groupBy(*keys, "_newest").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(ts, value))), lambda s: s[value]).alias("_tail")
    )
    ready = keyed_join(tails, sums, keys, "left").where(F.size("_tail") == need)

    out = T.StructType(
        [ready.schema[k] for k in keys]
        + [ready.schema["_newest"]]
        + [
            T.StructField("horizon_h", T.IntegerType()),
            T.StructField("predicted", T.DoubleType()),
            T.StructField("p", T.IntegerType()),
            T.StructField("aic", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for row in batch.to_dict("records"):
                best, chosen = None, -1
                if row["_xx"] is not None and not np.isnan(row["_n"]):
                    xx = np.zeros((4, 4))
                    for (i, j), v in zip(pairs, row["_xx"]):
                        xx[i, j] = xx[j, i] = v
                    for p in ORDERS:
                        tried = solve_order(xx, np.array(row["_xy"], dtype=float), row["_yy"], row["_n"], p)
                        if tried is not None and (best is None or tried[0] < best[0]):
                            best, chosen = tried, p
                aic, weights = best if best is not None else (None, np.zeros(4))
                path = forecast_path(row["_tail"], weights, horizon)
                base = [row[k] for k in keys] + [row["_newest"]]
                lines += [[*base, h, v, chosen, aic] for h, v in enumerate(path, start=1)]
            yield pd.DataFrame(lines, columns=[f.name for f in out])

    steps = ready.select(*keys, "_newest", "_tail", "_n", "_xx", "_xy", "_yy").mapInPandas(run, out)
    at = F.col("_newest") + F.make_dt_interval(hours=F.col("horizon_h"))
    return steps.select(*keys, at.alias(ts), "horizon_h", "predicted", "p", "aic")
