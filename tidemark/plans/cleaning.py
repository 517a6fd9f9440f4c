"""Cleaning and imputation of prices and generation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import null_if_negative, row_sum, zero_at_night
from tidemark.functions.clock import DEFAULT_TZ
from tidemark.operators.frames import null_if_outlier, null_negatives, temporal_features
from tidemark.operators.gaps import FILL_LIMIT, interpolate_limited
from tidemark.operators.keyed import keyed_join, require_keys, settled
from tidemark.operators.quantiles import median_exact, quantile_exact
from tidemark.operators.windows import imputer_lags
from tidemark.plans.cells import boost_cells
from tidemark.sources.schemas import TECH_COLUMNS

# Learner settings and inputs.
IMPUTER_INPUTS = ("hour_of_day", "day_of_week", "month", "lag_24h", "lag_168h")
IMPUTER_LAGS = IMPUTER_INPUTS[3:]
IMPUTER_TREES = 200
IMPUTER_RATE = 0.05
IMPUTER_DEPTH = 5
MIN_TRAIN_ROWS = 100
MIN_LEAF_ROWS = 20
LAG_BINS = 32

#: Bins of the inputs, in the order of IMPUTER_INPUTS.
CELL = tuple(f"_bin{i}" for i in range(len(IMPUTER_INPUTS)))


def binned_inputs(inputs: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rows with their bins; NULL bins where an input is missing.

    Lags are cut at the exact quantiles of the key's complete rows (a value on an edge belongs above it).
    """
    ready = F.lit(True)
    for c in IMPUTER_INPUTS:
        ready &= F.col(c).isNotNull()
    long = inputs.where(ready & F.col(value).isNotNull()).unpivot(list(keys), list(IMPUTER_LAGS), "_lag", "_x")
    names = [f"_e{i}" for i in range(1, LAG_BINS)]
    found = quantile_exact(long, [*keys, "_lag"], "_x", [i / LAG_BINS for i in range(1, LAG_BINS)], names)
    edges = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_lag") == c, F.array(*names))).alias(f"_edges_{c}") for c in IMPUTER_LAGS]
    )
    joined = keyed_join(inputs, settled(edges, "edges"), keys, "left")

    def edges_below(c: str):
        return F.size(F.filter(f"_edges_{c}", lambda e: e <= F.col(c)))

    below = {c: edges_below(c) for c in IMPUTER_LAGS}
    bins = [below.get(c, F.col(c)) for c in IMPUTER_INPUTS]
    known = ready & F.col(f"_edges_{IMPUTER_LAGS[0]}").isNotNull()
    return joined.withColumns({n: F.when(known, b.cast("int")) for n, b in zip(CELL, bins, strict=True)}).drop(*edges.columns[len(keys) :])


def cell_estimates(binned: DataFrame, keys: Sequence[str], value: str, trees: int, depth: int) -> DataFrame:
    """(keys, bins, _model) of the cells that have something to fill, from a model per key.

    Keys with fewer than MIN_TRAIN_ROWS complete rows have no model.
    """
    counted = binned.where(F.col(CELL[0]).isNotNull()).groupBy(*keys, *CELL).agg(
        F.count(value).alias("_n"), F.sum(F.col(value).cast("double")).alias("_sum"), F.count_if(F.col(value).isNull()).alias("_holes")
    )
    schema = T.StructType([*[f for f in counted.schema if f.name in (*keys, *CELL)], T.StructField("_model", T.DoubleType())])

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values(list(CELL), ignore_index=True)
        out = cells[[f.name for f in schema if f.name != "_model"]]
        holes, n = cells["_holes"].to_numpy() > 0, cells["_n"].to_numpy()
        if not holes.any() or n.sum() < MIN_TRAIN_ROWS:
            return out[:0].assign(_model=np.empty(0))
        x, total = cells[list(CELL)].to_numpy(int), cells["_sum"].fillna(0).to_numpy(float)
        return out.assign(_model=boost_cells(x, n, total, trees, IMPUTER_RATE, depth, MIN_LEAF_ROWS))[holes]

    return counted.groupBy(*keys).applyInPandas(run, schema)


def impute_gbt(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    trees: int = IMPUTER_TREES,
    method: str | None = None,
    depth: int = IMPUTER_DEPTH,
) -> DataFrame:
    """Fill the remaining NULLs with a boosted-tree estimate, else with the key's median.

    Every key has a model of its own. Rows whose lags are missing, and all rows of a key with too few
    complete ones to learn from, take the median. ``method`` names a column that receives ``observed``,
    ``model`` or ``median``.
    """
    keys = require_keys(keys)
    inputs = settled(temporal_features(imputer_lags(df, keys, ts, value), ts))
    if inputs.where(F.col(value).isNull()).isEmpty():  # nothing to fill, nothing to fit
        return inputs.select(*df.columns, *([F.lit("observed").alias(method)] if method else []))
    binned = binned_inputs(inputs, keys, value)
    estimates = settled(cell_estimates(binned, keys, value, trees, depth), "estimates")
    scored = keyed_join(binned, estimates, [*keys, *CELL], "left")
    middle = settled(median_exact(inputs, keys, value, "_median"))
    filled = keyed_join(scored, middle, keys, "left")
    out = filled.withColumn("_filled", F.coalesce(F.col(value), F.col("_model"), F.col("_median")))
    if method:
        how = F.when(F.col(value).isNotNull(), "observed").when(F.col("_model").isNotNull(), "model")
        out = out.withColumn(method, how.otherwise("median"))
    return out.withColumn(value, F.col("_filled")).select(*df.columns, *([method] if method else []))


def clean_prices(
    df: DataFrame,
    keys: Sequence[str] = ("barra",),
    ts: str = "datetime",
    value: str = "cmg_usd_mwh",
    trees: int = IMPUTER_TREES,
    approx: bool = False,
    method: str | None = None,
    depth: int = IMPUTER_DEPTH,
) -> DataFrame:
    """Negative and extreme values to NULL, then short gaps by interpolation, the rest by model.

    ``is_imputed`` marks every row that was NULL before filling. No NULL is left in a key that
    has any usable value. ``method`` names a column telling how each value came about.
    """
    keys = require_keys(keys)
    marked = null_if_outlier(df.withColumn(value, null_if_negative(F.col(value))), keys, value, approx=approx)
    marked = settled(marked.withColumn("is_imputed", F.col(value).isNull()))
    short = interpolate_limited(marked, keys, ts, [value], FILL_LIMIT)
    full = impute_gbt(short, keys, ts, value, trees, method="_how", depth=depth)
    if method:
        how = F.when(F.col("is_imputed") & (F.col("_how") == "observed"), "interpolated").otherwise(F.col("_how"))
        full = full.withColumn(method, how)
    return full.drop("_how")


def clean_generation(
    df: DataFrame,
    keys: Sequence[str],
    ts: str = "datetime",
    cols: Sequence[str] = TECH_COLUMNS,
    solar: str | None = "gen_solar_mw",
    total: str = "gen_total_mw",
    tz: str = DEFAULT_TZ,
) -> DataFrame:
    """Negative values to NULL, solar zero at night, short gaps interpolated, total recomputed."""
    present = [c for c in cols if c in df.columns]
    tidy = null_negatives(df, present)
    if solar in present:
        tidy = tidy.withColumn(solar, zero_at_night(F.col(solar), F.col(ts), tz))
    filled = interpolate_limited(tidy, keys, ts, present, FILL_LIMIT)
    return filled.withColumn(total, row_sum([F.col(c) for c in present], min_count=1))
