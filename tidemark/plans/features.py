"""The hourly feature matrix."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clock import DEFAULT_TZ, utc_to_local
from tidemark.operators.frames import TEST_END, TRAIN_START, cyclic_encode, time_range, weekend_flag
from tidemark.operators.gaps import bfill
from tidemark.operators.joins import asof_ffill, join_price_generation, lookup_holiday
from tidemark.operators.keyed import settled
from tidemark.operators.windows import LAG_HOURS, ROLLING_HOURS, lags_and_rolling
from tidemark.sources.schemas import GENERATION_COLUMNS

TARGET = "cmg_usd_mwh"
CYCLIC = tuple(f"{part}_{wave}" for part in ("hora", "dow", "mes") for wave in ("sin", "cos"))
FEATURES = (
    *GENERATION_COLUMNS,
    "energy_gwh",
    "temp_max_c",
    *[f"lag_{TARGET}_{h}h" for h in LAG_HOURS],
    *[f"rolling_{stat}_{TARGET}_{n}h" for n in ROLLING_HOURS for stat in ("mean", "std")],
    *CYCLIC,
    "is_weekend",
    "is_holiday",
)


def build_feature_matrix(
    prices: DataFrame,
    generation: DataFrame,
    reservoirs: DataFrame,
    weather: DataFrame,
    holidays: DataFrame,
    start: str = TRAIN_START,
    end: str = TEST_END,
    tz: str = DEFAULT_TZ,
    lookback: bool = False,
    bfill_missing: bool = True,
    mode: str = "rows",
    holiday_years: tuple[int, int] | None = None,
) -> DataFrame:
    """(barra, datetime) with the target, its imputed flag and all features.

    ``prices`` has many buses, the other tables serve all of them. The range runs from the
    start of ``start`` to 24 hours after the start of ``end``, both included. By default the
    range is cut before the lags, so the first rows have none; ``lookback`` computes lags over
    the whole history first. ``bfill_missing`` fills slow values that are still NULL from
    later hours, a look into the future kept for equal results. ``holiday_years`` are the years that
    ``holidays`` covers; a local date outside is an error.
    """
    last = str(_next_day(end))
    # Filling from later hours may need rows past the end, so that cut waits until after it.
    first_cut = None if lookback else start
    last_cut = None if bfill_missing else last
    both = join_price_generation(
        time_range(prices, "datetime", first_cut, last_cut),
        time_range(generation, "datetime", first_cut, last_cut).select("datetime", *GENERATION_COLUMNS),
    )
    for slow, column in ((reservoirs, "energy_gwh"), (weather, "temp_max_c")):
        both = asof_ffill(both, slow, [], "datetime", "date", [column])
    # The steps below read their input more than once.
    both = settled(both, "joined")
    slow_missing = F.col("energy_gwh").isNull() | F.col("temp_max_c").isNull()
    matrix = both
    if bfill_missing and not both.where(slow_missing).isEmpty():
        matrix = bfill(matrix, ["barra"], "datetime", ["energy_gwh", "temp_max_c"])
    matrix = lags_and_rolling(matrix, ["barra"], "datetime", TARGET, mode=mode, rows_of=both)
    matrix = time_range(matrix, "datetime", start if lookback else None, None if last_cut else last)
    matrix = weekend_flag(cyclic_encode(matrix, "datetime", tz), "datetime", tz)
    matrix = matrix.withColumn("_date", F.to_date(utc_to_local(F.col("datetime"), tz)))
    matrix = lookup_holiday(matrix, "_date", holidays, years=holiday_years)
    return matrix.where(F.col(TARGET).isNotNull()).select("barra", "datetime", TARGET, "is_imputed", *FEATURES)


def _next_day(day: str) -> date:
    return date.fromisoformat(day) + timedelta(days=1)
