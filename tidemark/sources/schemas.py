"""Stored tables: columns, natural keys and partition columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Technology columns in their natural order.
TECH_COLUMNS = (
    "gen_solar_mw",
    "gen_wind_mw",
    "gen_hydro_reservoir_mw",
    "gen_hydro_runofriver_mw",
    "gen_gas_mw",
    "gen_coal_mw",
    "gen_diesel_mw",
)
GENERATION_COLUMNS = (*TECH_COLUMNS, "gen_total_mw")


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


PRICES = _schema(
    datetime=T.TimestampType(), barra=T.StringType(), cmg_usd_mwh=T.DecimalType(10, 4), is_imputed=T.BooleanType()
)
GENERATION = _schema(datetime=T.TimestampType(), **{c: T.DecimalType(10, 2) for c in GENERATION_COLUMNS})
DEMAND = _schema(datetime=T.TimestampType(), demand_mw=T.DecimalType(10, 2))
RESERVOIRS = _schema(date=T.DateType(), energy_gwh=T.DecimalType(10, 2))
WEATHER = _schema(
    date=T.DateType(), region=T.StringType(), temp_max_c=T.DecimalType(5, 2), precip_mm=T.DecimalType(7, 2)
)
PREDICTIONS = _schema(
    datetime=T.TimestampType(), barra=T.StringType(), model_name=T.StringType(), model_version=T.StringType(),
    predicted_cmg=T.DecimalType(10, 4), actual_cmg=T.DecimalType(10, 4), horizon_h=T.ShortType(),
)

TABLES = {
    "marginal_costs": PRICES,
    "generation_by_tech": GENERATION,
    "demand": DEMAND,
    "reservoir_levels": RESERVOIRS,
    "weather": WEATHER,
    "predictions": PREDICTIONS,
}
KEYS = {
    "marginal_costs": ("datetime", "barra"),
    "generation_by_tech": ("datetime",),
    "demand": ("datetime",),
    "reservoir_levels": ("date",),
    "weather": ("date", "region"),
    "predictions": ("datetime", "barra", "model_name", "model_version", "horizon_h"),
}
# Columns that must be present in every stored row.
REQUIRED = {
    "marginal_costs": ("datetime", "barra", "cmg_usd_mwh", "is_imputed"),
    "generation_by_tech": ("datetime",),
    "demand": ("datetime", "demand_mw"),
    "reservoir_levels": ("date", "energy_gwh"),
    "weather": ("date", "region"),
    "predictions": ("datetime", "barra", "model_name", "model_version", "predicted_cmg", "horizon_h"),
}


def fit_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select and cast to the stored types; stored decimals round half up."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
