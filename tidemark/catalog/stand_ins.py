"""The domain tables, derived from the test tables, in Spark and as SQL.

``events`` stands in for hourly series: the exact sum of ``value`` per type and hour is the
price of a bus. Sums run over decimals, so both engines get the same number bit by bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.base import table
from tidemark.functions import row_sum
from tidemark.operators.frames import ensure_columns, fill_zero
from tidemark.operators.joins import regularize_hourly
from tidemark.operators.keyed import settled
from tidemark.operators.reshape import pivot_category
from tidemark.operators.windows import lags_and_rolling
from tidemark.sources.schemas import GENERATION_COLUMNS, TECH_COLUMNS

KEY = ["event_type"]
# Which technology column each event type stands for; the other two stay absent.
TECH_OF = {
    "click": "gen_solar_mw",
    "error": "gen_wind_mw",
    "purchase": "gen_hydro_reservoir_mw",
    "signup": "gen_gas_mw",
    "view": "gen_coal_mw",
}


def money(c: str) -> Column:
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """(event_type, hour, value), hours without events absent."""
    events = table(spark, sf, "events")
    return events.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(money("value").alias("value"))


def series(spark: SparkSession, sf: str) -> DataFrame:
    """The hourly series as a stored table, for operators that read their input repeatedly."""
    return settled(hourly(spark, sf), "hourly")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """The series with every hour present and NULL where there were no events."""
    return settled(regularize_hourly(series(spark, sf), KEY, "hour"), "grid")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(o_orderpriority, day, total) from orders."""
    orders = table(spark, sf, "orders")
    return orders.groupBy("o_orderpriority", F.date_trunc("day", "o_orderdate").alias("day")).agg(
        money("o_totalprice").alias("total")
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(event_type, hour, model, actual, predicted): last hour, last day and daily mean as models.

    The mean is cut to cents; the hundredth of a cent keeps means of whole cents (of at most 24 values) apart from
    the cut, so that the last bit of a sum does not count.
    """
    back = lags_and_rolling(grid(spark, sf), KEY, "hour", "value", [1, 24], [24], mode="time")
    wide = back.select(
        "event_type", "hour", F.col("value").alias("actual"), F.col("lag_value_1h").alias("last"),
        F.col("lag_value_24h").alias("day"), (F.floor(F.col("rolling_mean_value_24h") * 100 + 0.01) / 100).alias("mean24"),
    )
    return wide.unpivot(["event_type", "hour", "actual"], ["last", "day", "mean24"], "model", "predicted")


def prices(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).select(
        F.col("hour").alias("datetime"), F.col("event_type").alias("barra"), F.col("value").alias("cmg_usd_mwh"),
        F.lit(False).alias("is_imputed"),
    )


def generation(spark: SparkSession, sf: str) -> DataFrame:
    """One row per hour with all technology columns and their total."""
    names = F.create_map(*[F.lit(x) for pair in TECH_OF.items() for x in pair])
    long = hourly(spark, sf).select(F.col("hour").alias("datetime"), names[F.col("event_type")].alias("tech"), "value")
    wide = pivot_category(long, ["datetime"], "tech", "value", list(TECH_OF.values()))
    wide = fill_zero(ensure_columns(wide, TECH_COLUMNS), TECH_COLUMNS)
    return wide.withColumn("gen_total_mw", row_sum([F.col(c) for c in TECH_COLUMNS])).select(
        "datetime", *GENERATION_COLUMNS
    )


def reservoirs(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly level from purchases, dated one day late so that the first day has none."""
    events = table(spark, sf, "events").where(F.col("event_type") == "purchase")
    week = F.date_add(F.to_date(F.date_trunc("week", "ts")), 1)
    return events.groupBy(week.alias("date")).agg(money("value").alias("energy_gwh"))


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Daily extremes per type as region; weak maxima count as missing."""
    events = table(spark, sf, "events")
    top = F.max("value")
    return events.groupBy(F.to_date("ts").alias("date"), F.col("event_type").alias("region")).agg(
        F.when(top >= 200, top).alias("temp_max_c"), money("value").alias("precip_mm")
    )


def holidays(spark: SparkSession, sf: str) -> DataFrame:
    """Days that start or halve a month."""
    days = table(spark, sf, "events").select(F.to_date("ts").alias("date"))
    return days.where(F.dayofmonth("date").isin(1, 15)).distinct()


_GEN_SQL = ", ".join(
    f"COALESCE(SUM(value) FILTER (event_type = '{kind}'), 0.0::DOUBLE) AS {tech}" for kind, tech in TECH_OF.items()
)

# name -> (definition, names it builds on)
CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "h": (
        """SELECT event_type, date_trunc('hour', ts) AS hour,
                  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value
           FROM events GROUP BY 1, 2""",
        (),
    ),
    "g": (
        """SELECT k.event_type, k.hour, h.value
           FROM (SELECT event_type, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour
                 FROM h GROUP BY event_type) k
           LEFT JOIN h ON h.event_type = k.event_type AND h.hour = k.hour""",
        ("h",),
    ),
    "d": (
        """SELECT o_orderpriority, date_trunc('day', o_orderdate)::TIMESTAMP AS day,
                  CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
           FROM orders GROUP BY 1, 2""",
        (),
    ),
    "pw": (
        """SELECT event_type, hour, value AS actual, lag(value, 1) OVER w AS last, lag(value, 24) OVER w AS day,
                  floor(avg(value) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)
                    * 100 + 0.01::DOUBLE) / 100 AS mean24
           FROM g WINDOW w AS (PARTITION BY event_type ORDER BY hour)""",
        ("g",),
    ),
    "p": (
        """SELECT event_type, hour, 'last' AS model, actual, last AS predicted FROM pw
           UNION ALL SELECT event_type, hour, 'day', actual, day FROM pw
           UNION ALL SELECT event_type, hour, 'mean24', actual, mean24 FROM pw""",
        ("pw",),
    ),
    "prices": (
        "SELECT hour AS datetime, event_type AS barra, value AS cmg_usd_mwh, FALSE AS is_imputed FROM h",
        ("h",),
    ),
    "gen5": (f"SELECT hour AS datetime, {_GEN_SQL} FROM h GROUP BY 1", ("h",)),
    "generation": (
        """SELECT datetime, gen_solar_mw, gen_wind_mw, gen_hydro_reservoir_mw, 0.0::DOUBLE AS gen_hydro_runofriver_mw,
                  gen_gas_mw, gen_coal_mw, 0.0::DOUBLE AS gen_diesel_mw,
                  gen_solar_mw + gen_wind_mw + gen_hydro_reservoir_mw + 0.0::DOUBLE + gen_gas_mw + gen_coal_mw
                    AS gen_total_mw
           FROM gen5""",
        ("gen5",),
    ),
    "reservoirs": (
        """SELECT CAST(date_trunc('week', ts) AS DATE) + 1 AS date,
                  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS energy_gwh
           FROM events WHERE event_type = 'purchase' GROUP BY 1""",
        (),
    ),
    "weather": (
        """SELECT CAST(ts AS DATE) AS date, event_type AS region,
                  CASE WHEN max(value) >= 200 THEN max(value) END AS temp_max_c,
                  CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS precip_mm
           FROM events GROUP BY 1, 2""",
        (),
    ),
    "holidays": ("SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE day(ts) IN (1, 15)", ()),
}


def with_ctes(*names: str, body: str) -> str:
    """Prefix the SQL with the named definitions and what they build on."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for base in CTES[name][1]:
            visit(base)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in ordered) + "\n" + body.strip()


def local_sql(c: str) -> str:
    """UTC wall clock -> Santiago wall clock."""
    return f"timezone('America/Santiago', timezone('UTC', {c}))"
