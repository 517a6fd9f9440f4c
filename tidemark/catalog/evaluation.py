"""Forecast evaluation over three simple models of the hourly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.base import register, table
from tidemark.catalog.profiles import HISTOGRAM_SQL
from tidemark.catalog.stand_ins import (
    daily,
    generation,
    local_sql,
    predictions,
    prices,
    reservoirs,
    weather,
    with_ctes,
)
from tidemark.operators import metrics, selection
from tidemark.session import scratch_path
from tidemark.sinks.tables import shape_predictions, write_metrics_csv
from tidemark.sources.scans import (
    scan_drivers,
    scan_generation,
    scan_predictions,
    scan_prices,
    scan_reservoirs,
    scan_series_range,
    scan_weather,
)

SCORES = ["mae", "rmse", "mape", "r2"]
METRICS_SQL = """SELECT model, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse,
    100 * avg(abs((predicted - actual) / actual)) FILTER (actual <> 0) AS mape,
    CASE WHEN var_pop(actual) > 0 THEN 1 - sum((predicted - actual) ** 2) / (var_pop(actual) * count(*)) END AS r2,
    CAST(count(*) AS BIGINT) AS n_predictions
  FROM p WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1"""


@register("regression_metrics", with_ctes("p", body=METRICS_SQL), floats=SCORES)
def _metrics(spark, sf):
    return metrics.regression_metrics(predictions(spark, sf), ["model"])


@register(
    "regression_metrics_by_series",
    with_ctes("p", body=METRICS_SQL.replace("SELECT model", "SELECT event_type, model").replace("GROUP BY 1", "GROUP BY 1, 2")),
    floats=SCORES,
)
def _metrics_by(spark, sf):
    return metrics.regression_metrics(predictions(spark, sf), ["event_type", "model"])


@register("sort_metrics", with_ctes("p", body=METRICS_SQL + " ORDER BY mae"), floats=SCORES)
def _sorted(spark, sf):
    return metrics.sort_metrics(metrics.regression_metrics(predictions(spark, sf), ["model"]))


@register("write_metrics_csv", with_ctes("p", body=METRICS_SQL), floats=SCORES)
def _metrics_csv(spark, sf):
    path = scratch_path(spark, "metrics")
    found = metrics.regression_metrics(predictions(spark, sf), ["model"])
    write_metrics_csv(found, path)
    return spark.read.schema(found.schema).option("header", True).csv(path)


@register(
    "model_compare_sql",
    with_ctes(
        "p",
        body="""SELECT model AS model_name, avg(abs(predicted - actual)) AS mae, sqrt(avg((predicted - actual) ** 2)) AS rmse,
            CAST(count(*) AS BIGINT) AS n FROM p WHERE actual IS NOT NULL GROUP BY 1""",
    ),
    floats=["mae", "rmse"],
)
def _compare(spark, sf):
    return metrics.model_compare_sql(predictions(spark, sf), "model", "actual", "predicted")


@register(
    "best_per_metric",
    with_ctes(
        "p",
        body=f"""SELECT metric, arg_min(model, (score * sign, model)) AS model, arg_min(score, (score * sign, model)) AS score
        FROM (SELECT 'mae' AS metric, model, mae AS score, 1 AS sign FROM ({METRICS_SQL})
              UNION ALL SELECT 'rmse', model, rmse, 1 FROM ({METRICS_SQL})
              UNION ALL SELECT 'mape', model, mape, 1 FROM ({METRICS_SQL})
              UNION ALL SELECT 'r2', model, r2, -1 FROM ({METRICS_SQL})) GROUP BY 1""",
    ),
    floats=["score"],
)
def _best(spark, sf):
    return metrics.best_per_metric(metrics.regression_metrics(predictions(spark, sf), ["model"]), "model")


@register(
    "mae_by_hour",
    with_ctes(
        "p",
        body=f"""SELECT k.model, k.hora, mae FROM
            (SELECT DISTINCT model, CAST(unnest(range(0, 24)) AS BIGINT) AS hora FROM p) k
        LEFT JOIN (SELECT model, hour({local_sql("hour")}) AS hora, avg(abs(predicted - actual)) AS mae FROM p GROUP BY 1, 2) e
          ON e.model = k.model AND e.hora = k.hora""",
    ),
    floats=["mae"],
)
def _by_hour(spark, sf):
    p = predictions(spark, sf).withColumn("hora", F.hour(F.from_utc_timestamp("hour", "America/Santiago")))
    return metrics.mae_by_hour(p, ["model"], "hora", "actual", "predicted")


@register(
    "error_histogram",
    "SELECT * FROM ("
    + HISTOGRAM_SQL.format(key="model", v="error", source="err", bins=60, last=59).replace(
        "WITH e AS",
        with_ctes(
            "p",
            body=""", err AS (SELECT model, predicted - actual AS error FROM p
                WHERE predicted IS NOT NULL AND actual IS NOT NULL), e AS""",
        ),
    )
    + ")",
    floats={"bin_start": 4, "bin_end": 4},
)
def _error_histogram(spark, sf):
    return metrics.error_histogram(predictions(spark, sf), ["model"], "actual", "predicted")


@register("distinct_models", "SELECT DISTINCT event_type AS model FROM events ORDER BY 1")
def _models(spark, sf):
    return metrics.distinct_models(table(spark, sf, "events").withColumnRenamed("event_type", "model"), "model")


def stored_predictions(spark, sf):
    """Predictions-table rows of all models."""
    p = predictions(spark, sf)
    shaped = [
        shape_predictions(
            p.where(F.col("model") == m), "event_type", m, "1.0", 1, ts="hour", predicted="predicted", actual="actual"
        )
        for m in ("last", "day", "mean24")
    ]
    return selection.union_files(*shaped)


@register(
    "scan_predictions",
    with_ctes(
        "p",
        body=f"""SELECT hour AS datetime, model AS model_name, predicted AS predicted_cmg, actual AS actual_cmg,
            CAST(hour({local_sql("hour")}) AS BIGINT) AS hora_santiago
        FROM p WHERE predicted IS NOT NULL AND actual IS NOT NULL AND event_type = 'click'""",
    ),
)
def _scan_predictions(spark, sf):
    return scan_predictions(stored_predictions(spark, sf), "click")


@register(
    "scan_prices",
    with_ctes("prices", body="SELECT datetime, barra, cmg_usd_mwh, is_imputed FROM prices WHERE barra = 'click'"),
)
def _scan_prices(spark, sf):
    return scan_prices(prices(spark, sf), "click")


@register("scan_generation", with_ctes("generation", body="SELECT * FROM generation"), floats={"gen_total_mw": 4})
def _scan_generation(spark, sf):
    return scan_generation(generation(spark, sf))


@register(
    "scan_reservoirs", with_ctes("reservoirs", body="SELECT CAST(date AS VARCHAR) AS date, energy_gwh FROM reservoirs")
)
def _scan_reservoirs(spark, sf):
    return scan_reservoirs(reservoirs(spark, sf))


@register(
    "scan_weather",
    with_ctes("weather", body="SELECT CAST(date AS VARCHAR) AS date, temp_max_c FROM weather WHERE region = 'view'"),
)
def _scan_weather(spark, sf):
    return scan_weather(weather(spark, sf), "view")


@register(
    "scan_drivers",
    """SELECT ts AS datetime, value AS gen_solar_mw, CASE WHEN value >= 50 THEN value END AS gen_gas_mw
       FROM events WHERE value >= 50""",
)
def _scan_drivers(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("ts").alias("datetime"), F.col("value").alias("gen_solar_mw"),
        F.when(F.col("value") >= 50, F.col("value")).alias("gen_gas_mw"),
    )
    return scan_drivers(e)


@register(
    "scan_series_range",
    with_ctes(
        "d",
        body="""SELECT o_orderpriority, day, total FROM (
            SELECT *, max(day) OVER (PARTITION BY o_orderpriority) AS newest FROM d
            WHERE day >= TIMESTAMP '1996-01-01' AND day <= TIMESTAMP '2000-12-31')
        WHERE day >= newest - INTERVAL 6 MONTH""",
    ),
)
def _series_range(spark, sf):
    return scan_series_range(
        daily(spark, sf), ["o_orderpriority"], "day", start="1996-01-01", end="2000-12-31", last_months=6
    )
