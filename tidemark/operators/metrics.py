"""Forecast evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import abs_error, is_finite
from tidemark.operators.aggregates import histogram, profile_mean
from tidemark.operators.frames import error_columns
from tidemark.operators.joins import reindex_domain
from tidemark.operators.keyed import require_keys


def regression_metrics(
    df: DataFrame, by: Sequence[str], actual: str = "actual", predicted: str = "predicted"
) -> DataFrame:
    """MAE, RMSE, MAPE (percent, over non-zero actuals), R2 and number of scored rows.

    One aggregation over rows where both values are finite; a group without any is absent.
    R2 is NULL where the actual values do not vary.
    """
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    scored = df.where(is_finite(a) & is_finite(p)).select(*require_keys(by), a.alias("_a"), p.alias("_p"))
    err = F.col("_p") - F.col("_a")
    total = F.var_pop("_a") * F.count(F.lit(1))
    return scored.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(F.col("_a") != 0, F.abs(err / F.col("_a")))) * 100).alias("mape"),
        F.when(F.max("_a") > F.min("_a"), 1 - F.sum(err * err) / total).alias("r2"),
        F.count(F.lit(1)).alias("n_predictions"),
    )


def sort_metrics(metrics: DataFrame, by: Sequence[str] = ("mae",)) -> DataFrame:
    return metrics.orderBy(*by)


def rounded_metrics(metrics: DataFrame) -> DataFrame:
    """Report form: two decimals, four for R2."""
    digits = {"mae": 2, "rmse": 2, "mape": 2, "r2": 4}
    return metrics.withColumns({c: F.bround(c, n) for c, n in digits.items()})


def model_compare_sql(df: DataFrame, model: str, actual: str, predicted: str) -> DataFrame:
    """MAE and RMSE per model as one SQL aggregation, best first."""
    return df.sparkSession.sql(
        """
        SELECT {model} AS model_name,
               AVG(ABS({predicted} - {actual})) AS mae,
               SQRT(AVG(POWER({predicted} - {actual}, 2))) AS rmse,
               COUNT(*) AS n
        FROM {df}
        WHERE {actual} IS NOT NULL
        GROUP BY {model}
        ORDER BY mae
        """,
        df=df,
        model=F.col(model),
        actual=F.col(actual),
        predicted=F.col(predicted),
    )


def best_per_metric(metrics: DataFrame, model: str) -> DataFrame:
    """The winning model of each metric; the alphabetically first one on a tie."""
    rows = metrics.select(model, "mae", "rmse", "mape", (-F.col("r2")).alias("r2"))
    long = rows.unpivot([model], ["mae", "rmse", "mape", "r2"], "metric", "score").where(F.col("score").isNotNull())
    best = long.groupBy("metric").agg(F.min(F.struct("score", model)).alias("_best"))
    score = F.col("_best.score")
    return best.select(
        "metric",
        F.col(f"_best.{model}").alias(model),
        F.when(F.col("metric") == "r2", -score).otherwise(score).alias("score"),
    )


def mae_by_hour(df: DataFrame, by: Sequence[str], hour: str, actual: str, predicted: str) -> DataFrame:
    """Mean absolute error per local hour over finite pairs, all 24 hours present."""
    error = abs_error(F.col(actual), F.col(predicted))
    errors = df.withColumn("_err", F.when(is_finite(error), error))
    found = profile_mean(errors, by, hour, "_err").withColumnRenamed("mean", "mae")
    return reindex_domain(found, by, hour, 0, 23)


def error_histogram(df: DataFrame, by: Sequence[str], actual: str, predicted: str, bins: int = 60) -> DataFrame:
    """Distribution of the signed error over finite pairs."""
    return histogram(error_columns(df, actual, predicted).where("is_finite"), by, "error", bins)


def distinct_models(df: DataFrame, model: str) -> DataFrame:
    return df.select(model).distinct().orderBy(model)
