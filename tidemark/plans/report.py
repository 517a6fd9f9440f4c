"""From the feature matrix to stored predictions and a metrics report, as one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.frames import TEST_END, TRAIN_END, TRAIN_START, VAL_END, split_chronological
from tidemark.operators.keyed import settled
from tidemark.operators.metrics import regression_metrics, rounded_metrics, sort_metrics
from tidemark.operators.selection import top_k_importance
from tidemark.plans.features import FEATURES, TARGET
from tidemark.plans.forecast import feature_importance, fit_gbt, model_rows, score
from tidemark.sinks.tables import save_model, write_metrics_csv, write_predictions

PARTS = ("train", "val", "test")


@dataclass(frozen=True)
class Bounds:
    """First and last days of the parts; a side given as None is open."""

    train_end: str = TRAIN_END
    val_end: str = VAL_END
    train_start: str | None = TRAIN_START
    test_end: str | None = TEST_END


@dataclass(frozen=True)
class Report:
    model: PipelineModel
    #: split, mae, rmse, mape, r2, n_predictions of validation and test rows.
    metrics: DataFrame
    importance: DataFrame
    #: Counts of the predictions table.
    stored: dict[str, int]


def train_and_report(
    matrix: DataFrame,
    root: str,
    bounds: Bounds = Bounds(),  # noqa: B008
    features: Sequence[str] = FEATURES,
    target: str = TARGET,
    model_name: str = "gbt",
    model_version: str = "1.0",
    **fit,
) -> Report:
    """Fit on the training days, stop by the validation days, score both later parts.

    Below ``root``: the model, test predictions in the predictions table (inserted once), the metrics and the
    features of most weight as CSV. Rounds done are kept below ``checkpoints``, so a job that was
    interrupted goes on where it stopped. A part without any complete row is an error.
    """
    labelled = split_chronological(
        matrix, "datetime", bounds.train_end, bounds.val_end, train_start=bounds.train_start, test_end=bounds.test_end
    )
    rows = settled(model_rows(labelled.where(F.col("split").isNotNull()), features, target), "labelled")
    present = {r["split"] for r in rows.select("split").distinct().collect()}
    missing = [p for p in PARTS if p not in present]
    if missing:
        raise ValueError(f"no complete rows for {', '.join(missing)}")
    named = f"{model_name}/{model_version}"
    train, val = (rows.where(F.col("split") == p) for p in PARTS[:2])
    model = fit_gbt(train, features, target, val, checkpoint=f"{root}/checkpoints/{named}", **fit)
    scored = settled(score(model, rows.where(F.col("split") != "train")), "scored")

    save_model(model, f"{root}/models/{named}")
    test = scored.where(F.col("split") == "test")
    stored = write_predictions(
        matrix.sparkSession, test, root, barra="barra", model_name=model_name, model_version=model_version, predicted="predicted", actual=target
    )
    metrics = settled(regression_metrics(scored, ["split"], target, "predicted"), "metrics")
    importance = feature_importance(model)
    write_metrics_csv(sort_metrics(rounded_metrics(metrics), ["split"]), f"{root}/reports/{named}/metrics")
    write_metrics_csv(top_k_importance(importance), f"{root}/reports/{named}/importance")
    return Report(model, metrics, importance, stored)
