"""Boosted-tree forecaster: fit, score, importance.

Boosting goes round by round: a tree is grown on the residuals by Spark's distributed histograms, the
predictions of training and validation rows move on, and the validation error decides when to stop. The
rounds after the best one are cut off the fitted model; nothing is fitted twice. With a checkpoint
folder every round is stored, and a fit that was interrupted goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, ElementwiseProduct, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor, GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keyed import settled
from tidemark.operators.quantiles import quantile_exact
from tidemark.session import ensure_checkpoint_dir
from tidemark.sinks.tables import exists

# Learner settings.
ROUNDS = 1000
RATE = 0.05
DEPTH = 6
ROW_SHARE = 0.8
COLUMN_SHARE = 0.8
PATIENCE = 50
SEED = 42
BINS = 32
#: Rounds after which the rows' predictions are stored, so that plans stay short.
STORE_EVERY = 10


@dataclass(frozen=True)
class Trees:
    """How a single tree is grown."""

    depth: int = DEPTH
    min_leaf: int = 1
    row_share: float = ROW_SHARE
    column_share: float = COLUMN_SHARE


def model_rows(matrix: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Complete rows, with every feature and the target as double."""
    numeric = {c: F.col(c).cast("double") for c in (*features, target)}
    return matrix.dropna(subset=[*features, target]).withColumns(numeric)


def best_round(errors: Sequence[float], patience: int) -> int:
    """Rounds to keep: the best one seen before ``patience`` rounds passed without improvement."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def feature_bins(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> tuple[Bucketizer, VectorAssembler]:
    """Stages that replace each feature by its bin between the exact quantiles of ``rows``."""
    names = [f"_q{i}" for i in range(1, bins)]
    long = rows.select(*features).unpivot([], list(features), "_feature", "_x")
    found = quantile_exact(long, ["_feature"], "_x", [i / bins for i in range(1, bins)], names).collect()
    edges = {r["_feature"]: sorted({r[n] for n in names if np.isfinite(r[n])}) for r in found}
    infinite = float("inf")
    splits = [[-infinite, *(edges.get(c) or [0.0]), infinite] for c in features]
    binned = [f"_bin_{c}" for c in features]
    cut = Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=binned, handleInvalid="keep")
    return cut, VectorAssembler(inputCols=binned, outputCol="_features")


def joined_trees(spark: SparkSession, trees: Sequence[DecisionTreeRegressionModel], weights: Sequence[float], n_features: int) -> GBTRegressionModel:
    """One boosted model of the given trees."""
    gateway, regression = spark.sparkContext._gateway, spark._jvm.org.apache.spark.ml.regression
    own = gateway.new_array(regression.DecisionTreeRegressionModel, len(trees))
    shares = gateway.new_array(gateway.jvm.double, len(trees))
    for i, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        own[i], shares[i] = tree._java_obj, float(weight)
    model = GBTRegressionModel(regression.GBTRegressionModel("boosted", own, shares, n_features))
    return model.setFeaturesCol("_features").setPredictionCol("predicted")


class _Progress:
    """Rounds stored below a folder: every tree, and the validation error after it."""

    def __init__(self, spark: SparkSession, path: str | None):
        self.spark, self.path = spark, path

    def load(self) -> tuple[list[DecisionTreeRegressionModel], list[float | None]]:
        if self.path is None or not exists(self.spark, f"{self.path}/errors"):
            return [], []
        rows = self.spark.read.schema("round int, error double").parquet(f"{self.path}/errors").orderBy("round").collect()
        return [DecisionTreeRegressionModel.load(f"{self.path}/trees/{r['round']:05d}") for r in rows], [r["error"] for r in rows]

    def add(self, number: int, tree: DecisionTreeRegressionModel, error: float | None) -> None:
        if self.path is None:
            return
        tree.write().overwrite().save(f"{self.path}/trees/{number:05d}")
        # Written last: a round without its error does not count.
        row = self.spark.createDataFrame([(number, error)], "round int, error double")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/errors/at={number:05d}")


def fit_gbt(
    train: DataFrame,
    features: Sequence[str],
    target: str,
    validation: DataFrame | None = None,
    rounds: int = ROUNDS,
    patience: int = PATIENCE,
    seed: int = SEED,
    trees: Trees = Trees(),  # noqa: B008
    checkpoint: str | None = None,
    on_round: Callable[[int, float | None], None] | None = None,
) -> PipelineModel:
    """Boosted regression trees; with a validation set, as many rounds as its MAE supports.

    Fitting stops when the error has not improved for ``patience`` rounds. The first tree counts in full, the
    later ones with the learning rate. Every tree sees its own sample of
    rows (by row number, so a repeated round sees the same) and of columns. ``checkpoint`` names a
    folder for the rounds done; called again with the same arguments and folder, fitting goes on.
    ``on_round`` is told each round's number and validation error.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    rows = model_rows(train, features, target).select(*features, F.col(target).alias("_y"))
    rows = settled(rows.withColumn("_row", F.monotonically_increasing_id()), "train")
    if rows.isEmpty():
        raise ValueError("no training row has all features and the target")
    cut, gather = feature_bins(rows, features)

    def prepared(df: DataFrame, name: str) -> DataFrame:
        # Bins are ordered numbers; as the categories that Bucketizer marks them to be they would be split into sets.
        plain = cut.transform(df).withColumns({c: F.col(c) + F.lit(0.0) for c in cut.getOutputCols()})
        binned = gather.transform(plain).select("_features", "_y", "_row", F.lit(0.0).alias("_f"))
        return settled(binned, name)

    learned = prepared(rows, "train-bins")
    held_out = None
    if validation is not None:
        known = model_rows(validation, features, target).select(*features, F.col(target).alias("_y"), F.lit(0).cast("long").alias("_row"))
        held_out = prepared(known, "validation-bins")
        held_out = None if held_out.isEmpty() else held_out

    progress = _Progress(spark, checkpoint)
    grown, errors = progress.load()

    def moved(df: DataFrame, tree: DecisionTreeRegressionModel, weight: float) -> DataFrame:
        out = tree.setFeaturesCol("_features").setPredictionCol("_p").transform(df)
        return out.withColumn("_f", F.col("_f") + F.lit(weight) * F.col("_p")).drop("_p")

    def grow(number: int) -> DecisionTreeRegressionModel:
        sample, column = learned.withColumn("_r", F.col("_y") - F.col("_f")), "_features"
        if number and trees.row_share < 1:
            sample = sample.where(F.pmod(F.xxhash64(F.lit(seed + number), "_row"), F.lit(1 << 20)) < int(trees.row_share * (1 << 20)))
        if number and trees.column_share < 1:
            chosen = np.random.default_rng([seed, number]).permutation(len(features))[: max(1, round(trees.column_share * len(features)))]
            mask = np.isin(np.arange(len(features)), chosen).astype(float)
            sample = ElementwiseProduct(scalingVec=Vectors.dense(mask), inputCol="_features", outputCol="_some").transform(sample)
            column = "_some"
        learner = DecisionTreeRegressor(
            featuresCol=column, labelCol="_r", maxDepth=trees.depth if number else 0, maxBins=BINS + 1,
            minInstancesPerNode=trees.min_leaf, seed=seed,
        )
        return learner.fit(sample)

    for number in range(rounds + 1):  # round 0 is the mean
        if errors and held_out is not None and len(errors) > 1 and len(errors) - 1 - best_round(errors[1:], patience) >= patience:
            break
        again = number < len(grown)
        tree = grown[number] if again else grow(number)
        weight = RATE if number > 1 else 1.0
        learned = moved(learned, tree, weight)
        held_out = moved(held_out, tree, weight) if held_out is not None else None
        if number and number % STORE_EVERY == 0:
            learned = settled(learned, "train-bins")
            held_out = settled(held_out, "validation-bins") if held_out is not None else None
        if again:
            continue
        error = None
        if held_out is not None:
            error = held_out.agg(F.avg(F.abs(F.col("_y") - F.col("_f"))).alias("e")).first()["e"]
        progress.add(number, tree, error)
        grown, errors = [*grown, tree], [*errors, error]
        if on_round:
            on_round(number, error)
    keep = best_round(errors[1:], patience) if held_out is not None and len(errors) > 1 else len(grown) - 1
    kept = grown[: keep + 1]
    model = joined_trees(spark, kept, [1.0, 1.0, *[RATE] * len(kept)][: len(kept)], len(features))
    return PipelineModel([cut, gather, model])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``predicted``; rows keep their keys and time."""
    cut, gather = model.stages[:2]
    return model.transform(df).drop(*cut.getOutputCols(), gather.getOutputCol())


def feature_importance(model: PipelineModel) -> DataFrame:
    """(feature, importance), one row per model input."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(w)) for name, w in zip(model.stages[0].getInputCols(), weights, strict=True)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double")
