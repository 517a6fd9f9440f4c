"""Parquet tables partitioned by month of their time column, with insert-if-absent loads.

Every load writes a folder of its own and then commits it by creating one empty file below ``_committed``.
Readers take committed loads only, so a load is there as a whole or not at all; one that failed
part-way is run again. Plain Parquet has no row-level merge: each table has one writer at a time.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import is_finite
from tidemark.operators.joins import anti_existing
from tidemark.operators.keyed import settled
from tidemark.operators.windows import dedupe_first
from tidemark.sources.schemas import KEYS, PREDICTIONS, REQUIRED, TABLES, fit_schema

MONTH = "month"


COMMITTED = "_committed"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, system = _file_system(spark, path)
    return system.exists(where)


def load_name() -> str:
    """Names of loads sort by the time they began."""
    return f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"


def committed_loads(spark: SparkSession, path: str) -> list[str] | None:
    """Names of the loads that readers see; None if the table is not written by loads."""
    where, system = _file_system(spark, f"{path}/{COMMITTED}")
    if not system.exists(where):
        return None
    return sorted(s.getPath().getName() for s in system.listStatus(where))


def commit_load(spark: SparkSession, path: str, name: str) -> None:
    """Make a written load visible, by creating one file."""
    where, system = _file_system(spark, f"{path}/{COMMITTED}/{name}")
    system.create(where, False).close()


def read_table(spark: SparkSession, path: str, schema: T.StructType, loads: Sequence[str] | None = None) -> DataFrame:
    """The stored table with its month partition column; empty if nothing was written yet.

    ``loads`` picks some of the committed loads. A table that is not written by loads is read as it stands.
    """
    full = T.StructType([*schema.fields, T.StructField(MONTH, T.StringType())])
    seen = committed_loads(spark, path)
    if seen is None and exists(spark, path):
        return spark.read.schema(full).parquet(path)
    wanted = [x for x in seen or [] if loads is None or x in loads]
    if not wanted:
        return spark.createDataFrame([], full)
    rows = spark.read.schema(full).option("basePath", path).parquet(*[f"{path}/load={x}" for x in wanted])
    return rows.select(*full.fieldNames())


def with_month(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(MONTH, F.date_format(F.col(ts), "yyyy-MM"))


def insert_summary(attempted: int, inserted: int) -> dict[str, int]:
    """Attempted, inserted and ignored rows of one load."""
    return {"attempted": attempted, "inserted": inserted, "ignored": attempted - inserted}


def insert_if_absent(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    tie_break: Sequence[str] = (),
    schema: T.StructType | None = None,
    ts: str | None = None,
) -> dict[str, int]:
    """Append the rows whose key is neither in the table nor earlier in the batch.

    Existing rows are never changed. Within the batch the smallest row by ``tie_break`` (then
    by the remaining columns) wins. Columns outside ``schema`` serve as tie-break only.
    The batch is evaluated once, into a staged table; its rows and months are counted while it is written.
    Only the table partitions between the batch's first and last month are read. New rows are
    rebalanced by month, which keeps files few and splits a month that is too large for one task, and
    become visible together, when the load is committed.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("the key columns must not be empty")
    absent = [c for c in keys if c not in df.columns]
    if absent:
        raise ValueError(f"key columns {absent} are not among {df.columns}")
    schema = schema or T.StructType([f for f in df.schema if f.name not in tie_break or f.name in keys])
    ts = ts or keys[0]

    helpers = [c for c in tie_break if c not in schema.fieldNames()]
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], *helpers)
    given = Observation()
    month = F.date_format(F.col(ts), "yyyy-MM")
    batch = settled(typed.observe(given, F.min(month).alias("lo"), F.max(month).alias("hi"), F.count(F.lit(1)).alias("n")), "batch")
    count = given.get
    if not count["n"]:
        return insert_summary(0, 0)

    first = dedupe_first(batch, keys, tie_break).drop(*helpers)
    stored = read_table(spark, path, schema).where(F.col(MONTH).between(count["lo"], count["hi"]))
    where, system = _file_system(spark, f"{path}/{COMMITTED}")
    system.mkdirs(where)
    name, watch = load_name(), Observation()
    (
        with_month(anti_existing(first, stored, keys), ts)
        .select(*schema.fieldNames(), MONTH)
        .hint("rebalance", MONTH)
        .observe(watch, F.count(F.lit(1)).alias("inserted"))
        .write.partitionBy(MONTH)
        .parquet(f"{path}/load={name}")
    )
    inserted = watch.get["inserted"]
    if inserted:
        commit_load(spark, path, name)
    return insert_summary(count["n"], inserted)


def load_table(spark: SparkSession, df: DataFrame, root: str, table: str, tie_break: Sequence[str] = ()) -> dict[str, int]:
    """Insert into one of the known tables below ``root``.

    Rows lacking a required cell are not stored but counted, as ``rejected``: attempted is the sum of
    inserted, ignored and rejected.
    """
    watch = Observation()
    df = df.observe(watch, F.count(F.lit(1)).alias("given"))
    schema, keys = TABLES[table], KEYS[table]
    helpers = [c for c in tie_break if c not in schema.fieldNames()]
    known = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in df.columns], *helpers)
    complete = known.dropna(subset=list(REQUIRED[table]))
    summary = insert_if_absent(spark, complete, f"{root}/{table}", keys, tie_break, schema, keys[0])
    return with_rejected(summary, watch.get["given"] - summary["attempted"])


def with_rejected(summary: dict[str, int], rejected: int) -> dict[str, int]:
    """Count rows that were given but not fit to store."""
    return summary | {"attempted": summary["attempted"] + rejected, "rejected": summary.get("rejected", 0) + rejected}


def shape_predictions(
    df: DataFrame, barra: str, model_name: str, model_version: str, horizon_h: int | str = 1,
    ts: str = "datetime", predicted: str = "predicted", actual: str = "actual",
) -> DataFrame:
    """Rows for the predictions table: finite predictions only, non-finite actuals NULL.

    ``barra`` and ``horizon_h`` may name columns; horizons outside 1..24 are left out.
    """
    bus = F.col(barra) if barra in df.columns else F.lit(barra)
    horizon = F.col(horizon_h) if isinstance(horizon_h, str) else F.lit(horizon_h)
    p, a = F.col(predicted).cast("double"), F.col(actual).cast("double")
    shaped = df.where(is_finite(p) & horizon.between(1, 24)).select(
        F.col(ts).alias("datetime"), bus.alias("barra"), F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"), p.alias("predicted_cmg"),
        F.when(is_finite(a), a).alias("actual_cmg"), horizon.alias("horizon_h"),
    )
    return fit_schema(shaped, PREDICTIONS)


def write_predictions(spark: SparkSession, df: DataFrame, root: str, **shape) -> dict[str, int]:
    """Insert predictions that are not stored yet; those not finite or outside the horizon count as rejected."""
    watch = Observation()
    shaped = shape_predictions(df.observe(watch, F.count(F.lit(1)).alias("given")), **shape)
    summary = load_table(spark, shaped, root, "predictions")
    return with_rejected(summary, watch.get["given"] - summary["attempted"])


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """Metrics report, one row per model."""
    metrics.write.mode("overwrite").option("header", True).csv(path)


def materialize_features(wide: DataFrame, path: str, ts: str = "datetime") -> None:
    """Write the joined hourly table, replacing only the months it contains."""
    (
        with_month(wide, ts)
        .hint("rebalance", MONTH)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(MONTH)
        .parquet(path)
    )


def touched_months(spark: SparkSession, path: str, loads: Sequence[str], ts: str, schema: T.StructType, around: int = 0) -> set[str]:
    """Months (yyyy-MM) of the rows that these loads added, and of ``around`` days on each side of them."""
    rows = read_table(spark, path, schema, loads)
    days = F.array(*[F.date_add(F.to_date(ts), n) for n in range(-around, around + 1)])
    found = rows.select(F.explode(days).alias("day")).select(F.date_format("day", "yyyy-MM").alias("m")).distinct()
    return {r["m"] for r in found.collect()}


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)
