"""Price files as they arrive.

The file source remembers in its checkpoint which files it has read, and the insert is
idempotent, so a batch repeated after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.clock import DEFAULT_TZ
from tidemark.session import prepare
from tidemark.sinks.tables import load_table
from tidemark.sources.files import PRICE_OPTIONS, PRICE_SCHEMA, price_cells, quarantine, type_prices


def stream_prices(
    spark: SparkSession,
    directory: str,
    root: str,
    checkpoint: str,
    barra: str | None = None,
    bus_map: Mapping[str, str] | None = None,
    tz: str = DEFAULT_TZ,
    max_files: int = 1000,
) -> StreamingQuery:
    """Load every file not loaded yet, then stop; start it again for the next arrivals.

    Lines are read as a batch reads them. Lines without a usable time or bus, or with too many cells, go
    to ``quarantine/arrivals`` below ``root``, one folder per batch. Only observed, non-negative prices are stored. The hours they leave open are filled by the
    batch load, and a late observation still takes an open hour.
    """
    prepare(spark)
    raw = (
        spark.readStream.schema(PRICE_SCHEMA).options(**PRICE_OPTIONS, maxFilesPerTrigger=str(max_files)).csv(directory)
    )
    typed = type_prices(price_cells(raw), bus_map, barra, tz)

    def store(batch: DataFrame, number: int) -> None:
        bad = batch.where(F.col("reason").isNotNull()).select("file", "line", "reason")
        # A repeated batch replaces its own folder.
        bad.write.mode("overwrite").parquet(f"{root}/quarantine/arrivals/batch={number}")
        rows, _open = quarantine(batch.where(F.col("reason").isNull()), ["cmg_usd_mwh"])
        rows = rows.where(F.col("cmg_usd_mwh") >= 0).withColumn("is_imputed", F.lit(False))
        rows = rows.drop("file_date", "file", "line", "reason")
        load_table(spark, rows, root, "marginal_costs", tie_break=["file_hour"])

    return (
        typed.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
