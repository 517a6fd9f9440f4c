"""Text work in Arrow batches: rows go through Python a slice of bounded bytes at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once; longer texts are handled alone.
SLICE_BYTES = 4 << 20
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

ARROW = {
    T.LongType(): pa.int64(),
    T.IntegerType(): pa.int32(),
    T.DoubleType(): pa.float64(),
    T.BooleanType(): pa.bool_(),
    T.StringType(): pa.string(),
    T.BinaryType(): pa.binary(),
    T.ArrayType(T.LongType()): pa.list_(pa.int64()),
    T.ArrayType(T.IntegerType()): pa.list_(pa.int32()),
}

#: Takes texts as UTF-8 (NULL as empty) and gives one sequence of values per new column.
Columns = Callable[[list[bytes]], Sequence]


def as_bytes(column: pa.Array) -> list[bytes]:
    """Text cells as UTF-8; NULL as the empty text."""
    if column.null_count:
        return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    return column.cast(pa.binary()).to_pylist()


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding at most ``limit`` bytes, or one row."""
    start = size = 0
    for i, x in enumerate(texts):
        if i > start and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def bounded_batches(spark: SparkSession) -> None:
    """Hand over batches of at most ``SLICE_BYTES``, unless the session has a bound of its own.

    Spark's default lets a batch grow to 64 MB; it then lies in the executor's off-heap memory,
    twice while it grows, and once more in the Python worker, for every task that runs there.
    """
    if spark.conf.get(BATCH_BYTES, "64m") == "64m":
        spark.conf.set(BATCH_BYTES, f"{SLICE_BYTES}b")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def add_columns(df: DataFrame, ddl: str, make: Callable[[], Columns], text: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``df`` with the columns of ``ddl``, computed from its text column.

    ``make`` runs once per task, so that a model or table is unpacked once. Columns of ``df``
    that have a new column's name are replaced. A text column that is kept crosses to Python once.
    """
    bounded_batches(df.sparkSession)
    new = T.StructType.fromDDL(ddl)
    names = {f.name.lower() for f in new}
    kept = [c for c in df.columns if c.lower() not in names]
    source = free_name(df, "text_")
    schema = T.StructType([f for f in df.schema if f.name in kept] + list(new))
    kinds = [ARROW[f.dataType] for f in new]
    own_text = text in kept and isinstance(df.schema[text].dataType, T.StringType)
    text_at = kept.index(text) if own_text else len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            texts = as_bytes(batch.column(text_at))
            for a, b in slices(texts, limit):
                made = [pa.array(v, k) for v, k in zip(compute(texts[a:b]), kinds, strict=True)]
                own = [batch.column(i).slice(a, b - a) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays(own + made, names=schema.names)

    columns = [F.col(f"`{c}`") for c in kept]
    if not own_text:
        columns.append(F.col(f"`{text}`").cast("string").alias(source))
    return df.select(*columns).mapInArrow(run, schema)


def hashed_share(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves ``remainder``; false for NULL ids."""
    c = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(c % modulus == remainder, F.lit(False))
