"""Registry, table access and the common output form."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import prepare

Build = Callable[[SparkSession, str], DataFrame]

# Added before rounding on both sides, so that a value exactly half-way between two rounded
# values does not depend on the last bit of a floating-point sum.
NUDGE = 1e-9


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None = None
    floats: Mapping[str, int] = field(default_factory=dict)


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, floats: Sequence[str] | Mapping[str, int] = ()) -> Callable[[Build], Build]:
    """Register a query; ``floats`` are rounded alike (6 digits unless given) on both sides."""
    digits = dict(floats) if isinstance(floats, Mapping) else dict.fromkeys(floats, 6)

    def keep(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = Query(build, sql, digits)
        return build

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table with its naive times read as UTC instants."""
    prepare(spark)
    path = f"{sf_dir}/{name}.parquet"
    found = spark.read.parquet(path).schema
    instants = T.StructType(
        [T.StructField(f.name, T.TimestampType() if f.dataType == T.TimestampNTZType() else f.dataType) for f in found]
    )
    return spark.read.schema(instants).parquet(path)


def present(df: DataFrame, floats: Mapping[str, int]) -> DataFrame:
    """Output form: naive times, dates as text, 64-bit integers, doubles, rounded floats."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType
        if isinstance(kind, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        if f.name in floats:
            c = F.round(c + F.lit(NUDGE), floats[f.name])
        out.append(c.alias(f.name))
    return df.select(*out)


def queries() -> dict[str, Build]:
    def runner(q: Query) -> Build:
        return lambda spark, sf_dir: present(q.build(spark, sf_dir), q.floats)

    return {name: runner(q) for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, q in QUERIES.items():
        if q.sql is None:
            continue
        sql = q.sql.strip()
        if q.floats:
            swaps = ", ".join(f"round({c} + {NUDGE}, {n}) AS {c}" for c, n in q.floats.items())
            sql = f"SELECT * REPLACE ({swaps}) FROM (\n{sql}\n) AS result"
        found[name] = sql
    return found
