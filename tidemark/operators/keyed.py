"""Joins on series keys, shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_path


def require_keys(keys: Sequence[str]) -> list[str]:
    if not keys:
        raise ValueError("at least one key column is required")
    return list(keys)


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats NULL keys as equal and keeps the left copy of the keys.

    No side is hinted: the optimizer and AQE broadcast a side only after seeing its size,
    and AQE splits skewed partitions of a sort-merge join.
    """
    names = {k: f"__{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    matches = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return left.join(renamed, matches, how).drop(*names.values())


def settled(df: DataFrame, name: str = "summary") -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Two uses. A per-key summary about to be joined with its own input: before it runs, the
    optimizer guesses an aggregate to be as large as its input and would shuffle the big side,
    hot keys included; reading the written table it knows the true size, broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges above. And a frame that several
    later jobs read: it is computed once and survives the loss of executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
