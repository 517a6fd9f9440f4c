"""Ordering, top-k, sampling and concatenation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_series(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Final ordering of a result; operators themselves never rely on row order."""
    return df.orderBy(*by)


def top_k_importance(importance: DataFrame, k: int = 15) -> DataFrame:
    """The k highest, each partition keeping only its own k."""
    return importance.orderBy(F.desc("importance"), "feature").limit(k)


def sample_cap(df: DataFrame, n: int, keys: Sequence[str], ts: str, seed: int = 42) -> DataFrame:
    """Everything if there are at most ``n`` rows, else exactly ``n`` of them, in time order.

    Rows are ranked by a hash of their key, so the choice is uniform and repeatable. The rows are
    counted first; then only those below a rank that slightly more than ``n`` rows should have
    are ordered, so the partitions together, not each of them, send about ``n`` rows on. If
    repeated keys leave fewer than ``n`` below it, the rank is raised.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    ranks = df.select(F.md5(text).alias("_rank"))
    total = ranks.count()
    if total <= n:
        return df.orderBy(ts, *keys)
    share = (n + 6 * math.sqrt(n) + 16) / total
    while share < 1 and ranks.where(F.col("_rank") < _rank_at(share)).count() < n:
        share *= 2
    near = df.withColumn("_rank", F.md5(text))
    if share < 1:
        near = near.where(F.col("_rank") < _rank_at(share))
    return near.orderBy("_rank", *keys).limit(n).drop("_rank").orderBy(ts, *keys)


def _rank_at(share: float) -> str:
    """The hexadecimal rank that this share of all hashes lies below."""
    return f"{int(share * 2**52):013x}"


def union_files(*frames: DataFrame) -> DataFrame:
    """Concatenate by column name, keeping duplicates."""
    return reduce(lambda a, b: a.unionByName(b), frames)
