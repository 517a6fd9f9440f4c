"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import settled


def _hook(links: DataFrame) -> DataFrame:
    """Links (u, v), each joined with the smallest of u and all its v."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """(node, label): smallest node reachable, for every node of the links (u, v), directed either way.

    Each step is a grouped minimum (combined before the shuffle) and an equi-join, so a node with
    very many links is split like any skewed key. Steps are written to the shared folder; their
    number grows with the logarithm of the longest path.
    """
    both = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, mark = settled(both.distinct(), "links"), None
    while True:
        turned = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hook(turned).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Every link now leads to a smaller node.
        large = large.where("u <> v").distinct()
        found = _hook(large)
        small = (
            found.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(found.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = settled(small, "links")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == mark:
            break
        mark = (seen["n"], seen["h"])
    # Stars: every node points at the smallest of its component.
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
