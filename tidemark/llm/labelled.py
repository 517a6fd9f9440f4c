"""A bounded, balanced sample of labelled texts, for the classifiers that are fitted on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import hashed_share
from tidemark.operators.keyed import settled


@dataclass(frozen=True)
class Sample:
    """``rows``: (text, label), stored. ``prior``: share of label 1 among all rows that may be learned from."""

    rows: DataFrame
    prior: float
    size: int


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, per_class: int
) -> Sample:
    """At most ``per_class`` texts of each label, chosen by a hash of the id.

    Rows whose crc32(id) mod ``modulus`` is ``remainder`` are never read. Ids with a NULL or
    contradictory label are left out; equal texts count once. The chosen ids are the only side
    that is broadcast: two times ``per_class`` of them at most.
    """
    usable = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~hashed_share("doc_id", modulus, remainder))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
        .where("label = other AND label IN (0, 1)")
        .select("doc_id", "label")
    )
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.0
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    chosen = None
    for value in (0, 1):
        part = usable.where(F.col("label") == value).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = (
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy(F.xxhash64("text").alias("h"))
        .agg(F.max_by("text", "doc_id").alias("text"), F.max_by("label", "doc_id").alias("label"))
        .select("text", "label")
    )
    rows = settled(texts, "labelled")
    return Sample(rows, prior, rows.count())
