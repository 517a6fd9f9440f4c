"""The corpus pipeline: toxicity, quality rules, near duplicates, benchmark contamination, encoding.

Every stage takes what its predecessor kept, in full, and is written and reread before the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.catalog import TOKENIZERS
from tidemark.llm.decontaminate import contamination
from tidemark.llm.ngram_join import ngram_classes
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.sentencepiece_lattice import encode_texts, read_pieces
from tidemark.llm.toxicity import fit_toxicity, toxicity
from tidemark.operators.keyed import settled

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], accept: str) -> DataFrame:
    """Rows for which ``accept`` holds among the columns that ``judge`` adds.

    The other columns have numbers for names meanwhile, so that result columns cannot hide any of
    theirs and the text is handed over only once.
    """
    names = {c: "text" if c == "text" else f"column {i}" for i, c in enumerate(docs.columns)}
    judged = judge(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])).where(accept)
    return judged.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items()])


def _without(docs: DataFrame, dropped: DataFrame, how: str = "left_anti") -> DataFrame:
    """Rows whose (doc_id, text_hash) is not in ``dropped``; NULL ids are compared like others."""
    keys = dropped.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__hash"))
    return docs.join(keys, same, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    grammar = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _judged(docs, lambda rows: toxicity(rows, grammar), "predicted = 0")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _judged(docs, quality_rules, "kept")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the text with the smallest id, and one of its repeated rows."""
    rows = settled(ngram_classes(docs).groupBy("doc_id", "text_hash").agg(F.bool_or("stands").alias("stands"), F.count("*").alias("n")), "verdicts")
    single = _without(docs, settled(rows.where("NOT stands OR n > 1"), "dropped"))
    repeated = _without(docs, settled(rows.where("stands AND n > 1"), "repeated"), "left_semi")
    once = repeated.withColumn("__hash", F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return single.unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    return _without(docs, settled(found.select("doc_id", "text_hash").distinct(), "dropped"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, number of pieces, their ids, and whether these decode to the text."""
    pieces = read_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    return encode_texts(
        docs,
        pieces,
        "n_pieces long, ids array<int>, round_trip boolean",
        lambda text, ids, decoder: (len(ids), ids, decoder.decode(ids) == text),
        keep=("doc_id", "lang", "source"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

# The first stage applies a trained model, the last a lattice over a vocabulary file.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
