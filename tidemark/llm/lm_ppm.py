"""Language-model scores by prediction by partial matching over bytes.

Training counts every (context, byte) pair of the longest order; shorter orders are sums of it, so
the byte-context trie is a family of tables. A byte is predicted in the longest context that
training has seen; a byte that is new there costs an escape, d / (T + d) for d distinct bytes among
T, and is predicted one byte shorter with the bytes of the left context excluded. The bytes known
to a context are known to its suffix, so what is excluded there is one number per context, and a
byte's code length depends on nothing but its (context, byte) pair: it is computed once per
distinct pair, level by level, with one join and one window (at most 256 rows each) per order.
Texts then add up the code lengths of their pairs. Beside it stands an add-one unigram baseline.

Both feature families, pairs and words, are served by ``hot_table``: the heaviest, at most
``hot_pairs`` and ``hot_words``, are in every task; occurrences of all others are joined. No count
is capped or sampled. Words and pairs are 64-bit keys; words by xxh3, whose collisions are
negligible below some 10^8 distinct words.

Texts are lower-cased A-Z. Defined results: NULL is the empty text, one end symbol. With nothing
to train on, every byte and the end have probability 1/255. Repeated rows and ids count and are
scored as often as they stand there. Columns besides the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import as_bytes, bounded_batches, slices
from tidemark.llm.hot_table import HashTable, hot_from, merge_counts
from tidemark.operators.keyed import settled

PAD, END = 0xFE, 0xFF  # never in UTF-8
ALPHABET = 255  # every byte but the padding
WORD, PAIR = 0, 1
END_WORD = xxhash.xxh3_64_intdigest(b" ")
FLUSH = 1 << 22


@dataclass(frozen=True)
class Settings:
    """Context length in bytes (at most 6) and the bounds of the two tables held by every task."""

    order: int = 5
    hot_pairs: int = 1 << 20
    hot_words: int = 1 << 19
    slice_bytes: int = 1 << 20


@dataclass(frozen=True)
class Model:
    settings: Settings
    tokens: int
    vocabulary: int
    words: Broadcast
    pairs: Broadcast
    cold: DataFrame


def words_of(text: bytes) -> np.ndarray:
    """Hashes of the words and the end."""
    words = text.split()
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END_WORD
    return out.view(np.int64)


def pairs_of(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) pairs of all texts, packed with the byte lowest, and the first pair of each text."""
    pad, end = bytes([PAD]) * order, bytes([END])
    a = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    packed = np.zeros(max(len(a) - order, 0), np.int64)
    for j in range(order + 1):
        packed <<= 8
        packed |= a[j : len(a) - order + j]
    # A text's symbols begin ``order`` bytes after its padding; windows that end in padding go.
    first = np.cumsum(sizes) - sizes
    keep = np.repeat(first + order * np.arange(len(texts)) - first, sizes) + np.arange(int(sizes.sum()))
    return packed[keep], first


def count_features(docs: DataFrame, train: Column, settings: Settings) -> DataFrame:
    """(kind, key, n): training count of each word and pair; pairs of other texts count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = {WORD: [], PAIR: []}, {WORD: [], PAIR: []}

        def add(kind: int, k: np.ndarray, seen: bool) -> None:
            if len(k):
                k = np.sort(k)
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                keys[kind].append(k[first])
                counts[kind].append(np.diff(np.append(first, len(k))) if seen else np.zeros(len(first), np.int64))

        def merged(kind: int) -> Iterator[pa.RecordBatch]:
            if keys[kind]:
                k, n = merge_counts(keys[kind], counts[kind])
                keys[kind], counts[kind] = [], []
                for i in range(0, len(k), 1 << 16):
                    part = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k[part]), kind, np.int32)), pa.array(k[part]), pa.array(n[part])],
                        names=["kind", "key", "n"],
                    )

        def compact(kind: int) -> None:
            k, n = merge_counts(keys[kind], counts[kind])
            keys[kind], counts[kind] = [k], [n]

        for b in batches:
            texts, seen = [t.lower() for t in as_bytes(b.column(0))], b.column(1).to_numpy(zero_copy_only=False)
            for i, j in slices(texts, settings.slice_bytes):
                for flag in (True, False):
                    part = [t for t, s in zip(texts[i:j], seen[i:j], strict=True) if s == flag]
                    if part:
                        add(PAIR, pairs_of(part, settings.order)[0], flag)
                        if flag:
                            add(WORD, np.concatenate([words_of(t) for t in part]), True)
                for kind in (WORD, PAIR):
                    if sum(map(len, keys[kind])) > FLUSH:
                        compact(kind)
                        if len(keys[kind][0]) > FLUSH // 2:
                            yield from merged(kind)
        for kind in (WORD, PAIR):
            yield from merged(kind)

    text = F.col("text").cast("string").alias("text")
    rows = docs.select(text, train.alias("train")).mapInArrow(run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def code_lengths(pairs: DataFrame, order: int) -> DataFrame:
    """(key, n, p): log10 probability of each pair, from the training counts (key, n)."""
    levels = [pairs.select("key", "n")]
    for k in range(order - 1, -1, -1):
        mask = (1 << (8 * (k + 1))) - 1
        levels.insert(0, levels[0].groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n")))
    n, total, kinds = F.col("n"), F.col("total"), F.col("kinds")

    def of_context(w) -> dict[str, Column]:
        return {"total": F.sum("n").over(w), "kinds": F.sum((n > 0).cast("long")).over(w)}

    seen = F.log10(n / (total + kinds))
    escape = F.log10(kinds / (total + kinds))
    # The root: at most 256 rows.
    known = levels[0].withColumns(of_context(Window.partitionBy(F.lit(0))))
    rest = F.log10(1 / (F.lit(float(ALPHABET)) - kinds))
    known = known.withColumn("after", F.when(n == 0, rest)).withColumn(
        "p", F.when(n > 0, seen).when(total > 0, escape + F.col("after")).otherwise(rest)
    )
    for k in range(1, order + 1):
        mask = (1 << (8 * k)) - 1
        shorter = known.select(*[F.col(c).alias(f"s_{c}") for c in ("key", "n", "total", "kinds", "after", "p")])
        w = Window.partitionBy("context")
        level = (
            levels[k]
            .withColumn("context", F.shiftright("key", 8))
            .join(shorter, F.col("key").bitwiseAND(F.lit(mask)) == F.col("s_key"), "left")
            .withColumns(of_context(w) | {"out": F.sum(F.when(n > 0, F.col("s_n")).otherwise(0)).over(w)})
        )
        new_kinds = F.col("s_kinds") - kinds
        room = F.col("s_total") - F.col("out") + new_kinds
        after = F.when(F.col("s_n") > 0, F.log10(F.col("s_n") / room)).otherwise(
            F.col("s_after") + F.when(new_kinds > 0, F.log10(new_kinds / room)).otherwise(0.0)
        )
        known = level.withColumn("after", F.when((n == 0) & (total > 0), after)).withColumn(
            "p", F.when(n > 0, seen).when(total > 0, escape + F.col("after")).otherwise(F.col("s_p"))
        )
        known = known.select("key", "n", "total", "kinds", "after", "p")
    return known.select("key", "n", "p")


def _table(df: DataFrame, value: str) -> Broadcast:
    rows = df.select("key", value).toArrow()
    table = HashTable(rows.column("key").to_numpy(), rows.column(value).to_numpy())
    return df.sparkSession.sparkContext.broadcast(table.arrays())


def train_ppm(docs: DataFrame, train: Column, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Train on the rows for which ``train`` holds; pairs of the others get code lengths, too.

    At most ``hot_pairs`` + ``hot_words`` entries of 16 bytes pass the driver; both tables' other
    rows stay in the shared folder.
    """
    bounded_batches(docs.sparkSession)
    features = settled(count_features(docs, train, settings), "lm-counts")
    words = features.where(F.col("kind") == WORD)
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    pairs = settled(code_lengths(features.where(F.col("kind") == PAIR), settings.order), "lm-pairs")
    word_from, pair_from = hot_from(words, "n", settings.hot_words), hot_from(pairs, "n", settings.hot_pairs)
    hot_word, hot_pair = F.col("n") + 1 >= word_from, F.col("n") + 1 >= pair_from
    cold_words = words.where(~hot_word).select(
        F.lit(WORD).alias("kind"), "key", F.log10(F.col("n") + 1.0).alias("value")
    )
    cold_pairs = pairs.where(~hot_pair).select(F.lit(PAIR).alias("kind"), "key", F.col("p").alias("value"))
    return Model(
        settings,
        sums["n"],
        sums["v"],
        _table(words.where(hot_word), "n"),
        _table(pairs.where(hot_pair), "p"),
        cold_words.unionByName(cold_pairs),
    )


def score_ppm(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    settings, denominator = model.settings, float(np.log10(model.tokens + model.vocabulary + 1))
    word_table, pair_table = model.words, model.pairs
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("row", T.LongType()), T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType())]
        + [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "kind", "key", "times")]
        + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_row = TaskContext.get().partitionId() << 40
        words, pairs = HashTable.of(word_table.value), HashTable.of(pair_table.value)

        def missing(kind: int, row: np.ndarray, key: np.ndarray, like: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Occurrences of features that are not in memory, counted by row."""
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]))
            times = np.diff(np.append(first, len(row)))
            none = pa.nulls(len(first), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row[first]), pa.nulls(len(first), like.schema.field(0).type), pa.nulls(len(first), pa.bool_()),
                    none, none, pa.array(np.full(len(first), kind)), pa.array(key[first]), pa.array(times),
                    none.cast(pa.float64()), none.cast(pa.float64()),
                ],
                names=schema.names,
            )

        for b in batches:
            texts = [t.lower() for t in as_bytes(b.column(2))]
            for i, j in slices(texts, settings.slice_bytes):
                part = texts[i:j]
                rows = np.arange(next_row, next_row + len(part))
                next_row += len(part)
                tokens = [words_of(t) for t in part]
                sizes = np.array([len(t) for t in tokens])
                first = np.cumsum(sizes) - sizes
                tokens = np.concatenate(tokens)
                n, found = words.get(tokens)
                gain = np.where(found, np.log10(n + 1.0), 0.0)
                base = np.add.reduceat(gain, first) - sizes * denominator
                known = np.add.reduceat(found.astype(np.int64), first)
                if not found.all():
                    lost = np.flatnonzero(~found)
                    yield from missing(WORD, np.repeat(rows, sizes)[lost], tokens[lost], b)
                keys, begin = pairs_of(part, settings.order)
                p, found = pairs.get(keys)
                score = np.add.reduceat(np.where(found, p, 0.0), begin)
                if not found.all():
                    lost = np.flatnonzero(~found)
                    yield from missing(PAIR, np.repeat(rows, np.diff(np.append(begin, len(keys))))[lost], keys[lost], b)
                none = pa.nulls(len(part), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(rows), b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(sizes),
                        pa.array(known), none, none, none, pa.array(base), pa.array(score),
                    ],
                    names=schema.names,
                )

    source = docs.select("doc_id", held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    # Written once: row numbers given by a task must be the same for both uses.
    parts = settled(source.mapInArrow(run, schema), "lm-scores")
    word, pair, times = F.col("kind") == WORD, F.col("kind") == PAIR, F.col("times")
    rest = (
        parts.where(F.col("kind").isNotNull())
        .select("row", "kind", "key", "times")
        .join(model.cold, ["kind", "key"])
        .groupBy("row")
        .agg(
            F.sum(F.when(word, times)).alias("more_known"),
            F.sum(F.when(word, times * F.col("value"))).alias("more_base"),
            F.sum(F.when(pair, times * F.col("value"))).alias("more_score"),
        )
    )

    def plus(c: str, more: str) -> Column:
        return (F.col(c) + F.coalesce(F.col(more), F.lit(0))).alias(c)

    return (
        parts.where(F.col("kind").isNull())
        .join(rest, "row", "left")
        .select(
            "doc_id", "held_out", "n_tokens", plus("n_known", "more_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
            plus("base_score", "more_base"), plus("score", "more_score"),
        )
    )
