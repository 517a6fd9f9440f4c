"""Exact Jaccard join of shingle sets by parity sketches.

A text is the set of its distinct k-word shingles (64-bit hashes). Two sets of Jaccard similarity t
or more differ in at most n (1 - t) / t elements, n being the smaller set's size. Texts of a size
band (sizes within a factor of two) deal their shingles by hash into L lanes and XOR what falls into
each: a differing element changes one lane, so with at most D differing elements at least L - D
lanes agree (pigeonhole). Lanes are ordered by rarity, so it suffices to join the D + 1 rarest; lanes
that hold nothing but widespread shingles, such as a passage many texts share, stay out of the join.
A text near the upper end of the band below also joins there. Candidates pass the length bound, then
the Hamming distance of one-bit-per-shingle parity sketches (a lower bound of the symmetric
difference), then the exact sets.

Only components are wanted, so no group is expanded into pairs: texts with equal sets are one node;
every lane key compares its nodes with the most connected of them, its center; only nodes that are
still in different components after that are compared with each other, directly under keys of few
nodes, by a prefix join of their differences to the center under others. No link is lost.

Skew: within a task equal sets emit keys once; keys whose shingles are widespread are salted while
shared keys are sought; joins on hot nodes are left to Spark's skew splitting.
What reaches tasks whole has a fixed size: ``cells`` counters and a filter of ``filter_bits`` bits.

Defined results: NULL, empty and blank texts have the empty set, size 0, and are linked with nothing;
their component is their own id. Fewer than k words make one shingle. Repeated rows and copies share
a component, named by the smallest id (NULL only if no member has one). Columns besides the id and the
text are ignored. Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemark.llm.arrow import as_bytes
from tidemark.llm.components import components
from tidemark.operators.keyed import settled

STEP = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


@dataclass(frozen=True)
class Settings:
    """Similarity as a percentage, so that the verdict is whole-number arithmetic."""

    shingle_words: int = 4
    percent: int = 85
    lane_slack: float = 1.25
    cells: int = 1 << 18
    filter_bits: int = 1 << 24
    salt_rows: int = 1 << 16
    direct_rows: int = 16

    def most_different(self, size: int) -> int:
        """Largest symmetric difference of a link whose smaller set has ``size`` elements."""
        return size * (100 - self.percent) // self.percent

    def lanes(self, band: int) -> int:
        return -int(-self.lane_slack * (self.most_different((2 << band) - 1) + 1) // 1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX1
    h = (h ^ (h >> np.uint64(33))) * MIX2
    return h ^ (h >> np.uint64(33))


def all_shingles(text: bytes, k: int) -> np.ndarray:
    """Hashes of all k-word shingles in order; of the whole text if it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(codes))
    h = np.full(len(codes) - k + 1, k, np.uint64)
    for j in range(k):
        h = h * STEP + codes[j : len(codes) - k + 1 + j]
    return mix(h)


def cell_counts(docs: DataFrame, settings: Settings) -> np.ndarray:
    """How many shingles of the corpus fall into each of ``cells`` cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(settings.cells, np.int64)
        for b in batches:
            for text in as_bytes(b.column(0)):
                h = all_shingles(text, settings.shingle_words)
                # Counting a text's few cells one by one beats a pass over all cells.
                cells, n = np.unique((h & np.uint64(settings.cells - 1)).view(np.int64), return_counts=True)
                total[cells] += n
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = rows.toArrow()
    counts = np.zeros(settings.cells, np.int64)
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return counts


def lane_keys(shingles: np.ndarray, band: int, wanted: int, counts: np.ndarray, settings: Settings):
    """Keys of the ``wanted`` rarest lanes of a set in a band, and each lane's rarity."""
    lanes = settings.lanes(band)
    lane = ((shingles >> np.uint64(32)) * np.uint64(lanes)) >> np.uint64(32)
    order = np.argsort(lane)
    s, lane = shingles[order], lane[order]
    first = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
    content = np.bitwise_xor.reduceat(s, first)
    rarity = np.minimum.reduceat(counts[(s & np.uint64(settings.cells - 1)).view(np.int64)], first)
    used = lane[first]
    if len(used) < wanted:  # lanes without a shingle agree, too; they are the least rare
        empty = np.setdiff1d(np.arange(lanes, dtype=np.uint64), used)
        used = np.concatenate([used, empty])
        content = np.concatenate([content, np.zeros(len(empty), np.uint64)])
        rarity = np.concatenate([rarity, np.full(len(empty), np.iinfo(np.int64).max)])
    key = mix(content + used * STEP + np.uint64((band + 1) * int(MIX1) % 2**64))
    pick = np.lexsort((key, rarity))[:wanted]
    return key[pick], rarity[pick]


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """One bit per shingle, flipped; 4 bits and more per element, a power of two of them, 64 at least."""
    bits = max(64, 4 << (len(shingles).bit_length() - 1))
    at = ((shingles >> np.uint64(20)) & np.uint64(bits - 1)).view(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def sketch_rows(docs: DataFrame, counts: Broadcast, settings: Settings) -> DataFrame:
    """Per row: doc_id, text_hash, size, node (fingerprint of the set), sketch, keys, salts."""
    head = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    schema = T.StructType(
        list(head.schema)[:2]
        + [T.StructField(c, T.LongType()) for c in ("size", "node")]
        + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("sketch", "keys")]
        + [T.StructField("salts", T.ArrayType(T.IntegerType()))]
    )
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = counts.value
        widespread = 8 * int(cells.mean()) + settings.salt_rows
        emitted: set[int] = set()

        def describe(text: bytes):
            s = np.unique(all_shingles(text, settings.shingle_words))
            size = len(s)
            if not size:
                return 0, None, None, None, None
            node = int(mix(np.array([np.add.reduce(mix(s ^ STEP)) + np.uint64(size)])).view(np.int64)[0])
            sketch = parity_sketch(s)
            if node in emitted:  # a copy: another row of this task has emitted the keys
                return size, node, sketch, None, None
            if len(emitted) >= 1 << 20:
                emitted.clear()
            emitted.add(node)
            band = size.bit_length() - 1
            keys, rarity = lane_keys(s, band, settings.most_different(size) + 1, cells, settings)
            below = (1 << band) - 1  # largest size of the band below
            if below and size * settings.percent <= 100 * below:
                more = lane_keys(s, band - 1, settings.most_different(below) + 1, cells, settings)
                keys, rarity = np.concatenate([keys, more[0]]), np.concatenate([rarity, more[1]])
            parts = np.where(rarity > widespread, 1 + np.minimum(rarity // settings.salt_rows, 1023), 1).astype(np.uint64)
            # Salts count from 1: salt 0 says that a key is not salted and all its nodes are in one group.
            salts = np.where(parts > 1, mix(keys ^ np.uint64(node & (2**64 - 1))) % parts + np.uint64(1), np.uint64(0))
            return size, node, sketch, keys.view(np.int64), salts.astype(np.int32)

        for b in batches:
            texts = as_bytes(b.column(2))
            for i in range(0, len(texts), 1000):
                rows = [describe(t) for t in texts[i : i + 1000]]
                own = [b.column(0).slice(i, len(rows)), b.column(1).slice(i, len(rows))]
                made = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(own + made, names=schema.names)

    return head.mapInArrow(run, schema)


def hamming(a: Column, b: Column) -> Column:
    """Distance of two parity sketches; the longer is folded to the shorter's length."""
    size = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        half = F.zip_with(F.slice(x, F.lit(1), size), F.slice(x, size + 1, size), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > size, half).otherwise(x)

    differ = F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(differ, F.lit(0), lambda s, x: s + x)


def shared_keys(rows: DataFrame) -> DataFrame:
    """(key, node) of keys that more than one node has; of salted keys also those with one node."""
    at = F.col("at")
    keys = rows.where("keys IS NOT NULL").select("node", F.explode(F.arrays_zip("keys", "salts")).alias("at"))
    w = Window.partitionBy("key", "salt")
    return (
        keys.select("node", at["keys"].alias("key"), at["salts"].alias("salt"))
        .withColumns({"low": F.min("node").over(w), "high": F.max("node").over(w)})
        .where("low <> high OR salt > 0")
        .select("key", "node")
        .distinct()
    )


def starred_keys(shared: DataFrame) -> DataFrame:
    """(key, node, center, n): each key's node with the most company over all its keys, and its number of nodes."""
    company = shared.groupBy("key").agg(F.count("*").alias("n"))
    rank = shared.join(company, "key").groupBy("node").agg(F.sum("n").alias("rank"))
    top = (
        shared.join(rank, "node")
        .groupBy("key")
        .agg(F.max(F.struct("rank", "node")).alias("top"), F.count("*").alias("n"))
        .select("key", F.col("top.node").alias("center"), "n")
    )
    return shared.join(top, "key").select("key", "node", "center", "n")


def ordered_pairs(df: DataFrame) -> DataFrame:
    return df.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def direct_pairs(placed: DataFrame, settings: Settings) -> DataFrame:
    """All pairs across components within a key of few nodes: (key, node, label, size)."""
    p = settings.percent
    left = placed.select("key", F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("size").alias("size_a"))
    right = placed.select("key", F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("size").alias("size_b"))
    sizes = (F.col("size_a") * 100 >= F.col("size_b") * p) & (F.col("size_b") * 100 >= F.col("size_a") * p)
    return ordered_pairs(left.join(right, "key").where("a < b AND label_a <> label_b").where(sizes).select("a", "b"))


def difference_pairs(placed: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs across components around a common center that may be links: (center, node, label).

    Seen from their center two sets differ by the symmetric difference of their differences to it,
    so linked sets share at least half of what their differences have together beyond D elements. In
    every pair across components one side is not linked to the center, that is, differs by more than
    D; so the other shares more than half of its own difference. Joining differences on their first
    elements, those foreign to the center first, finds every such pair (prefix filter), without
    comparing everything that resembles the center.
    """
    p = settings.percent
    center = sets.select(F.col("node").alias("center"), F.col("shingles").alias("there"))
    seen = (
        placed.join(center, "center")
        .join(sets, "node")
        .select(
            "center", "node", "label", F.size("shingles").alias("size"), F.size("there").alias("center_size"),
            F.array_except("shingles", "there").alias("new"), F.array_except("there", "shingles").alias("gone"),
        )
    )
    diff = F.size("new") + F.size("gone")
    most = F.floor(F.col("size") * (100 - p) / p) + 1
    gap = F.greatest(F.lit(0), F.floor((F.col("size") - F.col("center_size")) * (100 - p) / (100 + p)) + 1)
    linked = (F.col("size") - F.size("new")) * 100 >= (F.col("center_size") + F.size("new")) * p
    tokens = F.concat(F.array_sort("new"), F.array_sort("gone"))
    seen = seen.select(
        "center", "node", "label", "size", diff.alias("diff"), linked.alias("linked"),
        F.least(diff, most).alias("far"), F.least(diff, most, F.floor((diff - 1 + gap) / 2) + 1).alias("near"), tokens.alias("tokens"),
    )

    def side(rows: DataFrame, reach: str, name: str) -> DataFrame:
        first = F.slice("tokens", F.lit(1), F.greatest(F.lit(1), F.col(reach).cast("int")))
        return rows.where("diff > 0").select(
            "center", F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("label", "size", "diff")],
            F.posexplode(first).alias(f"at_{name}", "token"),
        )

    a, b = side(seen.where(~F.col("linked")), "far", "a"), side(seen, "near", "b")
    allowed = F.floor((F.col("size_a") + F.col("size_b")) * (100 - p) / (100 + p))
    least = F.greatest(F.lit(1), F.ceil((F.col("diff_a") + F.col("diff_b") - allowed) / 2))
    fits = (F.col("at_a") <= F.col("diff_a") - least) & (F.col("at_b") <= F.col("diff_b") - least)
    return ordered_pairs(a.join(b, ["center", "token"]).where("a <> b AND label_a <> label_b").where(fits).select("a", "b"))


def plausible(pairs: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs that pass the length bound and the sketches' lower bound of the difference."""
    p = settings.percent
    left = nodes.select(F.col("node").alias("a"), F.col("size").alias("size_a"), F.col("sketch").alias("sketch_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("sketch").alias("sketch_b"))
    lengths = (F.col("size_a") * 100 >= F.col("size_b") * p) & (F.col("size_b") * 100 >= F.col("size_a") * p)
    near = hamming(F.col("sketch_a"), F.col("sketch_b")) * (100 + p) <= (F.col("size_a") + F.col("size_b")) * (100 - p)
    return pairs.join(left, "a").join(right, "b").where(lengths & near).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose exact sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= either * settings.percent).select("a", "b")


def node_sets(docs: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """(node, shingles) of the documents in ``wanted`` (node, doc_id, text_hash).

    A filter of fixed size keeps most other texts from being hashed; the join makes it exact.
    """
    bits = settings.filter_bits
    spot = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(bits))
    words = wanted.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(spot & 63))")).alias("bits")
    )
    got = words.toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(table.view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for b in batches:
            at = b.column(2).to_numpy(zero_copy_only=False).astype(np.uint64)
            hits = np.flatnonzero((marks[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))
            for i in range(0, len(hits), 500):
                part = b.take(pa.array(hits[i : i + 500]))
                sets = [np.unique(all_shingles(t, settings.shingle_words)).view(np.int64) for t in as_bytes(part.column(3))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "shingles"]
                )

    head = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    source = head.select("doc_id", "text_hash", spot.alias("spot"), "text")
    schema = T.StructType([*list(head.schema)[:2], T.StructField("shingles", T.ArrayType(T.LongType()))])
    found = source.mapInArrow(run, schema)
    same = F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_hash") == F.col("wanted_hash"))
    names = wanted.select("node", F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash"))
    return found.join(names, same).groupBy("node").agg(F.any_value("shingles").alias("shingles"))


def ngram_classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Per row: doc_id, text_hash, n_shingles, component_id, and whether the row's text stands for its component.

    The component's text is the one with the smallest id (then hash); all its repeated rows are marked.
    """
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(cell_counts(docs, settings))
    rows = settled(sketch_rows(docs, counts, settings), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.any_value("size").alias("size"), F.any_value("sketch").alias("sketch"), first.alias("first")
    )
    shared = settled(shared_keys(rows), "lane-keys")
    company = settled(
        shared.select("node").distinct().join(nodes, "node").select("node", "size", "sketch", "first.doc_id", "first.text_hash"), "nodes"
    )
    starred = settled(starred_keys(shared), "starred-keys")
    stars = settled(ordered_pairs(starred.select(F.col("center").alias("a"), F.col("node").alias("b"))), "stars")
    sets = settled(node_sets(docs, company.select("node", "doc_id", "text_hash"), settings), "sets")
    links = settled(verified(plausible(stars, company, settings), sets, settings), "links")

    # Nodes of a key that are not connected yet are compared with each other.
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    placed = starred.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    still = settled(placed.join(split, "key").join(company.select("node", "size"), "node"), "open-keys")
    few = F.col("n") <= settings.direct_rows
    across = direct_pairs(still.where(few), settings).unionByName(
        difference_pairs(still.where(~few).select("center", "node", "label").distinct(), sets, settings)
    )
    across = settled(across.distinct().join(stars, ["a", "b"], "left_anti"), "across")
    more = settled(verified(plausible(across, company, settings), sets, settings), "links")
    links = links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
    labels = components(links)

    named = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("first").alias("head"))
    classes = settled(named.select("node", "label").join(names, "label").select("node", "head"), "classes")
    out = rows.select("doc_id", "text_hash", "size", "node").join(classes, "node", "left")
    lone = F.col("node").isNull()
    stands = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    return out.select(
        "doc_id",
        "text_hash",
        F.col("size").alias("n_shingles"),
        F.when(lone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        (lone | stands).alias("stands"),
    )
