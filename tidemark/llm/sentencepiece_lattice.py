"""SentencePiece encoding as a relational lattice, and decoding.

A text is written with a leading word mark and marks for spaces, and cut into units wherever no
piece spans the cut, so the best segmentation of a text is that of its units in order. Every
distinct unit of the corpus is encoded once: its substrings, of the lengths that pieces with their first
characters have, are exploded and equi-joined with the piece table (a character without a piece gets an edge of its own, later
spelled in byte pieces), the edges are grouped by unit, and a higher-order ``aggregate`` folds them
from left to right into the best path: the one of the largest total score, of the longer last piece
among equals. That is the rule of unigram models; a model file of another kind is read as a table of
pieces and scores, and gives the first of the library's n best if told that the model is a unigram model.

Texts are then put together from their units' ids where they are read, without being shuffled. The
most frequent ``hot_units`` are in every task. Of the others, a first reading lists which of them each
task needs, per window of ``WINDOW_BYTES``; their ids are joined to the list and written to a folder per
task, in order of windows, from which the second reading takes them a window at a time. Texts for which
something is missing there, because the input was dealt differently the second time, get it by a join.
Units of more than ``fold_chars`` characters, for
which folding whole arrays would cost the square of their length, are encoded by the same
recursion in linear time instead. Nothing is truncated.

Defined results: NULL and empty texts have no ids. Repeated rows are each encoded. A literal word
mark in a text decodes as a space. Columns not asked for are ignored. Model files must neither
normalize nor squeeze spaces (checked), as with byte-fallback vocabularies.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import ARROW, as_bytes, bounded_batches, slices
from tidemark.llm.hot_table import HashTable, hot_from, usable
from tidemark.operators.keyed import settled
from tidemark.session import scratch_path

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of text cut at once; cutting and hashing takes some 50 times that in passing.
PART_BYTES = 1 << 18
#: Bytes of text whose rarer units a task holds at once.
WINDOW_BYTES = 16 << 20
#: Distinct units a task holds before it hands them on.
HELD_UNITS = 1 << 18
#: Substrings of that length or more are looked up only in lengths that pieces with their first characters have.
HEAD_CHARS = 4
#: Lattices are grouped in that many times the session's partitions; a group's sort is that much smaller.
LATTICE_PARTS = 4


@dataclass(frozen=True)
class Pieces:
    """Piece table. ``spelled``: bytes each id decodes to; ``byte_ids``: id of each byte, if there are any."""

    text: tuple[str, ...]
    ids: tuple[int, ...]
    scores: tuple[float, ...]
    spelled: tuple[bytes, ...]
    byte_ids: tuple[int, ...]
    unknown: int

    @property
    def longest(self) -> int:
        return max(map(len, self.text), default=1)

    def lengths_by_head(self) -> list[tuple[str, list[int]]]:
        """Lengths worth a look by first characters: those of pieces that begin so, and all shorter than ``HEAD_CHARS``."""
        found: dict[str, set[int]] = {}
        for p in self.text:
            if len(p) >= HEAD_CHARS:
                found.setdefault(p[:HEAD_CHARS], set(range(1, HEAD_CHARS))).add(len(p))
        return [(head, sorted(lengths)) for head, lengths in found.items()]

    @property
    def unknown_score(self) -> float:
        return min(self.scores, default=0.0) - UNKNOWN_PENALTY

    def spell(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.byte_ids else [self.unknown]


def read_pieces(path: str) -> Pieces:
    """Piece table of a model file; raises if the model normalizes texts."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = "a  b\tﬁ é "
    if model.decode(model.encode(probe)) != probe:
        raise ValueError("the model normalizes its input")
    n = model.get_piece_size()
    usual = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    by_byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
    spelled = [b""] * n
    for i in usual:
        spelled[i] = model.id_to_piece(i).replace(MARK, " ").encode()
    for b, i in by_byte.items():
        spelled[i] = bytes([b])
    spelled[model.unk_id()] = " ⁇ ".encode()
    return Pieces(
        tuple(model.id_to_piece(i) for i in usual),
        tuple(usual),
        tuple(float(model.get_score(i)) for i in usual),
        tuple(spelled),
        tuple(by_byte[b] for b in range(256)) if len(by_byte) == 256 else (),
        model.unk_id(),
    )


def best_path(unit: str, scores: dict[str, tuple[float, int]], longest: int, unknown: float) -> list[int]:
    """Ids of the best path; a character without a piece is -1 - its code point."""
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, len(unit) + 1):
        top = None
        for start in range(max(0, end - longest), end):
            found = scores.get(unit[start:end])
            if found is None and end - start == 1:
                found = (unknown, -1 - ord(unit[start]))
            if found is not None and (top is None or best[start][0] + found[0] > top[0]):
                top = (best[start][0] + found[0], start, found[1])
        best.append(top)
    ids, end = [], len(unit)
    while end:
        ids.append(best[end][2])
        end = best[end][1]
    return ids[::-1]


class Cutter:
    """Cuts texts into units at the places that no piece spans."""

    def __init__(self, pieces: tuple[str, ...]):
        together = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False)}
        chars = sorted({c for pair in together for c in pair})
        self.index = np.zeros(0x110000, np.int64)
        self.index[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        if together:
            number = {c: i + 1 for i, c in enumerate(chars)}
            a, b = np.array([(number[a], number[b]) for a, b in together]).T
            self.joined[a, b] = True
        self.joined_flat = self.joined.ravel()

    def cut(self, texts: list[bytes]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All marked texts in one string, its code points, the units' starts and ends, and each text's first unit."""
        marked = [MARK + t.decode("utf-8", "replace").replace(" ", MARK) if t else "" for t in texts]
        whole = "".join(marked)
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        at = self.index.take(points)
        begins = np.ones(len(points), bool)
        begins[1:] = ~self.joined_flat.take(at[:-1] * len(self.joined) + at[1:])
        size = np.array([len(m) for m in marked], np.int64)
        first_char = np.cumsum(size) - size
        begins[first_char[size > 0]] = True
        starts = np.flatnonzero(begins)
        return whole, points, starts, np.append(starts[1:], len(points)), np.searchsorted(starts, first_char)


def unit_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of units that lie end to end: sums of code points, each times a random number of its place in the unit."""
    if not len(starts):
        return np.empty(0, np.int64)
    size = ends - starts
    step = np.uint64(0x9E3779B97F4A7C15)
    place = (np.arange(1, int(size.max()) + 1, dtype=np.uint64) + np.uint64(seed << 40)) * step
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        place = (place ^ (place >> np.uint64(shift))) * np.uint64(factor)
    place ^= place >> np.uint64(31)
    inside = np.arange(len(points)) - np.repeat(starts, size)
    h = np.add.reduceat(points * place.take(inside), starts) + size.astype(np.uint64) * step
    h = (h ^ (h >> np.uint64(29))) * step
    return usable((h ^ (h >> np.uint64(32))).view(np.int64))


def corpus_units(docs: DataFrame, pieces: Pieces, seed: int) -> DataFrame:
    """(hash, unit, n, size): distinct units of all texts, how often they occur, and their lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(pieces.text)
        held, rows = [], 0

        def merged() -> pa.Table:
            counts = pa.Table.from_batches(held).group_by(["hash", "unit"], use_threads=False).aggregate([("n", "sum")])
            return pa.table([counts["hash"], counts["unit"], counts["n_sum"]], names=["hash", "unit", "n"])

        for b in batches:
            texts = as_bytes(b.column(0))
            for i, j in slices(texts, PART_BYTES):
                whole, points, starts, ends, _ = cutter.cut(texts[i:j])
                h, first, n = np.unique(unit_hashes(points, starts, ends, seed), return_index=True, return_counts=True)
                units = [whole[a:z] for a, z in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                held.append(pa.RecordBatch.from_arrays([pa.array(h), pa.array(units, pa.string()), pa.array(n)], names=["hash", "unit", "n"]))
                rows += len(h)
                if rows > 2 * HELD_UNITS:
                    held = merged().combine_chunks().to_batches()
                    rows = sum(len(x) for x in held)
                    if rows > HELD_UNITS:
                        yield from held
                        held, rows = [], 0
        if held:
            yield from merged().to_batches()

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "hash long, unit string, n long")
    # Units are short and their lattices long: deal them out by number, not by their own size. Grouping
    # them, and later their edges, then needs no further shuffle.
    parts = LATTICE_PARTS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The length as an aggregate: a filter on it stays behind the shuffle, which both kinds of units share.
    return rows.repartition(parts, "hash").groupBy("hash", "unit").agg(F.sum("n").alias("n"), F.max(F.length("unit")).alias("size"))


def fold_edges(edges: Column, size: Column) -> Column:
    """Ids of the best path over edges (end, start, id, score) sorted by end and start."""
    node = "struct<score:double,start:int,id:int>"
    begin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("id")).cast(node))

    def relax(best: Column, e: Column) -> Column:
        score = F.get(best, e["start"])["score"] + e["score"]
        new = F.array(F.struct(score.alias("score"), e["start"].alias("start"), e["id"].alias("id")).cast(node))
        return (
            F.when(F.size(best) <= e["end"], F.concat(best, new))
            .when(score > F.get(best, e["end"])["score"], F.concat(F.slice(best, F.lit(1), e["end"]), new))
            .otherwise(best)
        )

    def walk(best: Column) -> Column:
        first = F.struct(size.alias("at"), F.array().cast("array<int>").alias("ids"))

        def back(s: Column, _: Column) -> Column:
            here = F.get(best, s["at"])
            return F.when(s["at"] == 0, s).otherwise(F.struct(here["start"].alias("at"), F.concat(F.array(here["id"]), s["ids"]).alias("ids")))

        return F.aggregate(F.sequence(F.lit(1), size), first, back, lambda s: s["ids"])

    return F.aggregate(edges, begin, relax, walk)


def encode_units(units: DataFrame, pieces: Pieces, fold_chars: int) -> DataFrame:
    """(hash, n, ids) of distinct (hash, unit, n, size), by lattice; characters without a piece as negative ids."""
    spark = units.sparkSession
    table = spark.createDataFrame(list(zip(pieces.text, pieces.ids, pieces.scores, strict=True)), "piece string, id int, score double")
    heads = spark.createDataFrame(pieces.lengths_by_head(), "head string, lengths array<int>")
    size, short = F.col("size"), F.array(*map(F.lit, range(1, HEAD_CHARS)))
    # Edges are grouped by a number of their unit's row, which is shorter to carry and compare than the unit.
    starts = (
        units.where(size <= fold_chars)
        .withColumn("row", F.monotonically_increasing_id())
        .select("hash", "row", "unit", "n", "size", F.posexplode(F.sequence(F.lit(1), size)).alias("start", "from"))
        .join(F.broadcast(heads), F.substring("unit", F.col("from"), F.lit(HEAD_CHARS)) == F.col("head"), "left")
        .select("hash", "row", "unit", "n", "size", "start", "from", F.explode(F.coalesce("lengths", short)).alias("chars"))
        .where(F.col("chars") <= size - F.col("start"))
        .withColumn("part", F.substring("unit", F.col("from"), F.col("chars")))
    )
    # The vocabulary's size is fixed by its file.
    edges = starts.join(F.broadcast(table), F.col("part") == F.col("piece"), "left").where("id IS NOT NULL OR chars = 1")
    edge = F.struct(
        (F.col("start") + F.col("chars")).cast("int").alias("end"),
        F.col("start").cast("int").alias("start"),
        F.coalesce("id", (-1 - F.ascii("part"))).cast("int").alias("id"),
        F.coalesce("score", F.lit(pieces.unknown_score)).alias("score"),
    )
    folded = (
        edges.groupBy("hash", "row", "n", "size")
        .agg(F.array_sort(F.collect_list(edge)).alias("edges"))
        .select("hash", "n", fold_edges(F.col("edges"), size).alias("ids"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = {t: (s, i) for t, i, s in zip(pieces.text, pieces.ids, pieces.scores, strict=True)}
        for b in batches:
            ids = [best_path(u, scores, pieces.longest, pieces.unknown_score) for u in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(ids, pa.list_(pa.int32()))], names=["hash", "n", "ids"])

    long = units.where(size > fold_chars).select("hash", "unit", "n").mapInArrow(run, "hash long, n long, ids array<int>")
    return folded.unionByName(long)


class Assembler:
    """Puts texts together from the ids of their units: those in every task, and others taken in for a while."""

    def __init__(self, table: HashTable, offsets: np.ndarray, flat: np.ndarray):
        self.table, self.offsets, self.flat = table, offsets, flat
        self.rare = None

    def take(self, lists: list[pa.RecordBatch]) -> None:
        """Hold the units of (hash, ids) in place of those taken before."""
        hashes = [b.column(0).to_numpy() for b in lists]
        if not sum(map(len, hashes)):
            self.rare = None
            return
        hashes, first = np.unique(np.concatenate(hashes), return_index=True)
        n = np.concatenate([np.diff(b.column(1).offsets.to_numpy()) for b in lists]).astype(np.int64)
        flat = np.concatenate([b.column(1).flatten().to_numpy() for b in lists])
        begins = len(self.flat) + np.cumsum(n) - n
        table = HashTable(hashes, np.arange(len(hashes), dtype=np.int32))
        self.rare = table, begins[first], n[first], np.concatenate([self.flat, flat])

    def ids(self, hashes: np.ndarray, first: np.ndarray) -> list:
        """Per text: ids, or the hashes it lacks; ``first``: each text's first unit."""
        at, found = self.table.get(hashes)
        at = np.where(found, at, 0)
        begin = self.offsets[at]
        n = np.where(found, self.offsets[at + 1] - begin, 0) if len(self.offsets) > 1 else np.zeros(len(hashes), np.int64)
        flat = self.flat
        if self.rare is not None and not found.all():
            table, begins, sizes, flat = self.rare
            left = np.flatnonzero(~found)
            at, there = table.get(hashes[left])
            left, at = left[there], at[there]
            begin[left], n[left], found[left] = begins[at], sizes[at], True
        upto = np.cumsum(n)
        ids = flat[np.repeat(begin - (upto - n), n) + np.arange(int(n.sum()))]
        edge, missing = np.concatenate([[0], upto]), np.concatenate([[0], np.cumsum(~found)])
        last = np.append(first[1:], len(hashes))
        return [
            set(hashes[a:z][~found[a:z]].tolist()) if missing[z] > missing[a] else ids[edge[a] : edge[z]] for a, z in zip(first, last, strict=True)
        ]


def spell_unknown(ids: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Negative ids replaced by byte pieces."""
    if not len(ids) or ids.min() >= 0:
        return ids
    return np.array([x for i in ids.tolist() for x in (pieces.spell(chr(-1 - i)) if i < 0 else [i])], np.int32)


class Decoder:
    def __init__(self, pieces: Pieces):
        size = np.array([len(s) for s in pieces.spelled], np.int64)
        self.size, self.begin = size, np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(pieces.spelled), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        upto = np.cumsum(n)
        at = np.repeat(self.begin[ids] - (upto - n), n) + np.arange(int(n.sum()))
        return self.flat[at].tobytes()[1:]  # without the leading mark


def window_slices(texts: list[bytes], before: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of at most ``PART_BYTES`` or one row, and the window of a task's texts in which they begin.

    ``before``: bytes of the task's earlier texts. Windows depend on the texts' order alone, not on batches.
    """
    ends = before + np.cumsum([len(x) for x in texts], dtype=np.int64)
    windows = np.concatenate([[before], ends[:-1]])[: len(texts)] // WINDOW_BYTES
    edges = [0, *(np.flatnonzero(np.diff(windows)) + 1).tolist(), len(texts)]
    for a, z in zip(edges, edges[1:], strict=False):
        for i, j in slices(texts[a:z], PART_BYTES):
            yield a + i, a + j, int(windows[a])


def units_by_task(texts: DataFrame, rare: DataFrame, pieces: Pieces, seed: int, sent) -> str:
    """Folder with the ids of the units that are not in the table ``sent``, by task of ``texts`` that needs them and window."""
    spark = texts.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cutter, task = HashTable.of(sent.value[0]), Cutter(pieces.text), TaskContext.get().partitionId()
        size, now, held = 0, 0, []

        def finish() -> Iterator[pa.RecordBatch]:
            hashes = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
            held.clear()
            columns = [np.full(len(hashes), task, np.int32), np.full(len(hashes), now, np.int32), hashes]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["task", "window", "hash"])

        for b in batches:
            part = as_bytes(b.column(0))
            for i, j, window in window_slices(part, size):
                if window != now:
                    yield from finish()
                    now = window
                size += sum(map(len, part[i:j]))
                _, points, starts, ends, _ = cutter.cut(part[i:j])
                hashes = np.unique(unit_hashes(points, starts, ends, seed))
                held.append(hashes[~table.get(hashes)[1]])
        yield from finish()

    needed = texts.mapInArrow(run, "task int, window int, hash long").join(rare, "hash")
    folder = scratch_path(spark, "units-by-task")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    needed.repartition(parts, "task").sortWithinPartitions("task", "window").write.partitionBy("task").parquet(folder)
    return folder


def stored_windows(folder: str, task: int) -> Callable[[int], list[pa.RecordBatch]]:
    """Reads a task's (hash, ids) below ``folder``, a window at a call, in ascending order."""
    store, root = fs.FileSystem.from_uri(folder)
    files = store.get_file_info(fs.FileSelector(f"{root}/task={task}", allow_not_found=True))
    names = sorted(f.path for f in files if f.path.endswith(".parquet"))

    def read() -> Iterator[pa.RecordBatch]:
        for name in names:
            with store.open_input_file(name) as f:
                yield from pq.ParquetFile(f).iter_batches(1 << 16, columns=["window", "hash", "ids"])

    batches, ahead = read(), []

    def window_of(window: int) -> list[pa.RecordBatch]:
        nonlocal ahead
        out = []
        while True:
            for b in ahead:
                numbers = b.column("window").to_numpy()
                a, z = np.searchsorted(numbers, [window, window + 1])
                out.append(b.slice(a, z - a).select(["hash", "ids"]))
                ahead = [b.slice(z)] if z < len(numbers) else []
            if ahead:
                return out
            ahead = [b for b in [next(batches, None)] if b is not None]
            if not ahead:
                return out

    return window_of


#: Takes a text and its ids and gives one value per column asked for.
Emit = Callable[[bytes, np.ndarray, Decoder], tuple]


def encode_texts(
    docs: DataFrame,
    pieces: Pieces,
    columns: str = "ids array<int>",
    emit: Emit = lambda text, ids, decoder: (ids,),
    keep: tuple[str, ...] = ("doc_id",),
    hot_units: int = 1 << 19,
    fold_chars: int = 64,
) -> DataFrame:
    """Encode all texts; per row the columns ``keep`` and what ``emit`` makes of its text and ids."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    for seed in range(8):
        units = settled(encode_units(corpus_units(docs, pieces, seed), pieces, fold_chars), "unit-ids")
        total, distinct = units.select(F.count("*"), F.countDistinct("hash")).first()
        if total == distinct:
            break  # no two units share a hash
    else:
        raise RuntimeError("units collide under every seed")
    hot = F.col("n") + 1 >= hot_from(units, "n", hot_units)
    got = units.where(hot).select("hash", "ids").toArrow().combine_chunks()
    lists = got.column("ids").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    hashes, offsets = got.column("hash").to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    table = HashTable(hashes, np.arange(len(hashes), dtype=np.int32))
    sent = spark.sparkContext.broadcast((table.arrays(), offsets, lists.values.to_numpy()))
    text = F.col("text").cast("string").alias("text_")
    rare = units.where(~hot).select("hash", "ids")
    folder = units_by_task(docs.select(text), rare, pieces, seed, sent)

    new = T.StructType.fromDDL(columns)
    schema = T.StructType([T.StructField("row", T.LongType()), *(docs.schema[c] for c in keep)])
    schema = T.StructType([*schema, *new, T.StructField("lacking", T.ArrayType(T.LongType())), T.StructField("text_", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch], complete: bool) -> Iterator[pa.RecordBatch]:
        arrays, offsets, flat = sent.value
        assembler, cutter, decoder = Assembler(HashTable.of(arrays), offsets, flat), Cutter(pieces.text), Decoder(pieces)
        task = TaskContext.get().partitionId()
        row, size, now, stored = task << 40, 0, -1, None if complete else stored_windows(folder, task)
        for b in batches:
            text_at = len(keep) + (1 if complete else 0)
            texts = as_bytes(b.column(text_at))
            for i, j, window in window_slices(texts, size):
                part = texts[i:j]
                size += sum(map(len, part))
                _, points, starts, ends, first = cutter.cut(part)
                if complete:
                    given = b.column(text_at + 1).slice(i, j - i).flatten()
                    fields = [given.field("hash"), given.field("ids")]
                    assembler.take([pa.RecordBatch.from_arrays(fields, names=["hash", "ids"])])
                elif window != now:
                    now = window
                    assembler.take(stored(window))
                found = assembler.ids(unit_hashes(points, starts, ends, seed), first)
                lacking = [sorted(f) if isinstance(f, set) else None for f in found]
                none = (None,) * len(new)
                made = [none if isinstance(f, set) else emit(t, spell_unknown(f, pieces), decoder) for t, f in zip(part, found, strict=True)]
                shift = 1 if complete else 0
                rows = b.column(0).slice(i, j - i) if complete else pa.array(np.arange(row, row + j - i))
                row += j - i
                yield pa.RecordBatch.from_arrays(
                    [
                        rows,
                        *(b.column(k + shift).slice(i, j - i) for k in range(len(keep))),
                        *(pa.array(v, ARROW[f.dataType]) for v, f in zip(zip(*made, strict=True), new, strict=True)),
                        pa.array(lacking, pa.list_(pa.int64())),
                        pa.array([t.decode("utf-8", "replace") if x else None for t, x in zip(part, lacking, strict=True)], pa.string()),
                    ],
                    names=schema.names,
                )

    first_pass = docs.select(*keep, text).mapInArrow(functools.partial(run, complete=False), schema)
    done = settled(first_pass, "encoded")  # written once: its row numbers are used twice
    out = [*keep, *new.names]
    rest = done.where("lacking IS NOT NULL")
    if rest.isEmpty():
        return done.select(*out)
    wanted = rest.select("row", F.explode("lacking").alias("hash")).join(rare, "hash")
    given = wanted.groupBy(F.col("row").alias("row_")).agg(F.collect_list(F.struct("hash", "ids")).alias("given"))
    completed = (
        rest.join(given, F.col("row") == F.col("row_"))
        .select("row", *keep, "text_", "given")
        .mapInArrow(functools.partial(run, complete=True), schema)
    )
    return done.where("lacking IS NULL").select(*out).unionByName(completed.select(*out))


DIGEST = "n_pieces long, ids_crc32 long, round_trip boolean"


def digest(text: bytes, ids: np.ndarray, decoder: Decoder) -> tuple:
    """Number of pieces, crc32 of the ids as little-endian 32-bit numbers, and whether they decode to the text."""
    return len(ids), zlib.crc32(ids.astype("<u4").tobytes()), decoder.decode(ids) == text


def decode_texts(df: DataFrame, pieces: Pieces, ids: str = "ids") -> DataFrame:
    """``df`` with column ``text`` decoded from an array of ids; NULL ids give NULL."""
    schema = T.StructType([*(f for f in df.schema if f.name != "text"), T.StructField("text", T.StringType())])
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(pieces)
        for b in batches:
            lists = b.column(names.index(ids)).to_pylist()
            texts = [None if x is None else decoder.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.select(*names).mapInArrow(run, schema)
