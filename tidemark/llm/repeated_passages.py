"""Removal of passages that occur more than once: exact counting of windows of words, by super-k-mers.

A window of ``window`` words has a minimiser: the leftmost smallest hash of its ``seed``-word
sequences. Consecutive windows that share one minimiser are a super-k-mer, a short stretch of words.
Equal windows have equal minimisers, so every bucket (a minimiser) can be counted by itself.

1. Minimisers are counted over the corpus, with the smallest and the largest hash of their stretches.
   One that occurs once repeats nothing; where both hashes agree all stretches are the same, and all
   their windows repeat. Neither needs to look at a word again.
2. Stretches of the other minimisers travel to their bucket, once per distinct stretch and task, as
   one packed string. There their windows are sorted, and runs of equal hashes compared word by word.
3. The verdicts, one bit per window, go back to the stretches' places, and from there to the texts.

What tasks hold whole has a fixed size: a filter of ``filter_bits`` bits over the minimisers that
occur twice (the join behind it is exact), and the digests of up to ``remembered`` stretches.

Skew: copies collapse before every shuffle (partial aggregates, one string per task). A bucket of more
than ``bucket_rows`` strings, such as a passage that very many texts share in different
surroundings, is not taken as one group: its strings are cut again, by shorter seeds in another
order, and what they are cut into is dealt out and judged in the same way. After ``levels`` such cuts
windows are counted one by one, by 128-bit digest, in an aggregate with map-side combining.

Long texts are read in blocks of ``block`` words that overlap by a window; where a stretch is cut
does not matter, because each part carries the same minimiser.

Defined results: NULL, empty and blank texts have no words and stay empty. Texts of fewer than
``window`` words keep all. Repeated rows repeat each other's windows. NULL ids are kept. Stretches of one
minimiser are told apart by 64-bit hashes, texts by MD5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import as_bytes, free_name, slices
from tidemark.operators.keyed import settled

BASE = 0x9E3779B97F4A7C15
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Place of a word within its block; the bits above it order the seeds.
PLACE_BITS = 20


@dataclass(frozen=True)
class Settings:
    window: int = 35
    seed: int = 12
    block: int = 1 << 18
    filter_bits: int = 1 << 26
    remembered: int = 1 << 17
    bucket_rows: int = 1024
    levels: int = 3
    #: Windows compared at once in a bucket task.
    sort_rows: int = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX1
    h = (h ^ (h >> np.uint64(33))) * MIX2
    return h ^ (h >> np.uint64(33))


class RollingHash:
    """Hashes of word sequences as differences of running sums, in 64-bit arithmetic."""

    def __init__(self, longest: int):
        base, inverse = np.uint64(BASE), np.uint64(pow(BASE, -1, 1 << 64))
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, base)]), dtype=np.uint64)
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(longest, inverse)]), dtype=np.uint64)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * self.up[: len(codes)], dtype=np.uint64)])

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def stretches(words: list[bytes], settings: Settings, rolling: RollingHash, level: int = 0) -> Iterator[tuple]:
    """Super-k-mers of one text: arrays of first word, number of windows, minimiser and hash, per block.

    Every level has an order of its own, and seeds half as long as those before.
    """
    w, seed = settings.window, max(1, settings.seed >> level)
    for begin in range(0, max(1, len(words) - w + 1), settings.block):
        part = words[begin : begin + settings.block + w - 1]
        if len(part) < w:
            return
        codes = np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part))
        sums = rolling.sums(codes)
        at = np.arange(len(part) - seed + 1)
        rank = mix(rolling.of(sums, at, at + seed) + np.uint64(level))
        ranked = (rank >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | at.astype(np.uint64)
        least = sliding_min(ranked, w - seed + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        n = np.diff(np.append(first, len(least)))
        hashes = rolling.of(sums, first, first + n + w - 1)
        yield begin + first, n, (least[first] >> np.uint64(PLACE_BITS)).view(np.int64), hashes.view(np.int64)


def with_key(docs: DataFrame) -> DataFrame:
    """key (16 bytes of MD5) and text; NULL as the empty text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text"))


def minimisers(docs: DataFrame, settings: Settings) -> DataFrame:
    """Minimisers that occur more than once: minimiser, and whether all their stretches are the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash(settings.block + settings.window)
        for b in batches:
            texts = as_bytes(b.column(0))
            for i, j in slices(texts):
                found = [x[2:] for t in texts[i:j] for x in stretches(t.split(), settings, rolling)]
                if found:
                    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["minimiser", "stretch"])

    found = with_key(docs).select("text").mapInArrow(run, "minimiser long, stretch long")
    counted = found.groupBy("minimiser").agg(F.count("*").alias("n"), F.min("stretch").alias("low"), F.max("stretch").alias("high"))
    return counted.where("n > 1").select("minimiser", (F.col("low") == F.col("high")).alias("alike"))


def filter_of(keys: DataFrame, bits: int) -> np.ndarray:
    """Bit filter of 64-bit keys, of fixed size."""
    spot = F.pmod(F.col("minimiser"), F.lit(bits))
    words = keys.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(spot & 63))")).alias("bits")
    )
    got = words.toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return table


def places(docs: DataFrame, repeated: DataFrame, settings: Settings) -> DataFrame:
    """Stretches whose minimiser may occur elsewhere: key, first word, windows, minimiser, hash, and the
    packed words where this task has not sent that stretch before and its bucket will compare words."""
    spark = docs.sparkSession
    filters = [filter_of(repeated.where(c), settings.filter_bits) for c in ("true", "NOT alike")]
    sent = spark.sparkContext.broadcast(filters)
    ddl = "key binary, first long, windows int, minimiser long, stretch long, words binary"
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    bits = settings.filter_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash(settings.block + settings.window)
        occurs, mixed = sent.value
        emitted: set[int] = set()

        def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
            spot = keys & np.int64(bits - 1)
            return ((table[spot >> 6] >> (spot & 63)) & 1).astype(bool)

        for b in batches:
            keys, texts = b.column(0).to_pylist(), as_bytes(b.column(1))
            for i, j in slices(texts):
                out: list[list] = [[] for _ in kinds]
                for key, text in zip(keys[i:j], texts[i:j], strict=True):
                    words = text.split()
                    for first, n, minimiser, hashes in stretches(words, settings, rolling):
                        hit = np.flatnonzero(marked(occurs, minimiser))
                        if not len(hit):
                            continue
                        packed: list[bytes | None] = [None] * len(hit)
                        for k, wanted in enumerate(marked(mixed, minimiser[hit])):
                            h = int(hashes[hit[k]])
                            if wanted and h not in emitted:
                                if len(emitted) >= settings.remembered:
                                    emitted.clear()
                                emitted.add(h)
                                a = first[hit[k]]
                                packed[k] = b" ".join(words[a : a + n[hit[k]] + settings.window - 1])
                        for column, values in zip(out, ([key] * len(hit), first[hit], n[hit], minimiser[hit], hashes[hit], packed), strict=True):
                            column.append(values)
                if out[0]:
                    flat = [list(chain.from_iterable(c)) if isinstance(c[0], list) else np.concatenate(c) for c in out]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(flat, kinds, strict=True)], names=[x.split()[0] for x in ddl.split(", ")])

    return with_key(docs).mapInArrow(run, ddl)


def repeats_among(strings: list[bytes], groups: np.ndarray, settings: Settings) -> np.ndarray:
    """Per string a bit for each window that another string of its group (or place in it) has, too."""
    w, codes = settings.window, {}
    split = [s.split(b" ") for s in strings]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((codes.setdefault(x, len(codes)) for x in chain.from_iterable(split)), np.int64, int(lengths.sum()))
    begin = np.cumsum(lengths) - lengths
    n = lengths - w + 1
    owner = np.repeat(np.arange(len(split)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[owner] + offset
    rolling = RollingHash(len(ids) + w)
    h = rolling.of(rolling.sums(mix(ids.astype(np.uint64) + np.uint64(1))), start, start + w) ^ mix(groups.astype(np.uint64))[owner]
    order = np.argsort(h, kind="stable")
    s = h[order]
    equal = np.concatenate([[False], s[1:] == s[:-1], [False]])
    runs_begin, runs_end = np.flatnonzero(~equal[:-1] & equal[1:]), np.flatnonzero(equal[:-1] & ~equal[1:]) + 1
    again = np.zeros(len(owner), bool)
    for a, b in zip(runs_begin, runs_end, strict=True):
        members = order[a:b]
        content = ids[start[members][:, None] + np.arange(w)]
        if (content == content[0]).all():
            again[members] = True
            continue
        rows: dict[bytes, list[int]] = {}  # equal hashes of different windows
        for m, c in zip(members, content, strict=True):
            rows.setdefault(c.tobytes() + bytes(str(groups[owner[m]]), "ascii"), []).append(m)
        for same in rows.values():
            again[same] = len(same) > 1
    bits = np.zeros(len(split), np.int64)
    np.bitwise_or.at(bits, owner[again], np.int64(1) << offset[again])
    return bits


def bucket_verdicts(strings: DataFrame, settings: Settings) -> DataFrame:
    """(minimiser, stretch, bits) of the stretches with repeated windows; buckets are sorted one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}

        def judged() -> pa.RecordBatch:
            keys = np.array(list(held), np.int64).reshape(-1, 2)
            bits = repeats_among(list(held.values()), keys[:, 0], settings)
            hit = bits != 0
            return pa.RecordBatch.from_arrays([pa.array(keys[hit, 0]), pa.array(keys[hit, 1]), pa.array(bits[hit])], names=["minimiser", "stretch", "bits"])

        last = None
        for b in batches:
            for minimiser, stretch, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if minimiser != last and len(held) * settings.window >= settings.sort_rows:
                    yield judged()
                    held.clear()
                last = minimiser
                held[minimiser, stretch] = words
        if held:
            yield judged()

    dealt = strings.repartition("minimiser").sortWithinPartitions("minimiser")
    return dealt.mapInArrow(run, "minimiser long, stretch long, bits long")


def finer_verdicts(strings: DataFrame, settings: Settings, level: int) -> DataFrame:
    """The same for buckets too large for one group: their strings cut into the stretches of another level."""
    ddl = "up_minimiser long, up_stretch long, first long, windows int, minimiser long, stretch long, words binary"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = RollingHash(settings.block + settings.window)
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                out = []
                for up_minimiser, up_stretch, string in zip(*(c.to_pylist() for c in b.slice(i, 2048).columns), strict=True):
                    words = string.split(b" ")
                    for cut in stretches(words, settings, rolling, level):
                        for first, n, minimiser, h in zip(*(c.tolist() for c in cut), strict=True):
                            out.append((up_minimiser, up_stretch, first, n, minimiser, h, b" ".join(words[first : first + n + settings.window - 1])))
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ddl.split(", ")])

    found = settled(strings.select("minimiser", "stretch", "words").mapInArrow(run, ddl), "finer-stretches")
    judged = settled(verdicts(found, settings, level), "finer-verdicts")
    own = F.expr("shiftleft(bits & (shiftleft(1L, windows) - 1), int(first))")
    hit = found.drop("words").join(judged, ["minimiser", "stretch"]).select("up_minimiser", "up_stretch", own.alias("bits"))
    return hit.groupBy(F.col("up_minimiser").alias("minimiser"), F.col("up_stretch").alias("stretch")).agg(F.bit_or("bits").alias("bits"))


def window_verdicts(strings: DataFrame, settings: Settings) -> DataFrame:
    """The same, window by window."""
    w = settings.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                split = [x.split(b" ") for x in part.column(2).to_pylist()]
                places = [(r, k) for r, x in enumerate(split) for k in range(len(x) - w + 1)]
                owner = pa.array([r for r, _ in places], pa.int64())
                content = pa.array([xxhash.xxh3_128_digest(b" ".join(split[r][k : k + w])) for r, k in places], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(owner), part.column(1).take(owner), pa.array([k for _, k in places], pa.int32()), content],
                    names=["minimiser", "stretch", "place", "content"],
                )

    windows = settled(strings.select("minimiser", "stretch", "words").mapInArrow(run, "minimiser long, stretch long, place int, content binary"), "windows")
    where = F.struct("minimiser", "stretch", "place")
    several = windows.groupBy("content").agg(F.min(where).alias("low"), F.max(where).alias("high")).where("low <> high").select("content")
    hit = windows.join(settled(several, "contents"), "content")
    return hit.groupBy("minimiser", "stretch").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))


def verdicts(found: DataFrame, settings: Settings, level: int = 0) -> DataFrame:
    """(minimiser, stretch, bits): which windows of a stretch occur elsewhere among the stretches ``found``."""
    same = found.groupBy("minimiser", "stretch").agg(F.count("*").alias("n")).where("n > 1").select("minimiser", "stretch", F.lit(-1).cast("long").alias("bits"))
    strings = found.where("words IS NOT NULL").select("minimiser", "stretch", "words")
    crowded = settled(strings.groupBy("minimiser").agg(F.count("*").alias("n")).where(F.col("n") > settings.bucket_rows).select("minimiser"), "crowded")
    parts = [same, bucket_verdicts(strings.join(crowded, "minimiser", "left_anti"), settings)]
    if not crowded.isEmpty():
        many = strings.join(crowded, "minimiser", "left_semi").groupBy("minimiser", "stretch").agg(F.any_value("words").alias("words"))
        parts.append(finer_verdicts(many, settings, level + 1) if level < settings.levels else window_verdicts(many, settings))
    both = parts[0]
    for x in parts[1:]:
        both = both.unionByName(x)
    return both.groupBy("minimiser", "stretch").agg(F.bit_or("bits").alias("bits"))


def covered(n_words: int, spans: list | None, settings: Settings) -> np.ndarray:
    """Which words lie inside a repeated window; spans are (first word, windows, bits)."""
    edge = np.zeros(n_words + 1, np.int32)
    if spans:
        first, n, bits = (np.array(c, np.int64) for c in zip(*spans, strict=True))
        k = np.arange(max(int(n.max()), 1))
        row, offset = np.nonzero(((bits[:, None] >> k) & 1).astype(bool) & (k < n[:, None]))
        start = first[row] + offset
        np.add.at(edge, start, 1)
        np.subtract.at(edge, start + settings.window, 1)
    return np.cumsum(edge[:-1]) > 0


def repeated_windows(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """Per distinct text with repeated windows: key (MD5), spans as an array of (first, windows, bits)."""
    if settings.window - settings.seed + 1 > 62:
        raise ValueError("a stretch must have at most 62 windows: use longer seeds")
    if settings.block + settings.window > 1 << PLACE_BITS:
        raise ValueError("a block must have fewer words")
    repeated = settled(minimisers(docs, settings), "minimisers")
    found = settled(places(docs, repeated, settings), "stretches")
    judged = settled(verdicts(found, settings), "verdicts")
    hit = found.select("key", "first", "windows", "minimiser", "stretch").join(judged, ["minimiser", "stretch"])
    return hit.groupBy("key").agg(F.collect_set(F.struct("first", "windows", "bits")).alias("spans"))


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """``docs`` with n_words, n_removed and kept_text (the words left, joined by single spaces).

    Columns of these names are replaced.
    """
    spans = repeated_windows(docs, settings)
    new = T.StructType.fromDDL("n_words long, n_removed long, kept_text string")
    kept = [c for c in docs.columns if c.lower() not in {f.name for f in new}]
    key, text = free_name(docs, "key_"), free_name(docs, "text_")
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col("text").cast("string"), F.lit("")).alias(text))
    rows = rows.withColumn(key, F.unhex(F.md5(F.col(text).cast("binary"))))
    spans = settled(spans, "spans").select(F.col("key").alias("span_key_"), F.col("spans").alias("spans_"))
    joined = rows.join(spans, F.col(key) == F.col("span_key_"), "left").drop(key, "span_key_")
    schema = T.StructType([f for f in docs.schema if f.name in kept] + list(new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(len(kept)))
            for i, j in slices(texts):
                made = []
                cells = b.column(len(kept) + 1).slice(i, j - i).to_pylist()
                for t, cell in zip(texts[i:j], cells, strict=True):
                    words = t.split()
                    if cell:
                        gone = covered(len(words), [tuple(x.values()) for x in cell], settings)
                        left = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
                    else:
                        left = words
                    made.append((len(words), len(words) - len(left), b" ".join(left).decode()))
                own = [b.column(c).slice(i, j - i) for c in range(len(kept))]
                new_columns = [pa.array(v, k) for v, k in zip(zip(*made, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays(own + new_columns, names=schema.names)

    return joined.mapInArrow(run, schema)
