"""Token-id files: whole texts to ids, written as coded blocks in document order, and read back.

Documents are dealt by ranges of their id, sorted, tokenized and written by the tasks themselves:
ids are never shuffled. A task writes one or more shard files of at most ``shard_ids`` ids (a longer
document gets a shard of its own); a shard holds its documents' ids and lengths and a row of blocks
of ``block_ids``, coded independently and checksummed (``block_codec``). Shard names sort in
document order. A file is written under a name of its attempt and then renamed, so a repeated or
speculative attempt replaces equal content; the list of shards is a table that Spark commits.

Shard: magic, documents, ids, length and crc32 of the directory; the directory, compressed: ids of
the documents, flags of NULL ids, and lengths as little-endian 64-bit numbers; blocks.

The folder must be one that executors share, by a URI pyarrow can open (file:, hdfs:, s3:, gs: ...).

Defined results: NULL and empty texts have the end id only. Documents with NULL ids come first,
equal ids in order of their text's hash. Repeated rows are all written. Document ids must be whole
numbers. An empty table gives no shards and no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import as_bytes, slices
from tidemark.llm.block_codec import DamagedBlock, decode_block, encode_block
from tidemark.llm.tokenize import TextEncoder
from tidemark.operators.keyed import settled

HEAD = "<4sIQII"
HEAD_SIZE = struct.calcsize(HEAD)
MAGIC = b"TIDF"
NAME = re.compile(r"shard-(\d+)-(\d+)\.tid$")
#: Bytes of text tokenized at once.
PART_BYTES = 1 << 20
MANIFEST = "task long, part long, n_docs long, n_ids long, n_bytes long, file string"


def pack_shard(doc_ids: list, sizes: np.ndarray, ids: np.ndarray, vocabulary: int, block_ids: int) -> bytes:
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    missing = np.array([d is None for d in doc_ids], np.uint8)
    directory = zlib.compress(known.tobytes() + missing.tobytes() + sizes.astype("<i8").tobytes(), 6)
    head = struct.pack(HEAD, MAGIC, len(doc_ids), len(ids), len(directory), zlib.crc32(directory))
    return b"".join([head, directory, *(encode_block(ids[i : i + block_ids], vocabulary) for i in range(0, len(ids), block_ids))])


def unpack_shard(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their lengths and all ids; raises DamagedBlock if anything does not check."""
    if len(data) < HEAD_SIZE:
        raise DamagedBlock("truncated shard")
    magic, n_docs, n_ids, size, check = struct.unpack_from(HEAD, data)
    packed = data[HEAD_SIZE : HEAD_SIZE + size]
    if magic != MAGIC or len(packed) < size or zlib.crc32(packed) != check:
        raise DamagedBlock("damaged directory")
    raw = zlib.decompress(packed)
    known, missing = np.frombuffer(raw, "<i8", n_docs), np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
    sizes = np.frombuffer(raw, "<i8", n_docs, 9 * n_docs)
    parts, at, got = [], HEAD_SIZE + size, 0
    while got < n_ids:
        ids, at = decode_block(data, at)
        parts.append(ids)
        got += len(ids)
    if got != n_ids or int(sizes.sum()) != n_ids or at != len(data):
        raise DamagedBlock("lengths differ")
    return [None if m else int(d) for d, m in zip(known, missing, strict=True)], sizes, np.concatenate(parts)


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end: int = 2, block_ids: int = 1 << 20, shard_ids: int = 1 << 23, partitions: int | None = None
) -> DataFrame:
    """Write all documents below ``folder``; the stored list of shards (columns of ``MANIFEST``).

    ``tokenizer`` is the path of a ``tokenizers`` file; the driver reads it and sends it along.
    """
    spark = docs.sparkSession
    definition = Path(tokenizer).read_text(encoding="utf-8")
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A Python worker unpacks a broadcast value once, for all its tasks: the pieces they remember stay there.
    kept = spark.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept.value.get("encoder") or kept.value.setdefault("encoder", TextEncoder(definition, end))
        vocabulary = max(encoder.library.get_vocab_size(with_added_tokens=True), end + 1)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task, part = TaskContext.get().partitionId(), 0
        names, sizes, ids, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal part, held
            if not names:
                return
            data = pack_shard(names, np.concatenate(sizes), np.concatenate(ids), vocabulary, block_ids)
            file = f"{root}/shard-{task:06d}-{part:06d}.tid"
            draft = f"{root}/_{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as f:
                f.write(data)
            if store.get_file_info(file).type != fs.FileType.NotFound:
                store.delete_file(file)
            store.move(draft, file)
            row = [task, part, len(names), held, len(data), file.rsplit("/", 1)[1]]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=["task", "part", "n_docs", "n_ids", "n_bytes", "file"])
            names.clear(), sizes.clear(), ids.clear()
            part, held = part + 1, 0

        for b in batches:
            doc_ids, texts = b.column(0).to_pylist(), as_bytes(b.column(1))
            for i, j in slices(texts, PART_BYTES):
                made, n = encoder.encode_utf8(texts[i:j])
                ends = np.cumsum(n)
                first = 0
                while first < len(n):
                    # Documents that still fit; at least one.
                    begin = ends[first] - n[first]
                    upto = max(first + (not names), int(np.searchsorted(ends, begin + shard_ids - held, side="right")))
                    if upto > first:
                        names += doc_ids[i + first : i + upto]
                        sizes.append(n[first:upto])
                        ids.append(made[begin : ends[upto - 1]])
                        held += int(ends[upto - 1] - begin)
                    if upto < len(n):
                        yield from flush()
                    first = upto
        yield from flush()

    text = F.col("text").cast("string").alias("text")
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, F.xxhash64(text).alias("hash"))
        .repartitionByRange(partitions, F.asc_nulls_first("doc_id"), "hash")
        .sortWithinPartitions(F.asc_nulls_first("doc_id"), "hash")
        .select("doc_id", "text")
    )
    return settled(ordered.mapInArrow(run, MANIFEST), "shards")


def read_token_files(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard.

    Only listed shards count. Damaged or missing files are an error, never fewer rows.
    """
    if not shards.take(1):  # then there is no folder either
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")
    w = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shard file.
    begins = shards.withColumn("before", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc_ids, sizes, ids = unpack_shard(content.as_py())
                raw = memoryview(ids.astype("<u4").tobytes())
                stop = np.cumsum(sizes)
                start = stop - sizes
                checks = [zlib.crc32(raw[4 * int(u) : 4 * int(v)]) for u, v in zip(start, stop, strict=True)]
                columns = [
                    pa.array([path.rsplit("/", 1)[1]] * len(doc_ids)), pa.array(doc_ids, pa.int64()),
                    pa.array(start), pa.array(sizes), pa.array(checks, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "doc_id", "inside", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.tid").load(folder).select("path", "content")
    found = files.mapInArrow(run, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    listed = begins.select("file", "before", "n_docs")
    missing = F.when(F.col("doc_id").isNull() & F.col("n_tokens").isNull(), F.raise_error(F.concat(F.lit("missing shard "), "file")))
    return listed.join(found, "file", "left").select(
        "doc_id",
        F.coalesce(missing.cast("long"), F.col("before") + F.col("inside")).alias("start"),
        "n_tokens",
        "ids_crc32",
        F.col("file").alias("shard"),
    )
