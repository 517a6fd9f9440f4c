"""Delimited text files that name their own columns, each file by itself.

One scan finds every file's header and number of lines. Lines then meet the header of their file in a join
on the file, and cells are picked by name; so files whose columns stand in another order, or
that have more of them, load together. A file that cannot be read, has no line, or lacks a required
column gets an error of its own and takes no part; the others are loaded.

Cells may stand in double quotes, with a quote inside doubled. Blank lines, and lines that repeat
the header, are no data. Short lines keep the cells they have.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.keyed import settled

BYTE_ORDER_MARKS = ("\ufeff", "\u00ef\u00bb\u00bf")


@dataclass(frozen=True)
class Layout:
    """How the files of a source are written. A column spelled like ``date_name`` in any case takes that name."""

    sep: str
    required: tuple[str, ...]
    encoding: str = "UTF-8"
    date_name: str | None = None


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def files_of(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """URIs of the files behind the paths, spelled as the scan's metadata spells them."""
    return [re.sub("^file:/+", "file:/", f) for f in spark.read.text(_paths(paths)).inputFiles()]


def raw_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(_file, _block, _at, _line): lines as they stand; ``_at`` grows along a file's block."""
    line = F.col("value")
    if encoding != "UTF-8":
        line = F.decode(line.cast("binary"), encoding)
    rows = spark.read.text(_paths(paths)).select(
        F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        line.alias("_line"),
    )
    return rows.where(F.trim("_line") != "")


def split_cells(line: Column, sep: str) -> Column:
    """Cells of a line; only lines with a quote take the slower way."""
    plain = F.split(line, re.escape(sep), -1)
    some = re.escape(sep)
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{some}("(?:[^"]|"")*"|[^{some}]*)'), F.lit(1))
    bare = F.transform(
        quoted,
        lambda x: F.when(x.rlike('^".*"$'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x),
    )
    return F.when(line.contains('"'), bare).otherwise(plain)


def column_names(header: Column, layout: Layout) -> Column:
    """Names in a header line, without byte-order marks and surrounding blanks."""
    for mark in BYTE_ORDER_MARKS:
        header = F.replace(header, F.lit(mark), F.lit(""))

    def clean(name: Column) -> Column:
        name = F.trim(name)
        if layout.date_name is None:
            return name
        return F.when(F.lower(name) == layout.date_name.lower(), F.lit(layout.date_name)).otherwise(name)

    return F.transform(split_cells(header, layout.sep), clean)


def _headers(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    first = F.min_by(F.when(F.col("_block") == 0, F.col("_line")), F.when(F.col("_block") == 0, F.col("_at")))
    return settled(raw_lines(spark, paths, encoding).groupBy("_file").agg(first.alias("header"), F.count("*").alias("n")), "headers")


def reason_of(error: Exception) -> str:
    """The innermost cause of a failed job, in one line."""
    lines = str(error).splitlines()
    causes = [x.removeprefix("Caused by: ").strip() for x in lines if x.startswith("Caused by: ")]
    return (causes[-1:] or lines[:1] or [type(error).__name__])[0][:500]


def read_errors(spark: SparkSession, files: list[str], read) -> dict[str, str]:
    """Files that make ``read(files)`` fail, found by halving the list, with the reason."""
    try:
        read(files)
    except Exception as error:  # noqa: BLE001
        if len(files) == 1:
            return {files[0]: reason_of(error)}
        half = len(files) // 2
        return read_errors(spark, files[:half], read) | read_errors(spark, files[half:], read)
    return {}


def readable_files(spark: SparkSession, paths: str | Sequence[str]) -> tuple[list[str], dict[str, str]]:
    """Paths of the files that can be read to their end, and the errors of the others (by file URI).

    One job if all can be read; otherwise a few more for each broken file.
    """
    listed = {f: unquote(f) for f in files_of(spark, paths)}

    def count(files: list[str]) -> None:
        spark.read.text(files).agg(F.count("value")).collect()

    names = {path: f for f, path in listed.items()}
    errors = read_errors(spark, list(names), count) if names else {}
    return [p for p in names if p not in errors], {names[p]: e for p, e in errors.items()}


def listed_files(spark: SparkSession, paths: str | Sequence[str], errors: dict[str, str]) -> DataFrame:
    """(_file, error) of every file behind the paths."""
    return spark.createDataFrame([(f, errors.get(f)) for f in files_of(spark, paths)], "_file string, error string")


def survey(spark: SparkSession, paths: str | Sequence[str], layout: Layout) -> tuple[DataFrame, list[str]]:
    """(_file, header, names, n_lines, error) of every file, and the paths that can be read.

    ``n_lines`` counts lines below the header.
    """
    good, broken = _paths(paths), {}
    try:
        found = _headers(spark, good, layout.encoding)
    except Exception:
        good, broken = readable_files(spark, paths)
        if not broken:
            raise
        found = _headers(spark, good, layout.encoding) if good else None
    files = listed_files(spark, paths, broken).withColumnRenamed("error", "unread")
    if found is None:
        found = spark.createDataFrame([], "_file string, header string, n long")
    every = files.join(found, "_file", "left").withColumn("names", column_names(F.col("header"), layout))
    missing = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in layout.required]), F.col("names")))
    error = F.coalesce(
        F.col("unread"),
        F.when(F.col("header").isNull(), F.lit("no lines")),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing columns "), F.array_join(missing, ", "))),
    )
    out = every.select("_file", "header", "names", F.greatest(F.col("n") - 1, F.lit(0)).alias("n_lines"), error.alias("error"))
    return settled(out, "files"), good


def named_cells(spark: SparkSession, paths: list[str], files: DataFrame, layout: Layout, wanted: Sequence[str]) -> DataFrame:
    """(wanted cells as text, _file, _line, _cells, _names) of all data lines of the files without an error.

    A cell that the file does not have, or that a short line lacks, is NULL. ``_cells`` and ``_names`` are
    the numbers of cells in the line and in the header.
    """
    known = files.where(F.col("error").isNull()).select(F.col("_file").alias("_of"), "header", "names")
    if paths:
        lines = raw_lines(spark, paths, layout.encoding)
    else:
        lines = spark.createDataFrame([], "_file string, _block long, _at long, _line string")
    joined = lines.join(known, F.col("_file") == F.col("_of")).where((F.col("_block") > 0) | (F.col("_line") != F.col("header")))
    cut = joined.withColumn("_all", split_cells(F.col("_line"), layout.sep))
    cells = [F.get("_all", (F.array_position("names", F.lit(c)) - 1).cast("int")).alias(c) for c in wanted]
    return cut.select(*cells, "_file", "_line", F.size("_all").alias("_cells"), F.size("names").alias("_names"))


def require_good(files: DataFrame) -> None:
    """Raise the first file's error, if any file has one."""
    bad = files.where(F.col("error").isNotNull()).orderBy("_file").select("_file", "error").first()
    if bad:
        raise ValueError(f"{bad['_file']}: {bad['error']}")


def outcomes(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(file, n_lines, used, other, rejected, error) of every file; the three add up to ``n_lines``.

    ``lines``: file, reason (NULL for usable lines), outside (usable, but of no interest).
    """
    bad, out = F.col("reason").isNotNull(), F.col("outside")
    counted = lines.groupBy("file").agg(
        F.count_if(~bad & ~out).alias("used"), F.count_if(~bad & out).alias("other"), F.count_if(bad).alias("rejected")
    )
    joined = files.select(F.col("_file").alias("of"), "error").join(counted, F.col("of") == F.col("file"), "left")
    used, other, rejected = (F.coalesce(c, F.lit(0)).cast("long") for c in ("used", "other", "rejected"))
    return joined.select(
        F.col("of").alias("file"), (used + other + rejected).alias("n_lines"), used.alias("used"), other.alias("other"),
        rejected.alias("rejected"), "error",
    )
