"""Licences of files: statements found by sparse TF-IDF cosine, inherited along directories.

Every line of every file is a possible header or licence statement, and so is every run of lines of
at most twice as many words as the longest statement (headers may be wrapped). Lines, runs and
templates are vectors of term counts times inverse document frequency, counted over all files for
template terms; a term of no template weighs as much as one that no file has. Some of a template's
terms are a prefix: without any of them the cosine stays below the threshold, so only lines and runs
with a prefix term are weighed (equi-joins on terms, no pair of lines is ever formed).

A whole file is weighed in the same way against the full texts of ``licenses/``, with 1 + ln of the
term counts, so that a long text's most frequent words do not decide. A file's own licence is the
full text it resembles most, else that of its best line or run.

A file named like a licence file, or whose statement makes up ``file_share`` of its words, is its
directory's licence file. A file without a licence of its own takes that of the nearest directory
above it that has one: its ancestor directories are exploded and joined by path.

Defined results: NULL and empty texts have no licence of their own but may inherit. Equal scores
prefer the smaller licence name; a directory with several licence files takes the best score, then
the smaller name, then the smaller path. NULL paths lie nowhere and inherit nothing. Repeated rows each get their row.
Columns besides path and text are kept (those named like results are replaced).
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import words_of
from tidemark.operators.keyed import settled

# Usual short statements.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
FULL_TEXTS = Path(__file__).parent / "licenses"
FILE_NAMES = ("license", "licence", "copying", "license.txt", "licence.txt", "license.md", "licence.md", "copying.txt")


def ancestors(path: Column) -> Column:
    """Directories above a path, nearest first, the root ('') last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))


def term_weights(words: DataFrame, idf: DataFrame, rest: Column, key: list[str], damped: bool = False) -> DataFrame:
    """(key, term, weight, norm) of the word arrays ``words``; terms without an idf weigh ``rest``."""
    counts = words.select(*key, F.explode("words").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("n"))
    n = 1 + F.log("n") if damped else F.col("n")
    weighed = counts.join(idf, "term", "left").withColumn("weight", n * F.coalesce("idf", rest))
    return weighed.select(*key, "term", "weight", F.sqrt(F.sum(F.col("weight") ** 2).over(Window.partitionBy(*key))).alias("norm"))


def prefix_terms(vectors: DataFrame, least: float, order: list[Column]) -> list[str]:
    """Terms without any of which no cosine reaches ``least``; as few as the templates' own words."""
    # A term belongs to the prefix while it and what follows could still reach the threshold.
    ranked = Window.partitionBy("license", "template").orderBy(*order)
    left = F.sum((F.col("weight") / F.col("norm")) ** 2).over(ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return sorted({r["term"] for r in vectors.withColumn("left", F.sqrt(left)).where(F.col("left") >= least).select("term").collect()})


def cosines(weights: DataFrame, vectors: DataFrame, key: list[str], least: float) -> DataFrame:
    """(key, license, template, score) of at least ``least``."""
    side = vectors.select("license", "template", "term", F.col("weight").alias("t_weight"), F.col("norm").alias("t_norm"))
    return (
        weights.join(side, "term")
        .groupBy(*key, "license", "template")
        .agg((F.sum(F.col("weight") * F.col("t_weight")) / F.any_value("norm") / F.any_value("t_norm")).alias("score"))
        .withColumn("score", F.round("score", 9))
        .where(F.col("score") >= least)
    )


def line_runs(numbered: DataFrame, terms: Column, most_words: int) -> DataFrame:
    """(file, n_words, line, n_lines, words) of runs of two or more lines with words.

    A run begins and ends with a line that has a template's term: without it the cosine would be larger.
    """
    ahead = Window.partitionBy("file").orderBy("line").rowsBetween(0, most_words - 1)
    seen = numbered.where(F.size("words") > 0).withColumn("next", F.collect_list("words").over(ahead))
    starts = seen.where(F.arrays_overlap("words", terms) & (F.size("next") > 1) & (F.size("words") < most_words))
    last = starts.withColumn("n_lines", F.explode(F.sequence(F.lit(2), F.size("next"))))
    ends = last.where(F.arrays_overlap(F.get("next", F.col("n_lines") - 1), terms))
    runs = ends.select("file", "n_words", "line", "n_lines", F.flatten(F.slice("next", F.lit(1), F.col("n_lines"))).alias("words"))
    return runs.where(F.size("words") <= most_words)


def statements(files: DataFrame, templates: DataFrame, full: DataFrame, least: float) -> DataFrame:
    """(file, license, score, share): licence text or best statement of each file (file, text) that has one.

    All texts are read for their template terms, which are few; only files with a prefix term are read again.
    """
    base = templates.select("license", "template", words_of(F.col("text")).alias("words"))
    whole = full.select("license", "template", words_of(F.col("text")).alias("words"))
    known = settled(base.select(F.explode("words").alias("term")).distinct(), "license-terms")
    every = settled(known.union(whole.select(F.explode("words"))).distinct(), "all-terms")
    seen = settled(files.select("file", F.explode(F.array_distinct(words_of(F.col("text")))).alias("term")).join(every, "term"), "seen-terms")
    rest = math.log(1 + files.count()) + 1
    counts = seen.groupBy("term").count()
    all_idf = settled(
        every.join(counts, "term", "left").select("term", (F.lit(rest) - F.log(1 + F.coalesce("count", F.lit(0)))).alias("idf")), "idf"
    )
    idf = settled(all_idf.join(known, "term", "left_semi"), "line-idf")
    vectors = settled(term_weights(base, idf, F.lit(rest), ["license", "template"]), "templates")
    prefix = prefix_terms(vectors, least, [F.desc("weight"), F.col("term")])

    likely = settled(seen.where(F.col("term").isin(prefix)).select("file").distinct(), "likely-files")
    texts = files.join(likely, "file", "left_semi").groupBy("file").agg(F.any_value("text").alias("text"))
    sized = settled(texts.withColumn("n_words", F.size(words_of(F.col("text")))), "likely-texts")
    lines = sized.select("file", "n_words", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    numbered = lines.select("file", "n_words", "line", F.lit(1).alias("n_lines"), words_of(F.col("text")).alias("words"))
    wanted = F.array(*[F.lit(t) for t in prefix]).cast("array<string>")
    terms = F.array(*[F.lit(r["term"]) for r in known.collect()]).cast("array<string>")
    longest = base.agg(F.coalesce(F.max(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    units = numbered.unionByName(line_runs(numbered, terms, max(2, 2 * longest)))
    chosen = settled(units.where(F.arrays_overlap("words", wanted)), "statements")
    key = ["file", "line", "n_lines"]
    scores = cosines(term_weights(chosen, idf, F.lit(rest), key), vectors, key, least)
    best = scores.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("minus"), "n_lines", "license", "line")).alias("best"))
    sized = chosen.select(*key, (F.size("words") / F.col("n_words")).alias("share"))
    picked = best.select("file", "best.license", (-F.col("best.minus")).alias("score"), "best.line", "best.n_lines")
    by_line = picked.join(sized, key).select("file", "license", "score", "share")

    # Whole files. Rare terms first, so that words of any prose stay out of the prefix.
    bodies = settled(term_weights(whole, all_idf, F.lit(rest), ["license", "template"], damped=True), "full-texts")
    rare = prefix_terms(bodies.join(all_idf, "term"), least, [F.desc("idf"), F.col("term")])
    chosen = seen.where(F.col("term").isin(rare)).select("file").distinct()
    texts = files.join(settled(chosen, "likely-bodies"), "file", "left_semi").groupBy("file").agg(F.any_value("text").alias("text"))
    weights = term_weights(texts.select("file", words_of(F.col("text")).alias("words")), all_idf, F.lit(rest), ["file"], damped=True)
    top = cosines(weights, bodies, ["file"], least).groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"))
    by_file = settled(top.select("file", "best.license", (-F.col("best.minus")).alias("score"), F.lit(1.0).alias("share")), "licence-bodies")
    return by_file.unionByName(by_line.join(by_file, "file", "left_anti"))


def license_scan(files: DataFrame, templates: DataFrame | None = None, least: float = 0.75, file_share: float = 0.25) -> DataFrame:
    """``files`` (path, text, ...) with own_license, own_score, license, license_from (the path it comes from) and up.

    ``up`` counts the directories between file and licence file; 0 is the file's own licence.
    """
    spark = files.sparkSession
    if templates is None:
        templates = spark.createDataFrame(TEMPLATES, "license string, text string")
    templates = templates.withColumn("template", F.xxhash64("text"))
    bodies = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted(FULL_TEXTS.glob("*.txt"))]
    full = spark.createDataFrame(bodies, "license string, text string").withColumn("template", F.xxhash64("text"))
    named = files.select(
        F.xxhash64("path", F.col("text").cast("string")).alias("file"), F.col("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    found = settled(statements(named.select("file", "text"), templates, full, least), "licenses")
    own = named.select("file", "path").join(found, "file")
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    governing = own.where(F.col("path").isNotNull() & (name.isin(*FILE_NAMES) | (F.col("share") >= file_share)))
    places = settled(
        governing.groupBy(F.get(ancestors(F.col("path")), F.lit(0)).alias("dir"))
        .agg(F.min(F.struct((-F.col("score")).alias("minus"), "license", "path")).alias("top"))
        .select("dir", F.col("top.license").alias("d_license"), F.col("top.path").alias("d_path")),
        "license-files",
    )
    above = named.select("path").where("path IS NOT NULL").distinct().select("path", F.posexplode(ancestors(F.col("path"))).alias("at", "dir"))
    nearest = (
        above.join(places, "dir")
        .groupBy(F.col("path").alias("__path"))
        .agg(F.min(F.struct("at", "d_license", "d_path")).alias("__near"))
    )
    fresh = ("own_license", "own_score", "license", "license_from", "up")
    kept = files.drop(*fresh).withColumn("__file", F.xxhash64("path", F.col("text").cast("string")))
    out = kept.join(
        found.select(F.col("file").alias("__file"), F.col("license").alias("__own"), F.col("score").alias("__score")), "__file", "left"
    ).join(nearest, F.col("path") == F.col("__path"), "left")
    has = F.col("__own").isNotNull()
    return out.select(
        *[F.col(f"`{c}`") for c in files.drop(*fresh).columns],
        F.col("__own").alias("own_license"),
        F.col("__score").alias("own_score"),
        F.coalesce("__own", "__near.d_license").alias("license"),
        F.when(has, F.col("path")).otherwise(F.col("__near.d_path")).alias("license_from"),
        F.when(has, F.lit(0)).otherwise(F.col("__near.at") + 1).cast("long").alias("up"),
    )
