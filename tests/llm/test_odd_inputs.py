"""Defined results on NULL, empty, blank, long, repeated and clashing rows, and on empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.samples import PROSE, labels, no_documents, no_labels, odd_documents
from tidemark.llm import sentencepiece_lattice
from tidemark.llm.arrow import BATCH_BYTES, SLICE_BYTES, add_columns, bounded_batches
from tidemark.llm.catalog import TOKENIZERS
from tidemark.llm.chat_format import chat_digest, format_chats
from tidemark.llm.decontaminate import contamination
from tidemark.llm.license_scan import license_scan
from tidemark.llm.lm_ppm import score_ppm, train_ppm
from tidemark.llm.ngram_join import ngram_classes
from tidemark.llm.quality_classifier import fit_quality, quality_score
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.sentencepiece_lattice import decode_texts, encode_texts, read_pieces
from tidemark.llm.token_files import read_token_files, write_token_files
from tidemark.llm.toxicity import fit_toxicity, toxicity
from tidemark.session import scratch_path

N = 14
NOTHING = hashlib.sha256(b"").hexdigest()


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("fit,apply", [(fit_quality, quality_score), (fit_toxicity, toxicity)])
def test_classifiers(spark, fit, apply):
    docs = odd_documents(spark)
    for known in (no_labels(spark), labels(spark)):
        out = apply(docs, fit(docs, known))
        rows = out.collect()
        assert len(rows) == N and all(0 <= r["score"] <= 1 for r in rows)
        assert set(docs.columns) <= set(out.columns)
    assert apply(no_documents(spark), fit(no_documents(spark), labels(spark))).count() == 0


def test_quality_rules(spark):
    out = quality_rules(odd_documents(spark))
    assert out.count() == N and out.columns.count("n_words") == 1
    rows = by_id(out)
    assert rows[1]["n_words"] == rows[2]["n_words"] == rows[3]["n_words"] == 0 and rows[1]["base_failed"] and not rows[1]["kept"]
    assert rows[8]["n_words"] == 8 and rows[8]["word_chars"] == 20 - 4 + 0 or rows[8]["n_words"] > 0
    assert quality_rules(no_documents(spark)).count() == 0


def test_language_model(spark):
    docs = odd_documents(spark)
    for train in (F.lit(True), F.lit(False), F.coalesce(F.col("doc_id") < 7, F.lit(False))):
        rows = score_ppm(docs, train_ppm(docs, train), ~train).collect()
        assert len(rows) == N and all(r["score"] < 0 for r in rows)
        assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    assert score_ppm(no_documents(spark), train_ppm(no_documents(spark), F.lit(True)), F.lit(False)).count() == 0


def test_contamination(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, None), (2, ""), (3, None), (None, "idiot")], "item_id long, text string")
    out = contamination(docs, items)
    rows = by_id(out)
    assert out.count() == N
    assert rows[9]["n_hit"] == rows[10]["n_hit"] == 3 and rows[9]["contaminated"] and rows[9]["n_items"] == 1
    assert rows[1]["n_words"] == 0 and rows[1]["items_sha256"] == NOTHING and not rows[1]["contaminated"]
    assert contamination(docs, items.limit(0)).where("contaminated").count() == 0
    assert contamination(no_documents(spark), items).count() == 0


def test_near_copies(spark):
    out = ngram_classes(odd_documents(spark))
    rows = by_id(out)
    assert out.count() == N
    assert rows[11]["component_id"] == rows[4]["component_id"] == 4 and rows[10]["component_id"] == 9
    assert rows[1]["n_shingles"] == rows[3]["n_shingles"] == 0 and rows[3]["component_id"] == 3
    assert rows[9]["n_shingles"] == 1
    assert ngram_classes(no_documents(spark)).count() == 0


def test_sentencepiece(spark):
    pieces = read_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    docs = odd_documents(spark)
    encoded = encode_texts(docs, pieces, keep=("doc_id", "text"), hot_units=40, fold_chars=32)
    back = decode_texts(encoded.withColumnRenamed("text", "original"), pieces).collect()
    assert len(back) == N
    for r in back:
        assert r["text"] == (r["original"] or "").replace("▁", " ")
    assert encode_texts(no_documents(spark), pieces).count() == 0


@pytest.mark.parametrize("how", ["by window", "by join"])
def test_texts_get_rare_units_where_they_are_read(spark, monkeypatch, how):
    """With nearly all units rare: no join over texts, several windows a task; a join if the folder lacks them."""
    pieces = read_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    docs = odd_documents(spark).repartition(2).persist()
    want = encode_texts(docs, pieces, keep=("text",)).toPandas()
    monkeypatch.setattr(sentencepiece_lattice, "WINDOW_BYTES", 900)
    if how == "by join":
        monkeypatch.setattr(sentencepiece_lattice, "units_by_task", lambda *_: scratch_path(spark, "nothing"))
    got = encode_texts(docs, pieces, keep=("text",), hot_units=4)
    assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == (how == "by join")
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(want, got.schema).collect()))
    docs.unpersist()


def test_lattice_substrings(spark):
    """Lengths left out by the table of first characters are those of no piece."""
    pieces = read_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    lengths = dict(pieces.lengths_by_head())
    assert all(len(p) < 4 or len(p) in lengths[p[:4]] for p in pieces.text)


def test_token_files(spark):
    folder = scratch_path(spark, "odd")
    shards = write_token_files(odd_documents(spark), folder, f"{TOKENIZERS}/byte_bpe_50k.json", shard_ids=3000, block_ids=1000)
    rows = read_token_files(spark, folder, shards).orderBy("start").collect()
    assert len(rows) == N and rows[0]["doc_id"] is None and rows[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:], strict=False))
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    empty = scratch_path(spark, "empty")
    none = write_token_files(no_documents(spark), empty, f"{TOKENIZERS}/byte_bpe_50k.json")
    assert none.count() == 0 and read_token_files(spark, empty, none).count() == 0


def test_chat(spark):
    rows = [(1, 1, "user", None), (1, 1, "assistant", "x"), (1, 0, None, "<|end|>\n\\<|"), (None, None, "user", "b"), (1, 0, None, "<|end|>\n\\<|")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = {r["conv_id"]: r for r in chat_digest(format_chats(chats)).collect()}
    assert out[1]["n_turns"] == 4 and out[None]["n_turns"] == 1 and out[1]["loss_chars"] == 1
    want = "\n<|end|>\n\\<|\n" * 2 + "assistant\nx\nuser\n\n"
    assert out[1]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert chat_digest(format_chats(chats.limit(0))).count() == 0


def test_license(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c.txt", PROSE), ("a/b/d.txt", None), ("x.txt", ""), (None, "Released under the MIT License."),
        ("z/e.txt", f"{PROSE}\n{PROSE}\n// Licensed under the Apache License, Version 2.0.\n{PROSE}"), ("z/f.txt", PROSE), ("a/b/c.txt", PROSE),
    ]
    files = spark.createDataFrame(rows, "path string, text string").withColumn("up", F.lit("own")).withColumn("file", F.lit(1))
    out = license_scan(files)
    assert out.count() == len(rows)
    got = {r["path"]: (r["license"], r["license_from"], r["up"]) for r in out.collect()}
    assert got["a/b/c.txt"] == got["a/b/d.txt"] == ("MIT", "a/LICENSE", 2) and got["a/LICENSE"] == ("MIT", "a/LICENSE", 0)
    assert got["z/e.txt"] == ("Apache-2.0", "z/e.txt", 0) and got["z/f.txt"] == got["x.txt"] == (None, None, None)
    assert license_scan(files.limit(0)).count() == 0


def test_license_texts_and_wrapped_headers(spark):
    from tidemark.llm.license_scan import FULL_TEXTS

    rows = [(f"{f.stem}/LICENSE", f"Copyright (c) 2019 Some One\nAll rights reserved.\n\n{f.read_text()}") for f in FULL_TEXTS.glob("*.txt")]
    rows += [(f"{f.stem}/src/a.txt", PROSE) for f in FULL_TEXTS.glob("*.txt")]
    wrapped = "# This Source Code Form is subject\n# to the terms of the Mozilla\n#\n# Public License,\n# v. 2.0"
    rows += [("w/a.c", f"{PROSE}\n{wrapped}\n{PROSE}"), ("w/b.c", f"{PROSE}\nReleased under {PROSE}\n{PROSE} the MIT License"), ("w/c.c", PROSE * 9)]
    got = {r["path"]: r for r in license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for f in FULL_TEXTS.glob("*.txt"):
        assert got[f"{f.stem}/LICENSE"]["own_license"] == f.stem
        assert (got[f"{f.stem}/src/a.txt"]["license"], got[f"{f.stem}/src/a.txt"]["up"]) == (f.stem, 2)
    assert got["w/a.c"]["own_license"] == "MPL-2.0"
    assert got["w/b.c"]["own_license"] is None and got["w/c.c"]["own_license"] is None


def test_stages(spark, tmp_path):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
    # Repeated rows of the text that stays are one row; texts without words are no copies of each other.
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.where("doc_id IN (1, 2, 3, 4, 9, 10, 11)").collect()) == [1, 2, 3, 4, 9]
    clean = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert clean.count() == N - 2


def test_kept_text_is_passed_once(spark):
    rows = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, score string")
    out = add_columns(rows, "score long", lambda: lambda texts: [[len(t) for t in texts]])
    assert out.columns == ["doc_id", "text", "score"]
    assert sorted(map(tuple, out.collect())) == [(1, "a b", 3), (2, None, 0)]
    binary = rows.withColumn("text", rows["text"].cast("binary"))
    out = add_columns(binary, "size long", lambda: lambda texts: [[len(t) for t in texts]])
    assert sorted((r["doc_id"], r["size"]) for r in out.collect()) == [(1, 3), (2, 0)]


def test_own_bound_of_batches_is_left(spark):
    before = spark.conf.get(BATCH_BYTES)
    try:
        spark.conf.unset(BATCH_BYTES)
        bounded_batches(spark)
        assert spark.conf.get(BATCH_BYTES) == f"{SLICE_BYTES}b"
        spark.conf.set(BATCH_BYTES, "1m")
        bounded_batches(spark)
        assert spark.conf.get(BATCH_BYTES) == "1m"
    finally:
        spark.conf.set(BATCH_BYTES, before)
