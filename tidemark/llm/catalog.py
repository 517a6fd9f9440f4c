"""Registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrow import hashed_share
from tidemark.llm.chat_format import chat_digest, format_chats
from tidemark.llm.decontaminate import contamination
from tidemark.llm.hard_negatives import hard_negatives
from tidemark.llm.license_scan import FILE_NAMES, TEMPLATES, license_scan
from tidemark.llm.lm_ppm import score_ppm, train_ppm
from tidemark.llm.ngram_join import ngram_classes
from tidemark.llm.quality_classifier import fit_quality, quality_score
from tidemark.llm.quality_rules import Rules, quality_rules
from tidemark.llm.repeated_passages import without_repeats
from tidemark.llm.sentencepiece_lattice import DIGEST, digest, encode_texts, read_pieces
from tidemark.llm.token_files import read_token_files, write_token_files
from tidemark.llm.toxicity import fit_toxicity, toxicity
from tidemark.llm.turn_repair import audits, damaged, repaired_digest, repaired_turns
from tidemark.operators.keyed import keyed_join, settled
from tidemark.session import scratch_path

#: Folder of the vocabulary files.
TOKENIZERS = str(Path(public_tokenizers.path("byte_bpe_50k.json")).parent)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, read(spark, sf_dir, "labels"))
    scored = quality_score(docs.withColumn("held_out", hashed_share("doc_id", 4, 2)), model)
    return scored.select("doc_id", "held_out", "score", "predicted", "n_passages")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below source/language/hundreds of ids."""
    folder = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat_ws("/", "source", "lang", folder, F.col("doc_id").cast("string"))
    found = license_scan(read(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))
    return found.select("doc_id", "own_license", F.round("own_score", 6).alias("own_score"), "license", "license_from", "up")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = read_pieces(f"{TOKENIZERS}/piece_bpe_32k.model")
    return encode_texts(documents(spark, sf_dir), pieces, DIGEST, digest)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat_digest(format_chats(rows.unionByName(more)))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), hashed_share("doc_id", 7, 2)
    return score_ppm(docs, train_ppm(docs, ~held_out), held_out)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), read(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_classes(documents(spark, sf_dir)).select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    shards = write_token_files(documents(spark, sf_dir), folder, f"{TOKENIZERS}/byte_bpe_50k.json", end=2)
    return read_token_files(spark, folder, shards).drop("shard")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    grammar = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    scored = toxicity(docs.withColumn("held_out", hashed_share("doc_id", 5, 0)), grammar)
    return scored.select("doc_id", "held_out", "score", "predicted", "n_matches", "n_clauses")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    audited = settled(audits(rows), "audits")
    digests = repaired_digest(repaired_turns(rows, audited))
    all_ids = conversations.select("conv_id").distinct()
    out = keyed_join(keyed_join(all_ids, audited, ["conv_id"], "left"), digests, ["conv_id"], "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", kept)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_license_scan, op3_sentencepiece, op4_chat_format, op5_lm_score,
        op6_decontaminate, op7_ngram_jaccard, op8_token_files, op9_toxicity, op10_quality_rules,
        op11_turn_repair, op12_repeated_passages, op13_hard_negatives,
    )
}

# Characters as SQL text.
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SOLID = r"[^\x20\x09-\x0D]+"


def _words(text: str, pattern: str, lower: bool = True) -> str:
    text = f"translate({text}, '{_UP}', '{_LOW}')" if lower else text
    return f"coalesce(regexp_extract_all({text}, '{pattern}'), [])"


def _escaped(text: str) -> str:
    for a, b in (("\\", "\\\\"), ("<|", "<\\|"), ("</s>", "<\\/s>"), ("<s>", "<\\s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]")):
        text = f"replace({text}, '{a}', '{b}')"
    return text


OP4_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|' || {_escaped('role')} || '|>' || chr(10) || {_escaped('text')} || '<|end|>' || chr(10)))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP6_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words('text', _PLAIN)} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_words('text', _PLAIN)} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM items, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
),
hits AS (SELECT r, n, i, item FROM runs JOIN windows USING (n, g)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY r),
names AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN cover USING (r) LEFT JOIN names USING (r)
"""

OP7_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_words('text', _SOLID)} AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM docs, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
both_in AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM sets a JOIN sets b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM both_in JOIN sizes s ON x = s.doc_id JOIN sizes t ON y = t.doc_id WHERE 100 * i >= 85 * (s.n + t.n - i)
),
reach(x, y) AS (SELECT doc_id, doc_id FROM docs UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT docs.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""

_RULES = Rules()
_GRAMS = " UNION ALL ".join(
    f"SELECT r, {n} AS n, i, g FROM (SELECT r, i, count(*) OVER span AS have, string_agg(x, ' ') OVER span AS g FROM word "
    f"WINDOW span AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)) WHERE have = {n}"
    for n in [3, *(n for n, _ in _RULES.gram_shares)]
)
_LIMITS = ", ".join(f"({n}, {share})" for n, share in _RULES.gram_shares)
OP10_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_words('text', _SOLID, lower=False)} AS w FROM documents
),
base AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM docs
),
lines AS (
  SELECT r, x, count(*) AS n, any_value(length(regexp_replace(x, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars
  FROM docs, unnest(string_split(t, chr(10))) AS u(x) WHERE regexp_matches(x, '{_SOLID}') GROUP BY r, x
),
line AS (SELECT r, sum(n - 1) AS n_dup_lines, sum((n - 1) * chars) AS dup_chars FROM lines GROUP BY r),
lengths(n, most) AS (VALUES (3, NULL), {_LIMITS}),
word AS (SELECT r, i, x FROM docs, unnest(w) WITH ORDINALITY AS u(x, i)),
grams AS ({_GRAMS}),
again AS (SELECT r, n, i FROM (SELECT *, count(*) OVER (PARTITION BY r, n, g) AS times FROM grams) WHERE times > 1),
inside AS (SELECT DISTINCT r, n, p FROM again, unnest(range(i, i + n)) AS t(p)),
shares AS (
  SELECT inside.r, n, count(*) AS words, sum(length(x)) AS chars FROM inside JOIN word ON word.r = inside.r AND i = p GROUP BY ALL
),
repeats AS (
  SELECT r, coalesce(max(words) FILTER (n = 3), 0) AS n_repeat_words,
    bool_or(coalesce(shares.chars::DOUBLE / word_chars > most::DOUBLE, false)) AS bad
  FROM shares JOIN lengths USING (n) JOIN base USING (r) GROUP BY r
),
judged AS (
  SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    n_words < {_RULES.min_words} OR coalesce(n_repeat_words, 0) > {_RULES.repeat_share} * n_words AS base_failed,
    coalesce(bad, false) OR coalesce(dup_chars::DOUBLE / word_chars > {_RULES.line_share}, false)
      OR n_symbols > {_RULES.symbols_per_word} * n_words AS bad
  FROM base LEFT JOIN line USING (r) LEFT JOIN repeats USING (r)
)
SELECT * EXCLUDE (bad), NOT (base_failed OR bad) AS kept FROM judged
"""

_TEMPLATES = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES)
_NAMES = ", ".join(f"'{n}'" for n in FILE_NAMES)
OP2_SQL = f"""
WITH files AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    concat_ws('/', source, lang, floor(doc_id / 100)::BIGINT::VARCHAR, doc_id::VARCHAR) AS path FROM documents
),
templates(license, t) AS (VALUES {_TEMPLATES}),
words AS (SELECT r, {_words('t', _PLAIN)} AS w FROM files),
known AS (SELECT DISTINCT unnest({_words('t', _PLAIN)}) AS term FROM templates),
idf AS (
  SELECT term, ln(1 + (SELECT count(*) FROM files)) + 1 - ln(1 + count(r)) AS idf
  FROM known LEFT JOIN (SELECT r, unnest(list_distinct(w)) AS term FROM words) USING (term) GROUP BY term
),
units AS (
  SELECT 'file' AS kind, r, NULL AS license, i AS line, {_words('x', _PLAIN)} AS w
  FROM files, unnest(string_split(t, chr(10))) WITH ORDINALITY AS u(x, i)
  UNION ALL SELECT 'template', row_number() OVER (), license, 0, {_words('t', _PLAIN)} FROM templates
),
terms AS (
  SELECT kind, r, license, line, term, count(*) AS n FROM (SELECT kind, r, license, line, unnest(w) AS term FROM units) GROUP BY ALL
),
weights AS (SELECT terms.*, n * coalesce(idf, ln(1 + (SELECT count(*) FROM files)) + 1) AS v FROM terms LEFT JOIN idf USING (term)),
norms AS (SELECT kind, r, line, sqrt(sum(v * v)) AS norm FROM weights GROUP BY ALL),
dots AS (
  SELECT a.r, a.line, b.r AS template, any_value(b.license) AS license, sum(a.v * b.v) AS dot
  FROM weights a JOIN weights b ON a.term = b.term AND a.kind = 'file' AND b.kind = 'template' GROUP BY a.r, a.line, b.r
),
scores AS (
  SELECT dots.r, dots.line, license, round(dot / x.norm / y.norm, 9) AS score
  FROM dots JOIN norms x ON x.kind = 'file' AND x.r = dots.r AND x.line = dots.line JOIN norms y ON y.kind = 'template' AND y.r = template
  WHERE round(dot / x.norm / y.norm, 9) >= 0.75
),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, license, line) = 1),
own AS (
  SELECT best.r, best.license, best.score, path, len(units.w) / len(words.w) AS share
  FROM best JOIN files USING (r) JOIN words USING (r) JOIN units ON units.kind = 'file' AND units.r = best.r AND units.line = best.line
),
places AS (
  SELECT array_to_string(string_split(path, '/')[:-2], '/') AS dir, license, path FROM own
  WHERE share >= 0.25 OR lower(string_split(path, '/')[-1]) IN ({_NAMES})
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license, path) = 1
),
above AS (
  SELECT files.r, i AS up, array_to_string(string_split(path, '/')[:-1 - i], '/') AS dir
  FROM files, unnest(range(1, len(string_split(path, '/')) + 1)) AS t(i)
),
near AS (
  SELECT above.r, up, license, path FROM above JOIN places USING (dir)
  QUALIFY row_number() OVER (PARTITION BY above.r ORDER BY up) = 1
)
SELECT doc_id, own.license AS own_license, round(own.score, 6) AS own_score, coalesce(own.license, near.license) AS license,
  CASE WHEN own.license IS NOT NULL THEN files.path ELSE near.path END AS license_from,
  CASE WHEN own.license IS NOT NULL THEN 0 ELSE near.up END::BIGINT AS up
FROM files LEFT JOIN own USING (r) LEFT JOIN near USING (r)
"""

OP12_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_words('text', _SOLID, lower=False)} AS w FROM documents),
runs AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS g FROM docs, unnest(range(1, len(w) - 33)) AS t(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM runs) WHERE n > 1),
gone AS (SELECT DISTINCT r, p FROM again, unnest(range(i, i + 35)) AS t(p)),
word AS (SELECT r, p, x FROM docs, unnest(w) WITH ORDINALITY AS u(x, p)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""

OP13_SQL = """
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, b.r,
    list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.r <> b.r
),
near AS (
  SELECT * FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) <= 5
),
pairs AS (
  SELECT near.anchor, near.r AS positive, near.anchor_id, near.vec_id AS positive_id, near.score AS positive_score,
    far.vec_id AS negative_id, far.score AS negative_score, far.r
  FROM near JOIN scores far ON far.anchor = near.anchor AND NOT far.same
    AND 30 * near.score <= 100 * far.score AND 100 * far.score <= 90 * near.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM (
  SELECT *, row_number() OVER (PARTITION BY anchor, positive ORDER BY negative_score DESC, negative_id NULLS LAST, r) AS rank FROM pairs
) WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": OP2_SQL,
    "op4_chat_format": OP4_SQL,
    "op6_decontaminate": OP6_SQL,
    "op7_ngram_jaccard": OP7_SQL,
    "op10_quality_rules": OP10_SQL,
    "op12_repeated_passages": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
