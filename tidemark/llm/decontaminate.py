"""Benchmark decontamination by a prefix-filtered containment join. DataFrame functions only.

An item's windows are all runs of ``window`` consecutive words, or the whole item if it is shorter.
A window occurs in a text only if each of its words does, so one word is a sufficient prefix. Words
are ordered by rarity, their number of occurrences in the corpus (counted for benchmark words
only), and each window is represented by its rarest word. Occurrences of these words are the
candidates; they give a window's start, which must leave room before and after it (positional and
length bounds). What is left is verified word by word, and the words covered are counted.

The texts are read three times (counts, candidates, verification); only candidate positions are
shuffled, and texts once if the candidates are too many to broadcast. No side is hinted: tables
derived from the benchmark are stored first, so the optimizer broadcasts them only below its
threshold and otherwise joins by sorting, with skewed words split at run time.

Defined results: NULL, empty and wordless texts have 0 words and hits; such items have no windows,
and an empty benchmark leaves everything clean. Items repeated under one id count once. Repeated rows
each get their result: rows are matched by id and text hash. Columns besides ids and texts are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.keyed import settled

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ASCII characters that separate words: all but digits and letters.
BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def words_of(text: Column) -> Column:
    """Words in order: runs of digits, a-z after lower-casing A-Z, and characters beyond ASCII."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + BREAKS, LOWER + " " * len(BREAKS))
    return F.array_remove(F.split(plain, " "), "")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(item, words): distinct windows of each item; the item id as text."""
    item = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - window + 1))
    return item.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words")).distinct()


def covered_words(spans: Column) -> Column:
    """Number of positions inside any (start, size) of an array."""
    first = F.struct(F.lit(0).alias("reach"), F.lit(0).alias("n"))

    def add(state: Column, span: Column) -> Column:
        end = span["start"] + span["size"]
        return F.struct(
            F.greatest(state["reach"], end).alias("reach"),
            (state["n"] + F.greatest(F.lit(0), end - F.greatest(state["reach"], span["start"]))).alias("n"),
        )

    return F.aggregate(F.array_sort(F.array_distinct(spans)), first, add, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Per row: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated (n_hit * ``share`` >= n_words)."""
    texts = docs.select(
        "doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text")
    )
    found = settled(item_windows(items, window), "item-windows")
    numbered = settled(found.select("words").distinct().withColumn("id", F.monotonically_increasing_id()), "windows")
    owners = settled(found.join(numbered, "words").select("id", "item"), "window-items")

    # Rarity of the benchmark's words.
    known = settled(numbered.select(F.explode("words").alias("word")).distinct(), "item-words")
    seen = texts.select(F.explode(words_of(F.col("text"))).alias("word")).join(known, "word").groupBy("word").count()
    rarity = known.join(settled(seen, "rarity"), "word", "left").select("word", F.coalesce("count", F.lit(0)).alias("n"))
    rarest = (
        numbered.select("id", "words", F.explode(F.array_distinct("words")).alias("word"))
        .join(rarity, "word")
        .groupBy("id")
        .agg(F.min(F.struct("n", "word")).alias("least"), F.any_value("words").alias("words"))
        .where("least.n > 0")
    )
    prefixes = settled(
        rarest.select(
            F.col("least.word").alias("word"), "id", F.size("words").alias("size"),
            F.concat_ws(" ", "words").alias("window"), (F.array_position("words", F.col("least.word")) - 1).cast("int").alias("offset"),
        ),
        "prefixes",
    )

    # Candidates: an occurrence of the prefix word, with room for the window around it.
    placed = (
        texts.withColumn("words", words_of(F.col("text")))
        .select("doc_id", "text_hash", F.size("words").alias("n_words"), F.posexplode("words").alias("at", "word"))
        .join(prefixes.select("word", "id", "size", "offset"), "word")
        .where("at >= offset AND at - offset + size <= n_words")
        .select("doc_id", "text_hash", F.struct((F.col("at") - F.col("offset")).alias("start"), "size", "id").alias("spot"))
        .distinct()
    )
    spots = settled(
        placed.join(prefixes.select("id", "window"), F.col("spot.id") == F.col("id"))
        .groupBy(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"))
        .agg(F.collect_list(F.struct("spot.start", "spot.size", "spot.id", "window")).alias("spots")),
        "candidates",
    )

    # Verification, and the counts of every text.
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash"))
    checked = (
        texts.join(spots, same, "left")
        .withColumn("words", words_of(F.col("text")))
        .select(
            "doc_id",
            "text_hash",
            F.size("words").alias("n_words"),
            F.filter(
                "spots", lambda s: F.concat_ws(" ", F.slice("words", s["start"] + 1, s["size"])) == s["window"]
            ).alias("hits"),
        )
        .select(
            "doc_id",
            "text_hash",
            "n_words",
            F.transform("hits", lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"))).alias("spans"),
            F.array_distinct(F.transform("hits", lambda s: s["id"])).alias("ids"),
        )
        .select("doc_id", "text_hash", "n_words", F.coalesce(covered_words(F.col("spans")), F.lit(0)).alias("n_hit"), "ids")
    )
    checked = settled(checked, "checked")
    named = (
        checked.where("n_hit > 0")
        .select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), F.explode("ids").alias("id"))
        .join(owners, "id")
        .groupBy("c_id", "c_hash")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .select("c_id", "c_hash", F.size("items").alias("n_items"), F.concat_ws(",", "items").alias("items"))
    )
    n_words, n_hit = F.col("n_words").cast("long"), F.col("n_hit").cast("long")
    return checked.join(named, same, "left").select(
        "doc_id",
        "text_hash",
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * share >= n_words)).alias("contaminated"),
    )
