"""Small inputs with everything that may be odd in them."""

from __future__ import annotations

PROSE = "the quick brown fox jumps over a lazy dog while seven grey geese fly slowly past some old stone mill near our river"


def prose(seed: int, words: int) -> str:
    """Deterministic text in which few n-grams repeat."""
    base, out, x = PROSE.split(), [], seed * 7919 + 13
    for i in range(words):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(base[(x >> 8) % len(base)] + (str(x % 97) if i % 3 else ""))
    return " ".join(out)


def odd_documents(spark):
    """NULL ids and texts, empty, blank and long texts, repeated rows, odd characters, clashing columns."""
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, prose(4, 80)), (4, prose(4, 80)), (None, prose(5, 60)), (None, None),
        (6, prose(6, 20000)), (7, "x" * 5000), (8, "naïve ▁ ﬁ   \U0001f600 \x1c \r\n one  two"), (9, "a b c"), (10, "A b C"),
        (11, prose(4, 80)), (12, "you idiot"),
    ]
    extra = "score double, n_words int, words string, row int, label string, kept int, node int, lang string, source string"
    return spark.createDataFrame(
        [(d, t, 0.5, 1, "w", 2, "l", 3, 4, None, "s") for d, t in rows], f"doc_id long, text string, {extra}"
    )


def no_documents(spark):
    return odd_documents(spark).limit(0)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def labels(spark):
    rows = [(4, 1, 0), (None, 1, 1), (6, None, 0), (7, 0, 1), (9, 1, 0), (9, 0, 0), (12, 0, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
