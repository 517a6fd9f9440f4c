"""Quality rules on repetition: the share of a text's characters inside repeated n-grams and lines.

Words are runs of anything but ASCII white space. Every n-gram length gets a rolling hash of word
hashes, extended by one word per length; hashes that occur twice mark their words, and the marked
words' characters are summed, each word once however many n-grams cover it. Lines are compared
whole. A text is measured by itself, so no shuffle is needed and hot sources cost nothing extra.

Defined results: NULL, empty and blank texts have no words, all counts 0, and fail the base rule.
Repeated rows and ids are each measured. Extra columns pass through; one named like a result
column is replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.arrow import add_columns

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
# Bytes that are not the first of a code point.
FOLLOWERS = bytes(range(0x80, 0xC0))
STEP = np.uint64(0x9E3779B97F4A7C15)

COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "repeated_share double, line_share double, base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Rules:
    """Largest share of characters in repeated n-grams by n, in repeated lines, and of symbols by word."""

    min_words: int = 50
    repeat_share: float = 0.5
    gram_shares: tuple[tuple[int, float], ...] = ((5, 0.50), (6, 0.49), (7, 0.48), (8, 0.47), (9, 0.46), (10, 0.45))
    line_share: float = 0.30
    symbols_per_word: float = 0.10


def rolling(codes: np.ndarray, lengths: list[int]):
    """(n, hashes of all n-grams) for each wanted n, while any n-gram can still repeat."""
    h, n = codes, 1
    for want in lengths:
        while n < want and len(h) > 1:
            h = h[:-1] * STEP + codes[n:]
            n += 1
        if n < want:
            return
        yield n, h


def repeated(h: np.ndarray) -> np.ndarray:
    """Positions whose hash occurs twice or more."""
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not twice.size:
        return np.empty(0, np.int64)
    at = np.searchsorted(twice, h)
    at[at == len(twice)] = 0
    return np.flatnonzero(twice[at] == h)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in an n-gram that begins at one of ``starts``."""
    depth = np.zeros(size + 1, np.int64)
    depth[starts] += 1
    depth[starts + n] -= 1
    return np.cumsum(depth[:-1]) > 0


def measure(text: bytes, rules: Rules) -> tuple:
    words = text.split()
    size = len(words)
    chars = len(text.translate(None, SPACE + FOLLOWERS))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen, dup_lines, dup_line_chars = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(SPACE):
            if line in seen:
                dup_lines += 1
                dup_line_chars += len(line.translate(None, SPACE + FOLLOWERS))
            seen.add(line)
    line_share = dup_line_chars / chars if chars else 0.0
    repeat_words, share, bad = 0, 0.0, False
    if size > 3:
        lens = np.fromiter(map(len, b" ".join(words).decode("utf-8", "replace").split(" ")), np.int64, size)
        # Word hashes only have to agree within the text.
        codes = np.fromiter(map(hash, words), np.int64, size).view(np.uint64)
        limits = dict(rules.gram_shares)
        for n, h in rolling(codes, sorted({3, *limits})):
            starts = repeated(h)
            if not starts.size:
                break  # nor can any longer n-gram repeat
            inside = covered(starts, n, size)
            if n == 3:
                repeat_words = int(inside.sum())
            if n in limits:
                now = float(lens[inside].sum()) / chars
                share = max(share, now)
                bad |= now > limits[n]
    failed = size < rules.min_words or repeat_words > rules.repeat_share * size
    kept = not (failed or bad or line_share > rules.line_share or symbols > rules.symbols_per_word * size)
    return size, chars, symbols, dup_lines, repeat_words, share, line_share, failed, kept


def quality_rules(df: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """``df`` with the columns of ``COLUMNS``; ``kept`` is the verdict."""

    def make():
        return lambda texts: list(zip(*(measure(x, rules) for x in texts), strict=True)) or [()] * 9

    return add_columns(df, COLUMNS, make, text)
