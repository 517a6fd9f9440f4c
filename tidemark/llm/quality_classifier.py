"""Text quality by attention-based multiple-instance learning.

A text is a bag of passages of ``passage_words`` words. Each passage is described by shares of
character and word kinds and by repetition, encoded by one tanh layer, and weighted by gated
attention, softmax(w . (tanh(Vh) * sigmoid(Uh))) over the bag; the weighted passage vector is
scored by a logistic unit. Only text labels are used; the attention weights are learned with them
(numpy, Adam) from a bounded, balanced sample, and the constant is moved to the true label share.
Scoring covers every passage of every text in one pass without a shuffle.

Defined results: NULL, empty and blank texts are bags of one all-zero passage and get a score like
any other. Without labels of both kinds every score is the share of label 1 (0 without labels).
Repeated rows are scored alike. Extra columns pass through; one named like a result column is
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.arrow import add_columns, as_bytes, slices
from tidemark.llm.labelled import labelled_sample

COLUMNS = "score double, predicted int, n_passages long, top_passage long"
SPACE = b" \t\n\r\x0b\x0c"
# Kinds of bytes that are counted; white space is not.
KINDS = (
    b"abcdefghijklmnopqrstuvwxyz",
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"0123456789",
    b".,;:?",
    b"!",
    b"|",
    b"#*$%&<>",
    b"\"'()-",
    bytes(range(0x80, 0x100)),
)
LOWER, UPPER, BANG, BAR, SYMBOL = 0, 1, 4, 5, 6
N_FEATURES = len(KINDS) + 9


def _table() -> tuple[np.ndarray, np.ndarray]:
    kind, space = np.full(256, len(KINDS), np.uint8), np.zeros(256, bool)
    for k, chars in enumerate(KINDS):
        kind[list(chars)] = k
    space[list(SPACE)] = True
    return kind, space


KIND, IS_SPACE = _table()


def passages(texts: list[bytes], passage_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages in order, and the first row of each text."""
    joined = b"\n".join(texts) + b"\n"
    a = np.frombuffer(joined, np.uint8)
    solid = ~IS_SPACE[a]
    before = np.empty(len(a), bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(~solid & before)
    offsets = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=offsets[1:])
    n_words = np.diff(np.append(np.searchsorted(starts, offsets), len(starts)))
    n_passages = np.maximum(-(-n_words // passage_words), 1)
    first = np.cumsum(n_passages) - n_passages
    rows = np.zeros((int(n_passages.sum()), N_FEATURES))
    if not len(starts):
        return rows, first
    text_of = np.repeat(np.arange(len(texts)), n_words)
    rank = np.arange(len(starts)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    passage = first[text_of] + rank // passage_words
    begin = np.flatnonzero(np.diff(passage, prepend=-1))
    at = passage[begin]  # rows that have words
    kinds = KIND[a]
    per_word = {k: np.add.reduceat((kinds == k).astype(np.int32), starts) for k in range(len(KINDS))}
    lens = ends - starts
    size = np.add.reduceat(lens, begin).astype(float)
    for k, n in per_word.items():
        rows[at, k] = np.add.reduceat(n, begin) / size
    words = np.add.reduceat(np.ones(len(starts)), begin)

    def share(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags.astype(np.int32), begin) / words

    codes = np.fromiter(map(hash, joined.split()), np.int64, len(starts))
    same = np.zeros(len(starts), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1])
    order = np.lexsort((codes, passage))
    repeat = np.zeros(len(starts), bool)
    repeat[order[1:]] = (codes[order[1:]] == codes[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])
    base = len(KINDS)
    rows[at, base] = share(same)
    rows[at, base + 1] = share(repeat)
    rows[at, base + 2] = share(per_word[SYMBOL] > 0)
    rows[at, base + 3] = share(per_word[BAR] > 0)
    rows[at, base + 4] = share((per_word[UPPER] > 1) & (per_word[LOWER] == 0))
    rows[at, base + 5] = share(per_word[BANG] > 0)
    rows[at, base + 6] = size / words / 10
    rows[at, base + 7] = np.log1p(words) / 5
    rows[at, base + 8] = 1.0
    return rows, first


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the labelled texts read for fitting, ``passages_per_text`` their passages (evenly spaced)."""

    per_class: int = 3000
    passages_per_text: int = 64
    passage_words: int = 64
    hidden: int = 16
    attention: int = 8
    epochs: int = 40
    batch: int = 128
    rate: float = 0.01
    decay: float = 1e-4


@dataclass(frozen=True)
class Model:
    weights: dict[str, np.ndarray]
    passage_words: int
    prior: float

    def score(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag and the position of its passage with the largest attention weight."""
        if not self.weights:
            return np.full(len(first), self.prior), np.zeros(len(first), np.int64)
        out = forward(self.weights, x, first)
        bag = out["bag"]
        top = np.maximum.reduceat(out["a"], first)
        is_top = np.flatnonzero(out["a"] == top[bag])
        where = np.full(len(first), -1)
        where[bag[is_top][::-1]] = is_top[::-1]
        return out["p"], where - first


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -40, 40)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    xn = (x - p["mean"]) / p["scale"]
    h = np.tanh(xn @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    e = (t * g) @ p["w"]
    a = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first)
    return {"bag": bag, "xn": xn, "h": h, "t": t, "g": g, "a": a, "z": z, "p": sigmoid(z @ p["c"] + p["c0"])}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    f = forward(p, x, first)
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
    do = (f["p"] - y) / len(y)
    dz = do[:, None] * p["c"]
    da = (h * dz[bag]).sum(1)
    de = a * (da - np.add.reduceat(a * da, first)[bag])
    dtg = de[:, None] * p["w"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh = a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T
    pre = dh * (1 - h * h)
    return {
        "W": f["xn"].T @ pre, "b": pre.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de,
        "c": f["z"].T @ do, "c0": np.array(do.sum()),
    }


def train(bags: list[np.ndarray], y: np.ndarray, prior: float, s: Settings) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    everything = np.concatenate(bags)
    p = {
        "mean": everything.mean(0),
        "scale": np.maximum(everything.std(0), 1e-3),
        "W": rng.normal(0, N_FEATURES**-0.5, (N_FEATURES, s.hidden)),
        "b": np.zeros(s.hidden),
        "V": rng.normal(0, s.hidden**-0.5, (s.hidden, s.attention)),
        "U": rng.normal(0, s.hidden**-0.5, (s.hidden, s.attention)),
        "w": rng.normal(0, s.attention**-0.5, s.attention),
        "c": rng.normal(0, s.hidden**-0.5, s.hidden),
        "c0": np.array(0.0),
    }
    names = [k for k in p if k not in ("mean", "scale")]
    m1, m2, step = {k: 0.0 * p[k] for k in names}, {k: 0.0 * p[k] for k in names}, 0
    for _ in range(s.epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), s.batch):
            part = order[i : i + s.batch]
            sizes = np.array([len(bags[j]) for j in part])
            grad = gradients(p, np.concatenate([bags[j] for j in part]), np.cumsum(sizes) - sizes, y[part])
            step += 1
            for k in names:
                d = grad[k] + s.decay * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.999 * m2[k] + 0.001 * d * d
                p[k] = p[k] - s.rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    share = y.mean()
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    p["c0"] = p["c0"] + np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return p


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, remainder: int = 2, settings: Settings = Settings()  # noqa: B008
) -> Model:
    """Fit on labelled texts, leaving out ids with crc32 mod ``modulus`` = ``remainder``.

    The driver gets at most 2 * ``per_class`` bags of ``passages_per_text`` short feature rows.
    """
    sample = labelled_sample(docs, labels, label, modulus, remainder, settings.per_class)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = as_bytes(b.column(0))
            for i, j in slices(texts):
                x, first = passages(texts[i:j], settings.passage_words)
                found = []
                for u, v in zip(first, np.append(first[1:], len(x)), strict=True):
                    n = min(v - u, settings.passages_per_text)
                    found.append(x[u + np.arange(n) * (v - u) // n].ravel())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), b.column(1).slice(i, j - i)], names=["x", "label"])

    rows = sample.rows.select("text", "label").mapInArrow(describe, "x array<double>, label int").toArrow()
    y = np.array(rows.column("label").to_pylist(), float)
    if len(set(y.tolist())) < 2:
        return Model({}, settings.passage_words, sample.prior)
    bags = [np.array(x.as_py()).reshape(-1, N_FEATURES) for x in rows.column("x")]
    return Model(train(bags, y, sample.prior, settings), settings.passage_words, sample.prior)


def quality_score(df: DataFrame, model: Model, text: str = "text", accept: float = 0.7) -> DataFrame:
    """``df`` with score, predicted (1 from ``accept`` on), the number of passages and the one attended to most."""

    def make():
        def compute(texts: list[bytes]):
            x, first = passages(texts, model.passage_words)
            score, top = model.score(x, first)
            return score, (score >= accept).astype(np.int32), np.diff(np.append(first, len(x))), top

        return compute

    return add_columns(df, COLUMNS, make, text)
