"""Toxicity by a weighted finite-state grammar over clauses.

Words become classes (insult, threat, target, negation, reported speech, clause end). Small
machines each follow one thing: whether a target was just named, whether a negation is in force,
whether the clause reports speech. Their composition, a single deterministic machine, emits for
every insult or threat the reading it has there (directed or not, negated or not, reported or
not). A clause is scored by its readings, a text by its clauses.

What is learned, from a bounded sample of labelled texts: the insult stems (a stem accepts any
ending, so inflected forms match), chosen greedily by how many toxic texts they explain that are
not explained yet, and the weight of each reading (logistic regression). Target, negation,
report and threat words are fixed lists. Scoring is one pass without a shuffle.

Defined results: NULL and empty texts have no clause and get the score of a text without any
match. Without labels of both kinds there is nothing to learn and every score is the share of
toxic labels (0 without labels). Repeated rows are scored alike. Extra columns pass through; one
named like a result column is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import add_columns, as_bytes, bounded_batches
from tidemark.llm.labelled import labelled_sample

# Closed-class words in English, German, French and Spanish.
TARGETS = "you your yours he she him her they them du dich dir ihr euch sie tu te toi vous ton ta usted ustedes vosotros".split()
NEGATIONS = "not never no none neither cannot nicht nie kein keine pas jamais aucun nunca jamás ningún".split()
REPORTS = "said says say quoted wrote claimed reported sagte sagt schrieb dit disait écrit dijo dice escribió".split()
THREATS = "kill hurt murder destroy strangle stab töten umbringen tuer frapper matar golpear".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
PUNCTUATION = bytes(c for c in range(128) if not (chr(c).isalnum() or chr(c).isspace()))
BLANKS = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))
TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+|[.!?;:\n]")
COLUMNS = "score double, predicted int, n_matches long, n_clauses long"


def countdown(trigger: int, reach: int) -> list[list[int]]:
    """Machine that is active for ``reach`` words after ``trigger``, until the clause ends."""
    return [[0 if c == END else reach if c == trigger else max(s - 1, 0) for c in range(7)] for s in range(reach + 1)]


def until_end(trigger: int) -> list[list[int]]:
    """Machine that is active from ``trigger`` to the end of the clause."""
    return [[0 if c == END else 1 if c == trigger or s else 0 for c in range(7)] for s in range(2)]


def compose(machines: list[list[list[int]]]) -> tuple[list[list[int]], list[list[int]]]:
    """Product machine: next state by class, and the reading emitted (-1: none).

    A reading is 8 * (threat) + the bits of the active machines.
    """
    states, todo, step, emit = {(0,) * len(machines): 0}, [(0,) * len(machines)], [], []
    while todo:
        now = todo.pop(0)
        bits = sum(1 << i for i, s in enumerate(now) if s)
        following, readings = [], []
        for c in range(7):
            to = tuple(m[s][c] for m, s in zip(machines, now, strict=True))
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            following.append(states[to])
            readings.append(8 * (c == THREAT) + bits if c in (INSULT, THREAT) else -1)
        step.append(following)
        emit.append(readings)
    return step, emit


STEP, EMIT = compose([countdown(TARGET, 4), countdown(NEGATION, 3), until_end(REPORT)])
READINGS = 16


@dataclass(frozen=True)
class Settings:
    """``per_class`` bounds the labelled texts that are read, ``candidates`` and ``stems`` the lexicon."""

    per_class: int = 4000
    candidates: int = 3000
    stems: int = 500
    stem_lengths: tuple[int, ...] = (3, 4, 5, 6, 7, 8, 9, 10)
    min_log_odds: float = 3.0
    explained_by: int = 3


@dataclass(frozen=True)
class Grammar:
    """Insult stems by length with their weights; weights of readings; the rate without any match."""

    stems: dict[int, dict[bytes, float]] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0,) * (READINGS + 3)
    prior: float = 0.0
    fixed: dict[bytes, int] = field(default_factory=dict)

    def weight(self, word: bytes) -> float:
        return max((s.get(word[:n], 0.0) for n, s in self.stems.items() if len(word) >= n), default=0.0)

    def may_match(self, text: bytes) -> bool:
        words = set(text.translate(BLANKS).split())
        return any(not s.keys().isdisjoint([w[:n] for w in words]) for n, s in self.stems.items()) or any(
            k in words for k, c in self.fixed.items() if c == THREAT
        )

    def features(self, text: bytes) -> tuple[np.ndarray, int, int]:
        """Summed weights by reading, then clauses matched, strongest clause and a constant; matches; clauses."""
        found, matches, clauses, best = np.zeros(READINGS), 0, 0, 0.0
        text = text.lower()
        if self.may_match(text):
            state, clause = 0, 0.0
            for token in [*TOKEN.findall(text), b"."]:
                c, w = self.fixed.get(token, OTHER), 1.0
                if c == OTHER and len(token) > 2:
                    if w := self.weight(token):
                        c = INSULT
                elif len(token) == 1 and token in b".!?;:\n":
                    c = END
                if (reading := EMIT[state][c]) >= 0:
                    found[reading] += w
                    clause += w
                    matches += 1
                if c == END and clause:
                    clauses, best, clause = clauses + 1, max(best, clause), 0.0
                state = STEP[state][c]
        return np.concatenate([np.log1p(found), [np.log1p(clauses), best, 1.0]]), matches, clauses

    def score(self, features: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(features @ np.asarray(self.weights), -30, 30))))


def fixed_classes() -> dict[bytes, int]:
    lists = ((TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT))
    return {w.encode(): c for words, c in lists for w in words}


def stems_of(text: bytes, lengths: tuple[int, ...]) -> set[bytes]:
    words = set(text.lower().translate(BLANKS).split())
    return {w[:n] for w in words for n in lengths if len(w) >= n}


def pick_stems(counts: dict[bytes, tuple[int, int]], rows: list[list[bytes]], odds, settings: Settings) -> list[bytes]:
    """Stems by greedy cover: each pick explains the most toxic texts not yet explained often enough."""
    longer = {s[:-1] for s, (t, _) in counts.items() if s[:-1] in counts and t >= 0.9 * counts[s[:-1]][0]}
    pool = {s for s in counts if s not in longer}
    having: dict[bytes, list[int]] = {}
    for i, stems in enumerate(rows):
        for s in stems:
            if s in pool:
                having.setdefault(s, []).append(i)
    hits, chosen = np.zeros(len(rows), int), []
    least = max(3, 0.004 * len(rows))
    where = {s: np.array(v) for s, v in having.items()}
    while where and len(chosen) < settings.stems:
        gain, s = max(((int((hits[v] < settings.explained_by).sum()), odds(s), s) for s, v in where.items()))[::2]
        if gain < least:
            break
        hits[where[s]] += 1
        chosen.append(s)
        where = {x: v for x, v in where.items() if not x.startswith(s) and not s.startswith(x)}
    return chosen


def fit_readings(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the constant is moved from the sample's to the true share."""
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.5)
    ridge[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    share = y.mean()
    w[-1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return w


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, settings: Settings = Settings()  # noqa: B008
) -> Grammar:
    """Learn the grammar from labelled texts, leaving out ids with crc32 mod ``modulus`` = ``remainder``.

    What reaches the driver is bounded by ``settings``: candidate stems with two counts, the
    candidates of each sampled toxic text, and one short row of features per sampled text.
    """
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, modulus, remainder, settings.per_class)
    sizes = {r["label"]: r["count"] for r in sample.rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Grammar(prior=sample.prior, weights=(0.0,) * (READINGS + 2) + (_logit(sample.prior),))
    clean, toxic = sizes[0], sizes[1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, y in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                seen[y].update(stems_of(text, settings.stem_lengths))
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen[y]), pa.binary()), pa.array(seen[y].values(), pa.int64()), pa.array([y] * len(seen[y]), pa.int32())],
                names=["stem", "n", "label"],
            )

    per_stem = (
        sample.rows.select("text", "label")
        .mapInArrow(count, "stem binary, n long, label int")
        .groupBy("stem")
        .agg(
            F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("n"))), F.lit(0)).alias("t"),
            F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.lit(0)).alias("c"),
        )
    )
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    least = max(3, 0.004 * toxic)
    top = per_stem.where((F.col("t") >= least) & (odds >= settings.min_log_odds)).orderBy(F.desc("t"), "c", "stem")
    counts = {bytes(r["stem"]): (r["t"], r["c"]) for r in top.limit(settings.candidates).collect()}

    def weigh(s: bytes) -> float:
        t, c = counts[s]
        return float(np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1)))

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(stems_of(x, settings.stem_lengths) & counts.keys()) for x in as_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], names=["stems"])

    rows = sample.rows.where("label = 1").select("text").mapInArrow(having, "stems array<binary>").collect()
    chosen = pick_stems(counts, [[bytes(s) for s in r["stems"]] for r in rows], weigh, settings)
    stems: dict[int, dict[bytes, float]] = {}
    for s in chosen:
        stems.setdefault(len(s), {})[s] = weigh(s) / 4
    grammar = Grammar(stems=stems, prior=sample.prior, fixed=fixed_classes())

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [grammar.features(x)[0].tolist() for x in as_bytes(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), b.column(1)], names=["x", "label"])

    fitted = sample.rows.select("text", "label").mapInArrow(features, "x array<double>, label int").collect()
    x, y = np.array([r["x"] for r in fitted]), np.array([r["label"] for r in fitted], float)
    weights = fit_readings(x, y, min(max(sample.prior, 1e-6), 1 - 1e-6))
    return Grammar(stems, tuple(weights.tolist()), sample.prior, grammar.fixed)


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def toxicity(df: DataFrame, grammar: Grammar, text: str = "text", reject: float = 0.5) -> DataFrame:
    """``df`` with score, predicted (1 from ``reject`` on) and the numbers of matches and matched clauses."""

    def make():
        def compute(texts: list[bytes]):
            scores, matches, clauses = [], [], []
            for t in texts:
                x, m, c = grammar.features(t)
                scores.append(grammar.score(x))
                matches.append(m)
                clauses.append(c)
            return scores, [int(s >= reject) for s in scores], matches, clauses

        return compute

    return add_columns(df, COLUMNS, make, text)
