"""Turn repair, repeated passages and hard negatives against plain versions, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, isfinite

import pytest
from pyspark.sql import functions as F

from tests.llm.samples import no_documents, odd_documents, prose
from tidemark.llm import catalog
from tidemark.llm.hard_negatives import Settings as MiningSettings
from tidemark.llm.hard_negatives import hard_negatives, visited_cells
from tidemark.llm.repeated_passages import Settings as PassageSettings
from tidemark.llm.repeated_passages import repeats_among, without_repeats
from tidemark.llm.turn_repair import Row, audits, cheapest, damaged, repaired_digest, repaired_turns, turns

SF = "/root/testdata/sf0.001"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def by_states(rows: list[Row]) -> tuple[int, str]:
    """Cheapest edits and least audit, state by state of the grammar; insertions come at most in pairs."""

    def put(table, state, got):
        table[state] = min(table.get(state, got), got)

    def inserted(table):
        for _ in range(2):
            more = dict(table)
            for state, (cost, audit) in table.items():
                put(more, NEXT[state], (cost + 5, audit + "I"))
            table = more
        return table

    table = {"": (0, "")}
    for r in rows:
        new = {}
        for state, (cost, audit) in inserted(table).items():
            put(new, state, (cost + 2, audit + "D"))
            if r.forced:
                continue
            cost += 5 * r.truncated
            if r.initial == NEXT[state]:
                put(new, r.initial, (cost, audit + "K"))
            put(new, NEXT[state], (cost + 1, audit + "R"))
            if not state and r.initial == "s":
                put(new, "s", (cost, audit + "K"))
        table = new
    table = inserted(table)
    return min(v for k, v in table.items() if k in ("", "a"))


def test_alignment_is_cheapest_and_ascii_least():
    rng = random.Random(5)
    for _ in range(1500):
        rows = [Row(rng.choice("uuaasx"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(0, 9))]
        want = by_states(rows)
        assert {cheapest(rows, segment) for segment in (1, 2, 3, 100)} == {want}
    rows = [Row(rng.choice("ua"), rng.random() < 0.1, rng.random() < 0.1) for _ in range(150)]
    assert cheapest(rows) == cheapest(rows, 1000) == by_states(rows)


@pytest.mark.parametrize(
    ("roles", "cost", "audit"),
    [("", 0, ""), ("ua", 0, "KK"), ("sua", 0, "KKK"), ("uu", 1, "KR"), ("u", 2, "D"), ("s", 2, "D"), ("au", 2, "RR"), ("uaua", 0, "KKKK"),
     ("sa", 1, "RK"), ("uasua", 2, "KKDKK")],
)
def test_small_audits(roles, cost, audit):
    rows = [Row(r) for r in roles]
    assert cheapest(rows) == by_states(rows) == (cost, audit)


def plain_repair(rows):
    """conv_id -> all columns of the query, from (conv_id, turn, role, text)."""
    after, ids = defaultdict(list), {r[0] for r in rows}
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        after[conv] += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv in ids:
        seen, codes, faults = set(), [], Counter()
        items = sorted(after[conv], key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        for _, role, text in items:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            codes.append(Row(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = by_states(codes)
        numbers = [t for t, _, _ in items if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(items, items[1:], strict=False))
        lines, state, left = [], "", iter(items)
        for edit in audit:
            role, text = ("", "") if edit == "I" else next(left)[1:]
            if edit != "D":
                if edit != "K":
                    role = {"u": "user", "a": "assistant"}[NEXT[state]]
                state = role[:1]
                lines.append(f"{role}:{text}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest)
    return out


def odd_turns():
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Hi.", "Yes!", "no", "", " \t", None, "Is it?\n"]))
            for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(None, None, "user", "a."), (None, 2, "assistant", "b."), (None, 2, None, None), (7, 3, "user", "Hi."), (7, 3, "user", "Hi.")]
    rows += [(100, t, "ua"[t % 2] if t % 50 else "system", f"turn {t}.") for t in range(150)]
    return rows + [(101, t * 3, "user" if t % 2 else "assistant", f"x{t}" + "." * (t % 3)) for t in range(40)]


def test_repair_query(spark, tmp_path):
    frame = spark.createDataFrame([(*r, 1, "x") for r in odd_turns()], "conv_id long, turn long, role string, text string, audit int, edit string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = catalog.op11_turn_repair(spark, str(tmp_path)).collect()
    got = {r["conv_id"]: tuple(r[n] for n in names) for r in rows}
    assert len(got) == len(rows) and got == plain_repair(odd_turns())


def test_repair_of_test_table(spark):
    rows = [tuple(r) for r in turns(spark.read.parquet(f"{SF}/conversations.parquet")).collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in catalog.op11_turn_repair(spark, SF).collect()}
    assert got == plain_repair(rows)


def test_repaired_turns_follow_the_grammar(spark):
    frame = damaged(spark.createDataFrame(odd_turns(), "conv_id long, turn long, role string, text string"))
    roles = defaultdict(str)
    for r in sorted(repaired_turns(frame, audits(frame)).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["position"])):
        roles[r["conv_id"]] += r["role"][:1]
    assert roles and all(re.fullmatch("s?(ua)+", x) for x in roles.values())
    empty = frame.limit(0)
    assert audits(empty).count() == 0 and repaired_digest(repaired_turns(empty, audits(empty))).count() == 0


def plain_removal(texts, window):
    split = [(t or "").encode().split() for t in texts]
    places = defaultdict(list)
    for d, words in enumerate(split):
        for i in range(len(words) - window + 1):
            places[tuple(words[i : i + window])].append((d, i))
    gone = {(d, i + k) for at in places.values() if len(at) > 1 for d, i in at for k in range(window)}
    return [(len(w), sum((d, i) in gone for i in range(len(w))), b" ".join(x for i, x in enumerate(w) if (d, i) not in gone).decode()) for d, w in enumerate(split)]


def passages():
    shared, other = prose(1, 60), prose(2, 50)
    texts = [f"{prose(10 + i, 5 + i % 7)} {shared} {prose(40 + i, 9)}" for i in range(25)]
    texts += [other, other, f"{other} {other}", "a " * 200, None, "", " \n\t ", prose(3, 400), prose(3, 400), prose(4, 30), prose(4, 30)]
    return texts + [f"{prose(5, 300)}\n{prose(6, 40)}\v{prose(5, 300)}", "é ü " * 40, "\x1c ".join(prose(7, 90).split())]


@pytest.mark.parametrize(
    "settings",
    [
        PassageSettings(), PassageSettings(bucket_rows=1, levels=1), PassageSettings(bucket_rows=2, levels=0),
        PassageSettings(window=8, seed=3, block=64, remembered=2, sort_rows=16), PassageSettings(window=5, seed=1, bucket_rows=4, levels=2),
    ],
)
def test_repeats(spark, settings):
    texts = passages()
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "doc_id long, text string, n_words int").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in without_repeats(docs, settings).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, settings.window)


def test_equal_hashes_are_compared_word_by_word(monkeypatch):
    from tidemark.llm import repeated_passages as r
    from numpy import array, uint64, zeros

    strings = [b"a b c d", b"x b c d", b"b c d e"]
    monkeypatch.setattr(r.RollingHash, "of", lambda self, sums, start, end: zeros(len(start), uint64))
    assert repeats_among(strings, array([1, 1, 1]), PassageSettings(window=3, seed=1)).tolist() == [2, 2, 1]


def test_repeats_of_odd_documents(spark):
    odd = odd_documents(spark)
    rows = odd.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, plain_removal([r["text"] for r in rows], 35), strict=True))
    out = without_repeats(odd)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()) == want
    assert "score" in out.columns and without_repeats(no_documents(spark)).count() == 0


def plain_negatives(rows, s: MiningSettings):
    kept = []
    for vec_id, vector, label in rows:
        if vector is not None and label is not None and all(x is not None and isfinite(x) for x in vector):
            kept.append((vec_id, label, [floor(s.scale * x) for x in vector]))

    def order(x):
        return -x[0], x[1] is None, x[1] or 0, x[2]

    out = Counter()
    for a, (anchor, label, v) in enumerate(kept):
        if anchor is None or anchor % 10:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w, strict=False)), i, r) for r, (i, _, w) in enumerate(kept) if r != a), key=order)
        for p, positive, _ in [x for x in scored if kept[x[2]][1] == label][: s.positives]:
            fit = [x for x in scored if kept[x[2]][1] != label and s.low * p <= 100 * x[0] <= s.high * p][: s.negatives]
            out.update((anchor, positive, k + 1, x[1], p, x[0]) for k, x in enumerate(fit))
    return out


@pytest.mark.parametrize("settings", [MiningSettings(), MiningSettings(codewords=3, seed_rows=5, list_rows=4, group_rows=2, positives=3, negatives=4)])
def test_hard_negatives(spark, settings):
    rng = random.Random(3)
    centers = [[rng.gauss(0, 0.6) for _ in range(6)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centers)], rng.randrange(4)) for i in range(300)]
    rows += [(400 + i, rows[20][1], 1) for i in range(15)] + [(1000 + 10 * i, rows[20][1], i % 2) for i in range(8)]
    rows += [rows[30], rows[30], (None, rows[31][1], 2), (None, rows[31][1], 2), (2000, None, 1), (2010, [], 1), (2020, [0.5, 0.25], 0)]
    rows += [(2030, [0.1, None], 1), (2040, [float("nan")] * 6, 1), (2050, [float("inf")] * 6, 1), (2060, rows[1][1], None)]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, node string, score double")
    got = hard_negatives(frame.repartition(4), F.col("vec_id") % 10 == 0, settings)
    assert Counter(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == plain_negatives(rows, settings)
    assert hard_negatives(frame.limit(0), F.col("vec_id") % 10 == 0, settings).count() == 0
    with pytest.raises(Exception, match="exact scores"):
        hard_negatives(spark.createDataFrame([(0, [1e9], 1)], "vec_id long, embedding array<double>, label int"), F.lit(True)).count()


def test_cells_are_visited_by_falling_bound():
    from numpy import array, inf

    one, two = array([3.0, 9.0, 5.0]), array([1.0, 4.0, -inf])
    sizes = array([1, 2, 0, 3, 4, 0, 0, 5, 0])
    assert visited_cells((one, two), sizes, -1e9, inf) == [4, 3, 7, 1, 0]
    assert visited_cells((one, two), sizes, 9.5, inf) == [4, 3] and visited_cells((one, two), sizes, -1e9, 5) == [4, 3]
