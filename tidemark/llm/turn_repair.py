"""Repair of conversation structure: the cheapest edits after which roles read ``(s?(ua)+)?``.

Every row is judged by its first fault: blank (no visible character), duplicate (its role and text
were seen earlier in the conversation), truncated (the last visible character ends no sentence). The
edits: Keep (0), Rerole to user or assistant (1), Delete (2, the only choice for blank and duplicate
rows), Insert an empty turn (5); a truncated row that stays costs 5 more.

A grammar of alternating roles leaves one string per length (two where a system turn may lead), so
rows are aligned with every feasible length by Wagner-Fischer. Lengths are tried in order of a lower
bound that ignores roles; the cheapest alignment so far is the incumbent, and a cell is computed only
if its cost and the lower bound of what is left stay within it (Ukkonen's band; ties stay). Costs are
filled from the end, so that the trace takes the ASCII-least of the cheapest edits at every step;
the traces of the lengths that tie are compared. Audits of equal cost are never prefixes of each other.

Long conversations are cut into segments of ``SEGMENT`` rows. A segment is aligned from every state
of the grammar to every state, and the segments' tables are chained; this is exact, and keeps the
work in proportion to the number of rows.

Skew: rows of a conversation are streamed in order, never gathered. The first pass holds one code per
row and a digest per distinct turn; the second holds the audit and passes the rows' texts on one by
one. A conversation has one audit, so one task streams it.

Defined results: NULL role and text count as one space; NULL turns come first; rows of one turn are
taken in order of role and text; repeated rows are duplicates. NULL conversation ids form one
conversation. Columns besides conv_id, turn, role and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE, DELETE, EXTRA, INSERT = 1, 2, 5, 5
SEGMENT = 32
BLANK, DUPLICATE, TRUNCATED, SOUND = "blank", "duplicate", "truncated", "sound"
SPACES = " \t\n\v\f\r"

#: States of the grammar: nothing yet, after the system turn, after a user's, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)


@dataclass(frozen=True)
class Row:
    """What alignment needs to know of a row."""

    initial: str
    forced: bool = False
    truncated: bool = False


def fault_of(text: str, seen: bool) -> str:
    shown = text.rstrip(SPACES)
    if not shown:
        return BLANK
    if seen:
        return DUPLICATE
    return SOUND if shown[-1] in ".!?" else TRUNCATED


def target(state: int, length: int, led: bool) -> tuple[str, int]:
    """The role initials that ``length`` turns after ``state`` must have, and the state after them."""
    if not length:
        return "", state
    rest = length - led
    first = "au" if state == USER else "ua"
    turns = (first * (rest // 2 + 1))[:rest]
    return "s" * led + turns, SYSTEM if not turns else USER if turns[-1] == "u" else ASSISTANT


class Segment:
    """Consecutive rows, with what costs at least remain before and after each of them."""

    def __init__(self, rows: list[Row]):
        self.rows = rows
        ahead = [(0, 0, 0)]  # sound rows, truncated rows, forced deletions
        for r in reversed(rows):
            sound, short, gone = ahead[-1]
            ahead.append((sound + (not r.forced and not r.truncated), short + (not r.forced and r.truncated), gone + r.forced))
        self.after = ahead[::-1]
        total = self.after[0]
        self.before = [tuple(t - a for t, a in zip(total, x, strict=True)) for x in self.after]

    @staticmethod
    def least(counts: tuple[int, int, int], turns: int) -> int:
        """Least cost of turning rows of these counts into ``turns`` turns, whatever their roles."""
        sound, short, gone = counts
        if turns <= sound:
            return DELETE * (gone + short + sound - turns)
        if turns <= sound + short:
            return DELETE * (gone + sound + short - turns) + EXTRA * (turns - sound)
        return DELETE * gone + EXTRA * short + INSERT * (turns - sound - short)

    def align(self, wanted: str, most: float) -> tuple[int, str] | None:
        """Cheapest edits to ``wanted`` and their ASCII-least audit; None if they cost more than ``most``."""
        rows, m = self.rows, len(wanted)
        below: dict[int, int] = {}
        table: list[dict[int, int]] = [{}] * (len(rows) + 1)
        for i in range(len(rows), -1, -1):
            here: dict[int, int] = {}
            last = i == len(rows)
            row = None if last else rows[i]
            # j counts matched target turns; an insertion leads from j + 1 to j within a line.
            top = m if last else min(m, max(below, default=-1))
            low = m if last else max(0, min(below, default=0) - 1)
            counts = self.before[i]
            j = top
            while j >= 0:
                best = 0 if last and j == m else None
                if j + 1 in here:
                    best = here[j + 1] + INSERT
                if row is not None:
                    if j in below and (best is None or below[j] + DELETE < best):
                        best = below[j] + DELETE
                    if not row.forced and j + 1 in below:
                        cost = 0 if row.initial == wanted[j] else RULE if wanted[j] != "s" else None
                        if cost is not None:
                            cost += below[j + 1] + (EXTRA if row.truncated else 0)
                            if best is None or cost < best:
                                best = cost
                if best is not None and best + self.least(counts, j) <= most:
                    here[j] = best
                elif j < low:
                    break
                j -= 1
            if not here:
                return None
            table[i] = below = here
        if 0 not in table[0]:
            return None
        audit, i, j = [], 0, 0
        while i < len(rows) or j < m:
            now, row = table[i][j], rows[i] if i < len(rows) else None
            if row is not None and table[i + 1].get(j, now) + DELETE == now:
                audit.append("D")
                i += 1
            elif j < m and table[i].get(j + 1, now) + INSERT == now:
                audit.append("I")
                j += 1
            else:
                audit.append("K" if row.initial == wanted[j] else "R")
                i, j = i + 1, j + 1
        return table[0][0], "".join(audit)

    def aligned(self, state: int, finals: Iterable[int], joint: bool = False) -> dict[int, tuple[int, str]]:
        """Per state that can follow (``joint``: for the best of them): cost and audit of the cheapest edits."""
        found: dict[int, tuple[int, str]] = {}
        allowed = set(finals)
        reached = allowed & ({START, SYSTEM, USER, ASSISTANT} if state == START else {state, USER, ASSISTANT})
        # Two insertions in a row can be left out, but for the first pair; so no cheapest string is longer.
        lengths = sorted((self.least(self.after[0], n), n) for n in range(2 * len(self.rows) + 5))
        for least, length in lengths:
            if len(found) == (1 if joint else len(reached)) and all(least > cost for cost, _ in found.values()):
                break
            for led in (False, True) if state == START and length else (False,):
                wanted, end = target(state, length, led)
                slot = -1 if joint else end
                incumbent = found.get(slot)
                if end not in allowed or incumbent and least > incumbent[0]:
                    continue
                got = self.align(wanted, incumbent[0] if incumbent else float("inf"))
                if got and (not incumbent or got < incumbent):
                    found[slot] = got
        return found


def chain(table: dict[int, tuple[int, str]], segment: Segment, finals: Iterable[int], joint: bool = False) -> dict[int, tuple[int, str]]:
    """The table of what came before, extended by a segment's rows."""
    out: dict[int, tuple[int, str]] = {}
    for state, (cost, audit) in table.items():
        for end, (more, tail) in segment.aligned(state, finals, joint).items():
            got = (cost + more, audit + tail)
            if end not in out or got < out[end]:
                out[end] = got
    return out


def cheapest(rows: Iterable[Row], segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    a = Alignment(segment)
    for r in rows:
        a.add(r)
    return a.end()


class Alignment:
    """Rows of one conversation, taken one at a time."""

    def __init__(self, segment: int = SEGMENT):
        self.segment, self.open = segment, []
        self.table = {START: (0, "")}

    def add(self, row: Row) -> None:
        if len(self.open) >= self.segment:
            self.table = chain(self.table, Segment(self.open), range(4))
            self.open = []
        self.open.append(row)

    def end(self) -> tuple[int, str]:
        return chain(self.table, Segment(self.open), FINAL, joint=True)[-1]


@dataclass
class Tally:
    """What is counted along one conversation."""

    first: int | None = None
    last: int | None = None
    distinct: int = 0
    illegal: int = 0
    faults: dict[str, int] = field(default_factory=lambda: dict.fromkeys((BLANK, DUPLICATE, TRUNCATED, SOUND), 0))
    initial: str | None = None
    seen: set[bytes] = field(default_factory=set)
    alignment: Alignment = field(default_factory=Alignment)

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.distinct += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.initial = initial
        key = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode())
        fault = fault_of(text, key in self.seen)
        self.seen.add(key)
        self.faults[fault] += 1
        self.alignment.add(Row(initial, fault in (BLANK, DUPLICATE), fault == TRUNCATED))

    def values(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        cost, audit = self.alignment.end()
        return gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost, audit


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURN = "position long, edit string, role string, text string"
CHUNK_ROWS, CHUNK_CHARS = 4096, 1 << 22


def packed(rows: list[tuple], kinds: list[pa.DataType], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; NULL roles and texts are one space."""
    space = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *space)


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, counts of faults, illegal neighbours, cost and audit."""
    ordered = turns(rows).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([ordered.schema["conv_id"], *T.StructType.fromDDL(AUDIT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tally, out = None, None, []
        for b in batches:
            kinds = [b.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
            for i in range(0, b.num_rows, CHUNK_ROWS):
                for conv_id, turn, role, text in zip(*(c.to_pylist() for c in b.slice(i, CHUNK_ROWS).columns), strict=True):
                    if tally is None or conv_id != at:
                        if tally is not None:
                            out.append((at, *tally.values()))
                        at, tally = conv_id, Tally()
                    tally.add(turn, role, text)
                if len(out) >= CHUNK_ROWS:
                    yield packed(out, kinds, schema)
                    out = []
        if tally is not None:
            yield packed([*out, (at, *tally.values())], kinds, schema)

    return ordered.mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, position, edit, role, text: the turns that remain, reroled or inserted ones included.

    The rows of a conversation come one after the other, in order, in one partition.
    """
    source = turns(rows).withColumns({"audit": F.lit(None).cast("string"), "is_row": F.lit(1)})
    heads = audited.select("conv_id", "audit").withColumns({"is_row": F.lit(0), "turn": F.lit(None).cast("long")})
    both = source.unionByName(heads, allowMissingColumns=True).select("conv_id", "is_row", "turn", "role", "text", "audit")
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "text").drop("turn")
    schema = T.StructType([ordered.schema["conv_id"], *T.StructType.fromDDL(TURN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        at = audit = step = position = last = None

        def next_role() -> str:
            return "assistant" if last == "u" else "user"

        for b in batches:
            kinds = [b.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
            for i in range(0, b.num_rows, CHUNK_ROWS):
                for conv_id, is_row, role, text, given in zip(*(c.to_pylist() for c in b.slice(i, CHUNK_ROWS).columns), strict=True):
                    made = []
                    if not is_row:
                        at, audit, step, position, last = conv_id, given, 0, 0, None
                    else:
                        edit = audit[step]
                        step += 1
                        if edit != "D":
                            made.append((edit, role if edit == "K" else next_role(), text))
                            last = made[-1][1][:1]
                    while True:  # insertions stand before the row that follows them
                        for edit, name, words in made:
                            out.append((at, position, edit, name, words))
                            position, size = position + 1, size + len(words)
                        if step >= len(audit) or audit[step] != "I":
                            break
                        step += 1
                        made = [("I", next_role(), "")]
                        last = made[0][1][:1]
                    if len(out) >= CHUNK_ROWS or size >= CHUNK_CHARS:
                        yield packed(out, kinds, schema)
                        out, size = [], 0
        if out:
            yield packed(out, kinds, schema)

    return ordered.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with reproducible damage: dropped, emptied, without sentence ends, repeated, or given to the user."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return (
        turns(rows)
        .withColumn("kind", kind)
        .where("kind <> 0")
        .withColumns({"text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select("conv_id", "turn", "role", "text")
    )


def repaired_digest(repaired: DataFrame) -> DataFrame:
    """conv_id and the hash of its turns as ``role:text`` lines, taken as they stream by."""
    lines = repaired.select("conv_id", "position", F.concat_ws(":", "role", "text").alias("line"))
    schema = T.StructType([lines.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, out = None, None, []
        for b in batches:
            kinds = [b.schema.field(0).type, pa.string()]
            for i in range(0, b.num_rows, CHUNK_ROWS):
                for conv_id, position, line in zip(*(c.to_pylist() for c in b.slice(i, CHUNK_ROWS).columns), strict=True):
                    if not position:
                        if digest:
                            out.append((at, digest.hexdigest()))
                        at, digest = conv_id, hashlib.sha256()
                    digest.update((("\n" if position else "") + line).encode())
                if len(out) >= CHUNK_ROWS:
                    yield packed(out, kinds, schema)
                    out = []
        if digest:
            out.append((at, digest.hexdigest()))
            yield packed(out, kinds, schema)

    return lines.mapInArrow(run, schema)
