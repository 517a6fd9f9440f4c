"""Chat formatting with a black-box template, and where each turn ended up.

A template is any function from a list of turns to a text. It is rendered for successive prefixes
of a conversation; what consecutive outputs do not share is the new turn's span. If an output
changes anything up to the end of the previous turn's text, the template rewrites history, which is
reported together with the turn at which it does. Within a span the content is found by rendering the same
turn with two probe texts: what all three share at either end is the template's own.

Every prefix is rendered, whatever the template and the conversation's length, which costs the square of it.
Of a template given as ``PerTurn``, a function of one turn, each turn's part is made once in a conversation;
the prefixes are still put together and compared whole.

Rows are dealt by conversation and sorted by turn; a task takes one conversation at a time. A
conversation becomes one text, so it has to fit into a task. Control strings inside roles and texts
are escaped reversibly.

Defined results: NULL texts and roles are empty. Rows with equal turn numbers are taken in order of
role and text; repeated rows are repeated turns. NULL conversation ids form one conversation. Turns
without a number come first. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# Strings that chat templates use for control.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
END = "<|end|>\n"
PROBES = ("a?", "b!")


def escape(text: str) -> str:
    """Double backslashes, and put one inside every control string."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass(frozen=True)
class PerTurn:
    """A template that renders its turns one by one and puts them together."""

    one: Callable[[Turn], str]

    def __call__(self, turns: list[Turn]) -> str:
        return "".join(map(self.one, turns))


def tagged_turn(turn: Turn) -> str:
    role, text = turn
    return f"<|{escape(role)}|>\n{escape(text)}{END}"


#: The default template: a line with the role, the text, an end mark.
tagged = PerTurn(tagged_turn)


def parse_tagged(formatted: str) -> list[Turn]:
    """Turns back from the default template's output."""
    turns = []
    for part in formatted.split(END)[:-1]:
        role, _, text = part.removeprefix("<|").partition("|>\n")
        turns.append((unescape(role), unescape(text)))
    return turns


def shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    if b.startswith(a):
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def content_of(render: Template, before: list[Turn], turn: Turn, start: int, out: str, known: dict) -> tuple[int, int]:
    """Where the turn's text lies in ``out``, whose span for the turn begins at ``start``."""
    role, text = turn
    span = out[start:]
    head, tail = known.get(role, (None, None))
    if head is not None and span == head + escape(text) + tail:
        return start + len(head), len(out) - len(tail)
    one, two = (render([*before, (role, p)])[start:] for p in PROBES)
    first = shared(one, two)
    last = shared(one[::-1], two[::-1])
    known[role] = one[:first], one[len(one) - last :] if last else ""
    return start + first, len(out) - last


def exact_spans(render: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """Output, (start, end, content start, content end) by turn, and the first turn that rewrites history."""
    spans, prev, rewritten, known = [], render([]), None, {}
    for k in range(len(turns)):
        out = render(turns[: k + 1])
        start = shared(prev, out)
        if spans and start < spans[-1][3] and rewritten is None:
            rewritten = k
        if spans:  # a closing part that moved behind the new turn
            a, z, c, d = spans[-1]
            spans[-1] = a, min(z, max(start, a)), c, min(d, max(start, a))
        spans.append((start, len(out), *content_of(render, turns[:k], turns[k], start, out, known)))
        prev = out
    return prev, spans, rewritten


def turn_spans(render: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], int | None]:
    """``exact_spans``; the parts of a ``PerTurn`` template are kept for the next prefix."""
    if type(render) is PerTurn:  # a template derived from it may do more than put parts together
        render = PerTurn(cache(render.one))
    return exact_spans(render, turns)


def format_chats(rows: DataFrame, render: Template = tagged, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, roles, spans of turns, spans under the loss mask, rewritten_at.

    Spans are code point offsets, flat: start, end, start, end ... ``rewritten_at`` is the first turn that
    changed earlier ones, NULL for a template that only appends.
    """
    spark = rows.sparkSession
    pairs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            T.StructField("conv_id", rows.schema["conv_id"].dataType), T.StructField("formatted", T.StringType()),
            T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("turns", pairs),
            T.StructField("loss", pairs), T.StructField("rewritten_at", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(conv, turns: list[Turn]) -> pa.RecordBatch:
            out, spans, rewritten = turn_spans(render, turns)
            loss = [x for (role, _), s in zip(turns, spans, strict=True) if role in loss_roles for x in s[2:]]
            row = [conv, out, [r for r, _ in turns], [x for s in spans for x in s[:2]], loss, rewritten]
            types = [id_kind, pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=schema.names)

        now, turns, id_kind = None, [], None
        for b in batches:
            id_kind = b.schema.field(0).type
            for conv, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if turns and conv != now:
                    yield finish(now, turns)
                    turns = []
                now = conv
                turns.append((role or "", text or ""))
        if turns:
            yield finish(now, turns)

    role, text = F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        rows.select("conv_id", "turn", role, text)
        .repartition(parts, "conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return ordered.mapInArrow(run, schema)


def chat_digest(formatted: DataFrame, parse: Callable[[str], list[Turn]] = parse_tagged) -> DataFrame:
    """Read the output back: number of turns, hashes of turns and of the text under the loss mask, lengths."""
    schema = T.StructType(
        [
            formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for out, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(out)
                seen = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                under = unescape("".join(out[a:z] for a, z in zip(loss[::2], loss[1::2], strict=True)))
                rows.append((len(turns), seen, len(under), hashlib.sha256(under.encode()).hexdigest(), len(out)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip(columns, kinds, strict=True))], names=schema.names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, schema)
