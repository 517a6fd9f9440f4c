"""Adaptive context-mixing range coder for arrays of token ids.

A block is coded by itself, from empty statistics, so damage stays in it and blocks can be read in
any order. Its ids are dealt to lanes, stretches of equal length that advance together and share the
statistics, which lets numpy code one id of every lane at a time. Each id is predicted from the id
last seen after the two preceding ids (order 2) and after the preceding id (order 1); how much
weight either prediction gets against the id frequencies (order 0) is learned for each pair of
confidences. A lane's range coder narrows its interval once an id: by the prediction used and, where
neither holds, by the order-0 frequency within it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

HEADER = "<4sIIIII"  # magic, ids, lanes, vocabulary, crc32 of the ids, words
HEADER_SIZE = struct.calcsize(HEADER)
MAGIC = b"CMR3"
MAX_LANES = 4096
SLOT_BITS, ID_BITS, CODE_BITS = 12, 20, 32
CONTEXTS = 1 << 18
CLASSES = 32
#: Steps between updates of the slots' weights and of the order-0 intervals, once there were that many.
WEIGH_STEPS, RANK_STEPS = 8, 64
LOW32 = np.uint64(0xFFFFFFFF)
WORD, TWO32 = np.uint64(32), np.uint64(1 << 32)
EMPTY = -16  # a cell without an id: -1, which no id equals, and no confidence

_sure = np.arange(16)
# What a cell's confidence gains, by confidence (and 16 more if the id was right).
GAIN = np.concatenate([(_sure >> 1) - _sure, (_sure < 15).astype(np.int64)]).astype(np.int32)
# Four times the class of two cells, by the order-2 cell's confidence, the order-1 cell's, and whether they agree.
KIND = (np.arange(2)[:, None, None] * 16 + np.minimum(_sure, 3)[None, :, None] * 4 + np.minimum(_sure, 3)).ravel() * 4
# The slot by whether the order-2 id is right and whether the order-1 id is.
SLOT = np.array([2, 1, 0, 0])


class DamagedBlock(ValueError):
    pass


class Statistics:
    """What a block's lanes have learned so far; encoder and decoder go through the same states."""

    def __init__(self, lanes: int, vocabulary: int):
        self.vocabulary = vocabulary
        self.id_bits = id_bits(vocabulary)
        self.slot_bits = min(SLOT_BITS, CODE_BITS - self.id_bits)
        # Each cell: an id and, in the low four bits, the confidence in it.
        self.last, self.pair = np.full(vocabulary, EMPTY, np.int32), np.full(CONTEXTS, EMPTY, np.int32)
        self.p1, self.p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.slots = np.ones((CLASSES, 3), np.int64) * [[8, 8, 16]]
        self.counts, self.steps = np.zeros(vocabulary, np.int64), 0
        self.intervals, self.plain, self.ids_at = [], [], None
        self._weigh()
        self._rank()

    def _weigh(self) -> None:
        """Intervals of the three slots, by class of confidences; four numbers a class."""
        total = 1 << self.slot_bits
        size = np.zeros((CLASSES, 4), np.int64)
        size[:, :3] = 1 + self.slots * (total - 3) // self.slots.sum(1, keepdims=True)
        size[:, 2] = total - size[:, 0] - size[:, 1]
        self.slot_size = size.ravel()
        self.slot_from = (np.cumsum(size, axis=1) - size).ravel()

    def _rank(self) -> None:
        """Intervals of all ids by their order-0 counts; the last interval is the whole, for no id."""
        whole = 1 << self.id_bits
        size = np.empty(self.vocabulary + 1, np.int64)
        size[:-1] = 1 + self.counts * (whole - self.vocabulary) // max(int(self.counts.sum()), 1)
        size[-2] += whole - int(size[:-1].sum())
        self.id_from = np.cumsum(size) - size
        self.id_from[-1], size[-1] = 0, whole
        self.id_size, self.ids_at = size, None

    def id_at(self, values: np.ndarray) -> np.ndarray:
        """The ids whose order-0 intervals hold ``values``."""
        if self.ids_at is None:
            self.ids_at = np.repeat(np.arange(self.vocabulary, dtype=np.int32), self.id_size[:-1])
        return self.ids_at.take(values)

    def predict(self) -> np.ndarray:
        """Look up both predictions; four times the class of confidences of each lane."""
        self.at2 = (self.p2 * 40503 + self.p1 * 2654435761 >> 7) & (CONTEXTS - 1)
        self.cell2, self.cell1 = self.pair.take(self.at2), self.last.take(self.p1)
        self.guess2, self.guess1 = self.cell2 >> 4, self.cell1 >> 4
        self.sure2, self.sure1 = self.cell2 & 15, self.cell1 & 15
        kind = (self.sure2 << 4) + self.sure1 + ((self.guess1 == self.guess2) * np.int32(256))
        return KIND.take(kind.astype(np.int64))

    def learn(self, ids: np.ndarray, interval: np.ndarray, plain: np.ndarray) -> None:
        """Take in one id per lane.

        ``interval``: the number of the slot's interval; ``plain``: the id if it was coded by order 0, else the vocabulary's size.
        """
        ids32 = ids.astype(np.int32)
        new = (ids32 << 4) | 1
        for cell, sure, guess, table, at in (
            (self.cell2, self.sure2, self.guess2, self.pair, self.at2),
            (self.cell1, self.sure1, self.guess1, self.last, self.p1),
        ):
            known = sure + (ids32 == guess) * np.int32(16)
            table[at] = np.where(known <= 1, new, cell + GAIN.take(known.astype(np.int64)))
        self.p2, self.p1 = self.p1, ids
        self.intervals.append(interval)
        self.plain.append(plain)
        self.steps += 1
        early = self.steps in (1, 4, 16)
        if self.steps % WEIGH_STEPS == 0 or early:
            self.slots += np.bincount(np.concatenate(self.intervals), minlength=CLASSES * 4).reshape(CLASSES, 4)[:, :3]
            full = self.slots.sum(1) > 1 << 16
            self.slots[full] = (self.slots[full] >> 1) + 1
            self.intervals = []
            self._weigh()
        if self.steps % RANK_STEPS == 0 or early:
            self.counts += np.bincount(np.concatenate(self.plain), minlength=self.vocabulary + 1)[:-1]
            self.plain = []
            self._rank()


def id_bits(vocabulary: int) -> int:
    """Bits of an order-0 interval; enough for every id to have one and for counts to tell them apart."""
    bits = max(ID_BITS, vocabulary.bit_length() + 3)
    if bits > CODE_BITS - 4:
        raise ValueError(f"a vocabulary of {vocabulary} ids is too large")
    return bits


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(MAX_LANES, n // 128))
    return lanes, -(-n // lanes)


class Ranges:
    """The lanes' intervals. A code of ``CODE_BITS`` holds the slot and, within it, the order-0 id."""

    def __init__(self, lanes: int, stats: Statistics):
        self.stats = stats
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.bits = np.uint64(stats.slot_bits + stats.id_bits)

    def narrow(self, interval: np.ndarray, plain: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take the interval of a slot and an id, in units of the span; the lanes that are due for a word, and these words."""
        stats, low, span = self.stats, self.low, self.span
        width = stats.slot_size.take(interval)
        start = (stats.slot_from.take(interval) << stats.id_bits) + width * stats.id_from.take(plain)
        width *= stats.id_size.take(plain)
        low += unit * start.view(np.uint64)
        np.multiply(unit, width.view(np.uint64), out=span)
        due = np.flatnonzero(span < TWO32)
        d_low, d_span = low.take(due), span.take(due)
        crosses = ((d_low ^ (d_low + d_span)) >> WORD) != 0
        d_span = np.where(crosses, (~d_low + np.uint64(1)) & LOW32, d_span)
        low[due], span[due] = d_low << WORD, d_span << WORD
        return due, d_low >> WORD


def encode_block(ids: np.ndarray, vocabulary: int) -> bytes:
    n = len(ids)
    check = zlib.crc32(ids.astype("<u4").tobytes())
    lanes, steps = _shape(n)
    grid = np.zeros(lanes * steps, np.int64)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    stats = Statistics(lanes, vocabulary)
    ranges = Ranges(lanes, stats)
    words, room = np.zeros(lanes, np.int64), steps + 1
    out = np.zeros((lanes, room), np.uint32)
    for ids_now in grid:
        kind = stats.predict()
        slots = SLOT.take((ids_now == stats.guess2) * np.int64(2) + (ids_now == stats.guess1))
        interval, plain = kind + slots, np.where(slots == 2, ids_now, vocabulary)
        due, word = ranges.narrow(interval, plain, ranges.span >> ranges.bits)
        at = words.take(due)
        out[due, at] = word
        words[due] = at + 1
        stats.learn(ids_now, interval, plain)
    # One more word places the code inside the interval.
    out[np.arange(lanes), words] = ((ranges.low >> WORD) + ((ranges.low & LOW32) != 0)).astype(np.uint32)
    words += 1
    payload = out[np.arange(room) < words[:, None]]
    head = struct.pack(HEADER, MAGIC, n, lanes, vocabulary, check, len(payload))
    return head + words.astype("<u4").tobytes() + payload.astype("<u4").tobytes()


def decode_block(data: bytes, offset: int = 0) -> tuple[np.ndarray, int]:
    """Ids of the block at ``offset`` and where the next one begins; raises if the block is damaged."""
    if len(data) < offset + HEADER_SIZE:
        raise DamagedBlock("truncated header")
    magic, n, lanes, vocabulary, check, total = struct.unpack_from(HEADER, data, offset)
    offset += HEADER_SIZE
    end = offset + 4 * (lanes + total)
    if magic != MAGIC or end > len(data) or lanes != _shape(n)[0]:
        raise DamagedBlock("bad header or truncated block")
    words = np.frombuffer(data, "<u4", lanes, offset).astype(np.int64)
    if int(words.sum()) != total:
        raise DamagedBlock("bad lane lengths")
    steps = _shape(n)[1]
    # A lane reads one word past its own, which counts as zero.
    stream = np.zeros(total + lanes + 1, np.uint64)
    stream[np.arange(total) + np.repeat(np.arange(lanes), words)] = np.frombuffer(data, "<u4", total, offset + 4 * lanes)
    at_word = np.cumsum(words + 1) - words - 1
    stats = Statistics(lanes, vocabulary)
    ranges = Ranges(lanes, stats)
    code = (stream[at_word] << WORD) | stream.take(at_word + 1, mode="clip")
    at_word += 2
    highest = np.uint64((1 << int(ranges.bits)) - 1)
    grid = np.zeros((steps, lanes), np.int64)
    for row in grid:
        kind = stats.predict()
        unit = ranges.span >> ranges.bits
        value = np.minimum((code - ranges.low) // unit, highest).view(np.int64)
        at = value >> stats.id_bits
        slots = (at >= stats.slot_from.take(kind + 1)).astype(np.int64) + (at >= stats.slot_from.take(kind + 2))
        interval = kind + slots
        value -= stats.slot_from.take(interval) << stats.id_bits
        # Exact: below 2^32 by at most 2^12.
        found = stats.id_at((value / stats.slot_size.take(interval)).astype(np.int64))
        plainly = slots == 2
        row[:] = np.where(plainly, found, np.where(slots == 1, stats.guess1, stats.guess2))
        plain = np.where(plainly, found, vocabulary).astype(np.int64)
        due, _ = ranges.narrow(interval, plain, unit)
        at = at_word.take(due)
        code[due] = (code.take(due) << WORD) | stream.take(at, mode="clip")
        at_word[due] = at + 1
        stats.learn(row, interval, plain)
    ids = grid.T.ravel()[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise DamagedBlock("checksum differs")
    return ids, end
