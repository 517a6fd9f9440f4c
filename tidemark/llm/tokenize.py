"""Whole texts to ids with a ``tokenizers`` file, remembering pieces that recur."""

from __future__ import annotations

import json
import os
import re

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

# Unicode White_Space, as the byte-level pre-tokenizer's \\s has it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The byte-level pre-tokenizer never joins what these cuts separate: it takes a blank together with
# the word after it if that blank is a space, and blanks before the last by themselves. Nor does it join
# letters with the sign after them, so that a word is one piece with and without a comma.
CUT = re.compile(rf" ?[A-Za-z]+(?=[!-&(-/:-@])| ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")
# Blanks of more than one byte. Texts with these, or with the byte that ends a text below, are cut by ``CUT``.
WIDE_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
# Letters of one byte, or of two up to U+023F. Such a word is one piece for the pre-tokenizer too.
WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf])+")
SHORT = 16

_END, _SPACE, _BLANK, _LETTER, _DIGIT, _SIGN, _QUOTE, _OTHER = range(8)


def _kind(byte: int) -> int:
    c = chr(byte)
    if byte >= 0x80:
        return _OTHER
    if c.isalpha():
        return _LETTER
    return _DIGIT if c.isdigit() else _BLANK if c in "\t\n\v\f\r" else {"\0": _END, " ": _SPACE, "'": _QUOTE}.get(c, _SIGN)


def _begins(before: int, here: int) -> int:
    """Whether a piece begins between two kinds of bytes; 2: if the next byte is of a word."""
    if _END in (before, here):
        return 1
    if here in (_SPACE, _BLANK):
        return 2 if before in (_SPACE, _BLANK) else 1
    if before in (_SPACE, _BLANK):
        return int(before == _BLANK)
    # A quotation mark may take the letters after it: it only begins pieces.
    return int(here in {_LETTER: (_DIGIT, _SIGN, _QUOTE), _DIGIT: (_LETTER, _SIGN, _QUOTE), _SIGN: (_LETTER, _DIGIT)}.get(before, ()))


KINDS = bytes(map(_kind, range(256)))
BEGINS = bytes(_begins(i >> 3, i & 7) if i < 64 else 0 for i in range(256))
# Masks of the first and second eight bytes of a piece, by its size.
FIRST, SECOND = (np.array([(1 << 8 * min(max(n - skip, 0), 8)) - 1 for n in range(SHORT + 1)], np.uint64) for skip in (0, 8))


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in vocabularies of byte-level tokenizers."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def cut_bytes(whole: bytes) -> np.ndarray:
    """Where pieces begin in texts that each end with a zero byte; blanks must have one byte."""
    kinds = np.frombuffer(bytearray(whole.translate(KINDS)), np.uint8)
    if not whole.isascii():
        data = np.frombuffer(whole, np.uint8)
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC8))
        after = data[lead + 1]
        lead = lead[(data[lead] != 0xC3) | ((after != 0x97) & (after != 0xB7))]
        kinds[lead] = kinds[lead + 1] = _LETTER
    pairs = np.zeros(len(kinds), np.uint8)
    pairs[1:] = (kinds[:-1] << 3) | kinds[1:]
    begins = np.frombuffer(bytearray(pairs.tobytes().translate(BEGINS)), np.uint8)
    blanks = np.flatnonzero(begins == 2)
    begins[blanks] = kinds[blanks + 1] >= _LETTER
    return np.flatnonzero(begins)


class PieceTable:
    """Map from keys of 16 bytes, as two numbers, to numbers, asked and extended in whole arrays."""

    def __init__(self):
        self.n = 0
        self._room(12)

    def _room(self, bits: int) -> None:
        self.bits = bits
        self.first, self.second = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _home(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mixed = (first ^ (second * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).view(np.int64)

    def get(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Values, -1 where there is none."""
        at = self._home(first, second)
        values = self.values[at]
        left = np.flatnonzero((values >= 0) & ((self.first[at] != first) | (self.second[at] != second)))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            here = at[left]
            values[left] = self.values[here]
            left = left[(values[left] >= 0) & ((self.first[here] != first[left]) | (self.second[here] != second[left]))]
        return values

    def add(self, first: np.ndarray, second: np.ndarray, values: np.ndarray) -> None:
        """Take in keys that are not there yet, all different, with different values."""
        self.n += len(values)
        if 2 * self.n > 1 << self.bits:
            held = np.flatnonzero(self.values >= 0)
            first, second = np.concatenate([self.first[held], first]), np.concatenate([self.second[held], second])
            values = np.concatenate([self.values[held], values])
            self._room(int(2 * self.n).bit_length())
        at, left = self._home(first, second), np.arange(len(values))
        while len(left):
            free = left[self.values[at[left]] < 0]
            self.values[at[free]] = values[free]
            free = free[self.values[at[free]] == values[free]]
            self.first[at[free]], self.second[at[free]] = first[free], second[free]
            left = left[self.values[at[left]] != values[left]]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)


class TextEncoder:
    """``tokenizers`` with a memory of at most ``remember`` pieces.

    Byte-level tokenizers split texts into words before anything else, so a text's ids are those of
    its pieces in order, and only pieces not seen before reach the library. Any other tokenizer gets
    the whole texts. Strings of special tokens inside a text are ordinary text. Pieces of at most
    ``SHORT`` bytes are told apart by all their bytes in a table, longer ones in a dictionary.
    """

    def __init__(self, definition: str, end: int | None = None, remember: int = 1 << 20):
        # A task has one core; the library's own threads only cost time there.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        spec = json.loads(definition)
        self.library = Tokenizer.from_str(definition)
        self.library.encode_special_tokens = True
        before, model = spec.get("pre_tokenizer") or {}, spec["model"]
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer")
        # Words go to the library's model many at a time, with line ends between them. What they become is told
        # apart by its bytes, so each byte must have an id of its own.
        self.letters, self.words = byte_letters(), None
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        bare = model.get("type") == "BPE" and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        if self.cuts and bare and all(t["special"] for t in spec["added_tokens"]) and vocabulary.keys() >= set(self.letters.values()):
            self.words = Tokenizer(self.library.model)
            self.words.pre_tokenizer = CharDelimiterSplit(self.letters[10])
            self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.end, self.remember = [] if end is None else [end], remember
        self.table, self.known = PieceTable(), {}
        # Ids of pieces, and where each piece's begin, with room behind for more; the first ``count`` are remembered,
        # others are overwritten by the next. Number 0 is the end of a text.
        self.flat, self.edges, self.count = np.zeros(1 << 12, np.uint32), np.zeros(1 << 10, np.int64), 1
        self.flat[: len(self.end)], self.edges[1] = self.end, len(self.end)
        zero = np.zeros(1, np.uint64)
        self.table.add(zero, zero, np.zeros(1, np.int32))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _made(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The pieces in the order in which their ids come, all ids, and their numbers by piece."""
        is_word = [self.words is not None and WORD.fullmatch(p) is not None for p in pieces]
        words, rest = ([p for p, x in zip(pieces, is_word, strict=True) if x == kind] for kind in (True, False))
        ids, sizes = [], []
        for i in range(0, len(words), 1000):
            some = words[i : i + 1000]
            lines = b"\n".join(some).decode("latin-1").translate(self.letters)
            ids.append(np.array(self.words.encode_batch_fast([lines], add_special_tokens=False)[0].ids, np.uint32))
            last = np.searchsorted(np.cumsum(self.bytes_of[ids[-1]]), np.cumsum([len(w) for w in some]))
            sizes.append(np.diff(last, prepend=-1))
        found = self._ids([p.decode() for p in rest])
        ids += [np.array(x, np.uint32) for x in found]
        sizes.append(np.array([len(x) for x in found], np.int64))
        return words + rest, np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate(sizes)

    def _numbers(self, pieces: list[bytes], short: bool) -> list[int]:
        """Numbers of pieces that are not in the table, good until the next call; ``short``: the table may take new ones."""
        fresh = list(set(pieces).difference(self.known))
        if not fresh:
            return [self.known[p] for p in pieces]
        fresh, ids, sizes = self._made(fresh)
        first, used = self.count, int(self.edges[self.count])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(fresh) >= len(self.edges):
            self.edges = np.concatenate([self.edges, np.zeros_like(self.edges)])
        self.flat[used : used + len(ids)] = ids
        self.edges[first + 1 : first + 1 + len(fresh)] = used + np.cumsum(sizes)
        new = dict(zip(fresh, range(first, first + len(fresh)), strict=True))
        numbers = [new[p] if p in new else self.known[p] for p in pieces]
        if len(fresh) <= self.remember - self.count:
            self.count += len(fresh)
            tabled = [p for p in fresh if len(p) <= SHORT] if short else []
            if tabled:
                keys = np.frombuffer(b"".join(p.ljust(SHORT, b"\0") for p in tabled), "<u8").reshape(-1, 2)
                self.table.add(keys[:, 0].copy(), keys[:, 1].copy(), np.array([new.pop(p) for p in tabled], np.int32))
            self.known |= new
        return numbers

    def _plain(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers by text, of texts whose blanks have one byte."""
        whole = b"\0".join(texts) + b"\0"
        starts = cut_bytes(whole)
        size = np.diff(starts, append=len(whole))
        words = np.ndarray(len(whole) + 1, "<u8", whole + bytes(SHORT), strides=(1,))
        width = np.minimum(size, SHORT)
        first = words[starts] & FIRST[width]
        second = words[np.minimum(starts + 8, len(whole))] & SECOND[width]
        numbers = self.table.get(first, second).astype(np.int64)
        numbers[size > SHORT] = -1
        left = np.flatnonzero(numbers < 0)
        if len(left):
            a = starts[left]
            pieces = [whole[i:j] for i, j in zip(a.tolist(), (a + size[left]).tolist(), strict=True)]
            numbers[left] = self._numbers(pieces, True)
        return self._spread(numbers, np.flatnonzero(numbers == 0))

    def _odd(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        cuts = [[p.encode() for p in CUT.findall(t.decode())] for t in texts]
        numbers = self._numbers([p for c in cuts for p in c], False)
        last = np.cumsum([len(c) + 1 for c in cuts]) - 1
        whole = np.zeros(last[-1] + 1, np.int64)
        inner = np.ones(len(whole), bool)
        inner[last] = False
        whole[inner] = numbers
        return self._spread(whole, last)

    def _spread(self, numbers: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered pieces, and how many there are up to each of ``last`` from the one before."""
        begin = self.edges[numbers]
        n = self.edges[numbers + 1] - begin
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(begin - (upto - n), n) + np.arange(int(upto[-1]))]
        return ids, np.diff(upto[last], prepend=0)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, each with the end id, and their numbers by text."""
        return self.encode_utf8([t.encode() for t in texts])

    def encode_utf8(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, of texts as UTF-8; bytes that are not UTF-8 are replaced."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        whole = b"".join(texts)
        if not whole.isascii():
            try:
                whole.decode()
            except UnicodeDecodeError:
                texts = [t.decode("utf-8", "replace").encode() for t in texts]
        if not self.cuts:
            found = [ids + self.end for ids in self._ids([t.decode() for t in texts])]
            sizes = np.array([len(x) for x in found], np.int64)
            return np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum())), sizes
        odd = np.array([b"\0" in t or (not t.isascii() and WIDE_BLANK.search(t) is not None) for t in texts], bool)
        if not odd.any():
            return self._plain(texts)
        ids, sizes = self._odd([t for t, x in zip(texts, odd, strict=True) if x])
        if odd.all():
            return ids, sizes
        plain, n = self._plain([t for t, x in zip(texts, odd, strict=True) if not x])
        both = np.zeros(len(texts), np.int64)
        both[odd], both[~odd] = sizes, n
        where = np.repeat(odd, both)
        out = np.empty(len(where), np.uint32)
        out[where], out[~where] = ids, plain
        return out, both
