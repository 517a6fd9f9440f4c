"""Weights of very many features for tasks: a bounded table in memory, and a join for the rest.

A feature table grows with the corpus. The features of largest weight, at most ``limit`` of them,
go to every task as one open-addressing table; what a task does not find there it hands back as
rows, which are joined with the remaining features. Every feature is served one way or the other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.int64(-1)


class HashTable:
    """Read-only map from 64-bit keys to numbers, filled and asked in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = usable(keys)
        self.bits = max(4, int(2 * max(len(keys), 1) - 1).bit_length())
        self.keys = np.full(1 << self.bits, EMPTY)
        self.values = np.zeros(1 << self.bits, values.dtype)
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == EMPTY]
            self.keys[at[free]] = keys[free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
        self.values[self._find(keys)[0]] = values

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """What to broadcast: plain arrays, which executors unpack without this package."""
        return self.keys, self.values

    @classmethod
    def of(cls, arrays: tuple[np.ndarray, np.ndarray]) -> HashTable:
        self = cls.__new__(cls)
        self.keys, self.values = arrays
        self.bits = len(self.keys).bit_length() - 1
        return self

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MULTIPLIER) >> np.uint64(64 - self.bits)).view(np.int64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._home(keys)
        there = self.keys[at]
        found = there == keys
        left = np.flatnonzero(~found & (there != EMPTY))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            there = self.keys[at[left]]
            found[left] = there == keys[left]
            left = left[~found[left] & (there != EMPTY)]
        return at, found

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (anything where not found) and which keys were found."""
        at, found = self._find(usable(keys))
        return self.values[at], found


def usable(keys: np.ndarray) -> np.ndarray:
    """Keys as 64-bit integers; the one that marks a free slot is moved."""
    keys = np.ascontiguousarray(keys).view(np.int64)
    return np.where(keys == EMPTY, np.int64(-2), keys) if (keys == EMPTY).any() else keys


def hot_from(df: DataFrame, weight: str, limit: int) -> int:
    """Smallest power of two such that at most ``limit`` rows have ``weight`` + 1 from there on.

    Only a histogram of at most 64 rows reaches the driver.
    """
    bins = df.groupBy(F.floor(F.log2(F.col(weight) + 1)).cast("int").alias("bin")).count().collect()
    total, best = 0, 64
    for b, n in sorted(((r["bin"], r["count"]) for r in bins), reverse=True):
        total += n
        if total > limit:
            break
        best = b
    return 1 << min(best, 62)


def merge_counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with summed counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return (k[first], np.add.reduceat(n, first)) if len(k) else (k, n)
