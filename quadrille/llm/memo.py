"""A hash table from 64-bit keys to row numbers whose lookups work on whole arrays."""

from __future__ import annotations

import numpy as np


class KeyTable:
    """Open addressing with linear probing; rows are numbered in the order of insertion."""

    def __init__(self, slots: int = 1 << 16):
        self.n = 0
        self._make(slots)

    def _make(self, slots: int) -> None:
        self.keys, self.rows = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self.mask = slots - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            row = self.rows[slot]
            same = (row >= 0) & (self.keys[slot] == keys[todo])
            out[todo[same]] = row[same]
            go = (row >= 0) & ~same
            todo, slot = todo[go], (slot[go] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Insert distinct keys that are not in the table; their rows."""
        while 2 * (self.n + len(keys)) > len(self.rows):
            held = self.rows >= 0
            old_keys, old_rows = self.keys[held], self.rows[held]
            self._make(2 * len(self.rows))
            self._place(old_keys, old_rows)
        rows = np.arange(self.n, self.n + len(keys))
        self._place(keys, rows)
        self.n += len(keys)
        return rows

    def _place(self, keys: np.ndarray, rows: np.ndarray) -> None:
        todo, slot = np.arange(len(keys)), (keys & np.uint64(self.mask)).astype(np.int64)
        while len(todo):
            free = self.rows[slot] < 0
            mine = np.flatnonzero(free)
            _, first = np.unique(slot[mine], return_index=True)  # one key for a free slot
            won = mine[first]
            self.keys[slot[won]], self.rows[slot[won]] = keys[todo[won]], rows[todo[won]]
            go = np.ones(len(todo), bool)
            go[won] = False
            step = (~free)[go].astype(np.int64)  # those that lost a free slot look at it again
            todo, slot = todo[go], (slot[go] + step) & self.mask


class Rows:
    """A growing array."""

    def __init__(self, kind: type, size: int = 1 << 14, width: int | None = None):
        self.n, self.data = 0, np.zeros(size if width is None else (size, width), kind)

    def extend(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)
