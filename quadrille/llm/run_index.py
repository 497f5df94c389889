"""A run-length index of a repetitive text, and matching statistics streamed through it.

The text is a set of segments, each with an end that sorts before all bytes, and
ends in order of the segments. The index keeps the runs of the Burrows-Wheeler
transform (their bytes, first rows and where these lead), and for the suffix that
each run's first row leads to, the match with the suffix before it. That one is
reached from the end of the run before in the order of bytes, whose text position
is kept too (the sampled run ends). No suffix array stays.

Matching statistics are streamed from the ends of all segments to their starts at
once: inside a run the suffix one byte further left matches its predecessor one
byte longer and at the place one byte further left; at the first row of a run,
length and place come from the samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from quadrille.llm.kernel import U64, eights


def suffix_array(data: np.ndarray, seg_end: np.ndarray) -> np.ndarray:
    """Order of the positions by their bytes up to the end of their segment; ends sort first, in order of position."""
    n = len(data)
    if 0 < n < 65_000 and data.all():
        return _small(data, seg_end)
    # the eight bytes from each position; behind a segment's end come zeros
    left = seg_end - np.arange(n)
    key = np.zeros(n, U64)
    for j in range(8):
        byte = np.zeros(n, U64)
        byte[: max(0, n - j)] = data[j:]
        key = key << U64(8) | np.where(left > j, byte, U64(0))
    keys = (key,) if data.all() else (key, np.minimum(left, 8))  # a byte of zero looks like an end
    order = np.argsort(key) if len(keys) == 1 else np.lexsort(keys[::-1])
    reach = 8
    rank, found = _ranks(order, *keys)
    longest = int(left.max()) if n else 0
    # as many ranks as fit into 64 bits make one key, so a small text takes few rounds
    bits = (n + 1).bit_length()
    while reach < longest and found < n:
        key = rank.astype(U64)
        for k in range(1, 64 // bits):
            inside = np.flatnonzero(left > k * reach)
            key <<= U64(bits)
            key[inside] |= (rank[inside + k * reach] + 1).astype(U64)
        order = np.argsort(key)
        rank, found = _ranks(order, key)
        reach *= 64 // bits
    if found < n:  # suffixes that end alike: in order of position
        order = np.argsort(rank, kind="stable")
    return order


def _small(data: np.ndarray, seg_end: np.ndarray) -> np.ndarray:
    """The same for a text whose positions have 16 bits: 48 bits of key and the position are sorted as one number."""
    n = len(data)
    place, left = np.arange(n), seg_end - np.arange(n)
    key = (eights(data)[:n].byteswap() >> U64(16)) & ~((U64(1) << (U64(8) * (6 - np.minimum(left, 6)).astype(U64))) - U64(1))
    reach, longest = 6, int(left.max())
    while True:
        both = np.sort(key << U64(16) | place.astype(U64))
        order, key = (both & U64(0xFFFF)).astype(np.int64), both >> U64(16)
        new = np.append(True, key[1:] != key[:-1])
        if reach >= longest or new.all():
            return order
        first = np.flatnonzero(new)
        rank = np.empty(n, U64)
        rank[order] = np.repeat(first, np.diff(np.append(first, n))).astype(U64)
        key = rank << U64(32)
        for k in (1, 2):
            inside = np.flatnonzero(left > k * reach)
            key[inside] |= (rank[inside + k * reach] + U64(1)) << U64(32 - 16 * k)
        reach *= 3


def _ranks(order: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The class of each position (positions with equal keys are one, numbered by its first place), and how many there are."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(new)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, len(order))))
    return rank, len(first)


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix at each pair of positions, up to `most`, by comparing eight bytes at a time."""
    at, out = eights(data), np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        differ = at[np.minimum(a[live] + out[live], len(data))] ^ at[np.minimum(b[live] + out[live], len(data))]
        # equal bytes from the lowest on
        low = differ & (~differ + U64(1))
        same = np.where(differ == 0, 8, np.floor(np.log2(np.maximum(low, U64(1)).astype(np.float64))).astype(np.int64) >> 3)
        out[live] += same
        live = live[(same == 8) & (out[live] < most[live])]
    return np.minimum(out, most)


class RunIndex:
    """Of the segments of `data`, where seg_end is the end of each position's segment; matches count up to `length` bytes at run heads."""

    def __init__(self, data: np.ndarray, seg_end: np.ndarray, length: int):
        n = len(data)
        first = np.append(True, seg_end[1:] != seg_end[:-1])[:n]
        self.starts = np.flatnonzero(first)
        self.ends = seg_end[self.starts]
        s = len(self.starts)
        # rows: the ends of the segments, then the suffixes; what stands before each: a byte, or -1 - k at the start of segment k
        sa = np.concatenate([self.ends, suffix_array(data, seg_end)])
        before = np.empty(s + n, np.int64)
        before[:s] = data[self.ends - 1]
        at = sa[s:]
        before[s:] = np.where(first[at], -np.cumsum(first)[at], data[at - 1])
        # the runs and where their first rows lead
        self.run = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        self.byte = before[self.run]
        size = np.diff(np.append(self.run, s + n))
        real = np.flatnonzero(self.byte >= 0)
        by = real[np.argsort(self.byte[real], kind="stable")]
        self.leads = np.full(len(self.run), -1, np.int64)
        self.leads[by] = s + np.cumsum(size[by]) - size[by]
        # samples: the position at the end of the run before in the order of bytes, and the match of the two suffixes they lead to
        run_end = sa[np.append(self.run[1:], s + n) - 1]
        self.place, self.match = np.full(len(self.run), -1, np.int64), np.zeros(len(self.run), np.int64)
        self.place[by] = np.append(self.ends[-1:], run_end[by[:-1]] - 1)
        a, b = sa[self.run[by[1:]]] - 1, self.place[by[1:]]
        self.match[by[1:]] = common_prefix(data, a, b, np.minimum(np.minimum(seg_end[a] - a, seg_end[b] - b), length))
        self.rows = s + n

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Positions, their rows, and the length and place of the match with the suffix of the row before; from right to left."""
        lane = np.arange(len(self.starts))
        row, pos = lane.copy(), self.ends.copy()
        length, place = np.zeros(len(lane), np.int64), np.append(-1, self.ends)[:-1]
        while len(row):
            run = np.searchsorted(self.run, row, "right") - 1
            go = self.byte[run] >= 0
            if not go.all():
                row, pos, length, place, run = row[go], pos[go], length[go], place[go], run[go]
            head = row == self.run[run]
            row = self.leads[run] + row - self.run[run]
            pos = pos - 1
            length = np.where(head, self.match[run], length + 1)
            place = np.where(head, self.place[run], place - 1)
            yield pos, row, length, place


def classes(data: np.ndarray, seg_end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with `length` bytes left in their segment, and a number that is equal for those whose next `length` bytes are equal."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    index = RunIndex(data, seg_end, length)
    position, apart = np.full(index.rows, -1, np.int64), np.ones(index.rows, bool)
    for pos, row, match, _ in index.stream():
        position[row], apart[row] = pos, match < length
    number = np.cumsum(apart)
    rows = np.flatnonzero(position >= 0)
    at = position[rows]
    long = seg_end[at] - at >= length
    return at[long], number[rows[long]]
