"""Array kernels over the text buffers of an Arrow batch: spans, hashes and rolling windows.

Everything here works on whole batches of UTF-8 bytes without creating one
Python object per word, so a pass over a corpus costs tens of nanoseconds a
byte. Batches are cut into slices of a few MB first, which bounds the memory of
a Python worker whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
import ctypes
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel call sees at once; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20

U64 = np.uint64
#: Arrays that Arrow frees go back to the machine at once.
pa.set_memory_pool(pa.system_memory_pool())
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Longer spans are hashed by BLAKE2b, one call each.
LONG_SPAN = 2048
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C13)
_Q = U64(0xC2B2AE3D27D4EB53)
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inv, self.n = base, U64(pow(int(base), -1, 1 << 64)), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            up, down = np.full(self.n, self.base, U64), np.full(self.n, self.inv, U64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_BYTES = _Powers(_P)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over the word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_class(members: bytes | range | list[int]) -> np.ndarray:
    """A 256-entry table that is True for the given byte values."""
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: ASCII white space: everything but it belongs to a word.
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: ASCII digits and lower-case letters and every non-ASCII byte (texts are lower-cased first).
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (starting at 0) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column holds at most `limit` bytes in each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    if _trim:  # freed memory goes back to the machine: workers live on between tasks
        _trim(0)


def spans(data: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of member bytes; runs end with their row."""
    inside = member[data]
    before = np.empty(len(data) + 1, bool)
    before[0], before[1:] = False, inside
    cut = off[1:-1]
    at_row = np.zeros(len(data) + 1, bool)
    at_row[cut] = True
    starts = np.flatnonzero(inside & (~before[:-1] | at_row[:-1]))
    after = np.empty(len(data) + 1, bool)
    after[:-1], after[-1] = inside, False
    ends = np.flatnonzero(inside & (~after[1:] | at_row[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """sums[i] is the polynomial sum of the first i bytes, from which a fingerprint of any span follows; equality is for others to verify."""
    up, _ = _BYTES.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[:-1], out=sums[1:])
    return sums


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number (a view; zeros behind the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans, eight bytes a round; they depend on content and seed alone, and seeds give independent hashes."""
    length = ends - starts
    at = eights(data)
    h = mix64(length.astype(U64) * _P + U64(seed * (int(_Q) + 1) % (1 << 64)))
    h = mix64((h ^ at[starts] & _TAIL[np.minimum(length, 8)]) * _Q + h)
    live = np.flatnonzero((length > 8) & (length <= LONG_SPAN))
    done = 8
    while len(live):
        left = length[live] - done
        word = at[starts[live] + done] & _TAIL[np.minimum(left, 8)]
        h[live] = mix64((h[live] ^ word) * _Q + h[live])
        done += 8
        live = live[left > 8]
    for i in np.flatnonzero(length > LONG_SPAN).tolist():
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def rolling(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of k consecutive words, and whether it stays in one row; word order counts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    out, at, piece, size = None, 0, hashes, 1
    while True:  # windows of 1, 2, 4, ... words, joined by the bits of k
        if k & size:
            mine = piece[at : at + n]
            out = mine if out is None else mix64(out * _P + mine)
            at += size
        if 2 * size > k:
            return mix64(out + U64(k)), rows[:n] == rows[k - 1 :]
        piece = mix64(piece[:-size] * _Q + piece[size:])
        size *= 2


def row_starts(rows: np.ndarray, n: int) -> np.ndarray:
    """For sorted row numbers: where the entries of each of n rows start, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def covered(starts: np.ndarray, lengths: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n cells lie in any of the runs that begin at `starts`."""
    mark = np.zeros(n + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.subtract.at(mark, np.minimum(starts + lengths, n), 1)
    return np.cumsum(mark[:-1]) > 0


def runs(flags: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of set cells within one row."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(flags), bool)
    new[1:] = (rows[1:] != rows[:-1]) | ~flags[:-1]
    starts = np.flatnonzero(flags & new)
    last = np.ones(len(flags), bool)
    last[:-1] = (rows[1:] != rows[:-1]) | ~flags[1:]
    return starts, np.flatnonzero(flags & last) + 1


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0] + 1, ... of each run, one after the other."""
    total = int(lengths.sum())
    out = np.arange(total, dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    return out + np.repeat(starts - begins, lengths)
