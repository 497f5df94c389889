"""Bounded-space online packing of token sequences into windows.

A task holds at most `open_windows` partly filled windows. A document's ids go
to the open window that they fill best; if none has room, a new window opens, or
when all are open the fullest one is emitted, topped up with the head of the
document unless its gap is under `min_cut` ids. At the end a task joins its
leftovers into full windows and at most one partial one, and the partial ones of
all tasks are joined the same way in rounds of `fan_in` until one is left.

Defined results: a null text is an empty one and gives a single piece that holds
the end id; every row is packed, repeated ids included; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.kernel import buffers, slices
from quadrille.llm.tokens import encoder, with_end
from quadrille.llm.workspace import Workspace

WINDOW = 2048
OPEN_WINDOWS = 64
MIN_CUT = 16
FAN_IN = 256
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, part int, left boolean, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("start", "length", "doc_tokens", "sequence_id", "offset")), ("part", pa.int32()), ("left", pa.bool_()), ("ids", pa.binary())])

#: A piece: doc_id, start, doc_tokens, ids.
Piece = tuple[int | None, int, int, np.ndarray]


class Packer:
    """The packing state of one task; `add` and `finish` yield whole windows as lists of pieces."""

    def __init__(self, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT):
        self.window, self.most, self.min_cut = window, open_windows, min_cut
        self.gaps: list[tuple[int, int]] = []  # (room left, number), in order
        self.held: dict[int, list[Piece]] = {}
        self.n = 0

    def _put(self, number: int, gap: int, piece: Piece) -> Iterator[list[Piece]]:
        self.held[number].append(piece)
        gap -= len(piece[3])
        if gap:
            insort(self.gaps, (gap, number))
        else:
            yield self.held.pop(number)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        doc, start, total, ids = piece
        while len(ids) >= self.window:
            yield [(doc, start, total, ids[: self.window])]
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            at = bisect_left(self.gaps, (len(ids), -1))
            if at < len(self.gaps):  # the smallest room that holds it
                gap, number = self.gaps.pop(at)
                yield from self._put(number, gap, (doc, start, total, ids))
                return
            if len(self.gaps) >= self.most:
                gap, number = self.gaps.pop(0)  # the fullest goes
                window = self.held.pop(number)
                if gap >= self.min_cut:
                    window.append((doc, start, total, ids[:gap]))
                    start, ids = start + gap, ids[gap:]
                yield window
                continue
            self.n += 1
            self.held[self.n] = []
            yield from self._put(self.n, self.window, (doc, start, total, ids))
            return

    def finish(self) -> tuple[list[list[Piece]], list[Piece]]:
        """The leftovers, fullest first and cut freely: full windows, and what fills none."""
        left = [p for _, number in self.gaps for p in self.held[number]]
        self.gaps, self.held = [], {}
        return joined(left, self.window)


def joined(pieces: list[Piece], window: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows made of the pieces in order, and the rest."""
    full, now, room = [], [], window
    for doc, start, total, ids in pieces:
        while len(ids):
            now.append((doc, start, total, ids[:room]))
            took = len(now[-1][3])
            start, ids, room = start + took, ids[took:], room - took
            if not room:
                full.append(now)
                now, room = [], window
    return full, now


class _Rows:
    """Collects windows and gives them out as Arrow batches."""

    def __init__(self, part: int, base: int):
        self.part, self.base, self.n, self.rows, self.size = part, base, 0, [], 0

    def window(self, pieces: list[Piece], left: bool = False) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            self.rows.append((doc, start, len(ids), total, self.base + self.n, offset, self.part, left, ids.astype("<u4").tobytes()))
            offset += len(ids)
        self.n += 1
        self.size += offset

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.size = self.rows, [], 0
        columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _pack_task(path: str, end_id: int, window: int, open_windows: int, min_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, packer, out = encoder(path), Packer(window, open_windows, min_cut), _Rows(part, part << 32)
        for batch in slices(batches, "text"):
            docs = batch.column(0).to_pylist()
            ids, off = with_end(*enc.encode(*buffers(batch.column(1))), end_id)
            for i, doc in enumerate(docs):
                for full in packer.add((doc, 0, int(off[i + 1] - off[i]), ids[off[i] : off[i + 1]])):
                    out.window(full)
            # what stays open must not hold on to the arrays of this slice
            packer.held = {k: [(d, s, t, x.copy() if x.base is not None else x) for d, s, t, x in v] for k, v in packer.held.items()}
            if out.size > 1 << 18:
                yield out.batch()
        full, rest = packer.finish()
        for x in full:
            out.window(x)
        out.window(rest, left=True)
        yield out.batch()

    return run


def _merge_group(window: int, level: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        full, rest = joined([(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4")) for r in rows], window)
        out = _Rows(key[0].as_py(), (level << 56) | (key[0].as_py() << 32))
        for x in full:
            out.window(x)
        out.window(rest, left=True)
        return pa.Table.from_batches([out.batch()])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, fan_in: int = FAN_IN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32)."""
    work = Workspace(docs.sparkSession, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = work.table(rows.mapInArrow(_pack_task(tokenizer, end_id, window, open_windows, min_cut), SCHEMA), "pieces")
    done, left, level = first.where("not left"), first.where("left"), 1
    parts = first.agg(F.max("part")).first()[0]
    parts = 0 if parts is None else parts + 1
    while parts > 1:
        grouped = left.withColumn("part", F.floor(F.col("part") / fan_in).cast("int")).groupBy("part")
        merged = work.table(grouped.applyInArrow(_merge_group(window, level), SCHEMA), f"merged-{level}")
        done, left, level, parts = done.unionByName(merged.where("not left")), merged.where("left"), level + 1, -(-parts // fan_in)
    return done.unionByName(left).drop("part", "left")
