"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Every window of `width` words of a benchmark item is a pattern; an item of fewer
words is one pattern. For each pattern length there is a SHIFT table over blocks
of two consecutive words: it says how far a search window may advance because no
pattern holds the block any nearer to its end. Where the shift is zero, the hash
of the last block selects a bucket of patterns, and the words of each are
compared with the text byte by byte.

The scan advances many stretches of text at once. The benchmark is dealt into
blocks of at most `block_bytes` of item text (by the measured total); the tables
of each are built once and broadcast, and one operator searches all blocks for
every batch of documents. A benchmark of more than `pass_bytes` takes several
passes over the documents, so what a worker holds is bounded whatever its size.

Defined results: a null or wordless text has no words and no hits; a null or
wordless item has no pattern; items that share an id count once; an item with a
null id marks words but is not listed; rows that repeat a doc_id are judged one
by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from quadrille.llm.kernel import ALNUM, LOWER, U64, buffers, covered, ragged, rolling, row_starts, runs, slices, span_hash, spans
from quadrille.llm.packed import groups
from quadrille.llm.workspace import free_name

WIDTH = 10
BLOCK_BYTES = 8 << 20
PASS_BYTES = 64 << 20
#: Words that one lane of the scan covers before the next lane takes over.
LANE = 256


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes, then start, end, row and hash of each word."""
    low = LOWER[data]
    starts, ends, rows = spans(low, off, ALNUM)
    return low, starts, ends, rows, span_hash(low, starts, ends)


class Patterns:
    """SHIFT and HASH tables of the patterns of one length: windows of m words that begin at `first` in some words."""

    def __init__(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray, item: np.ndarray, m: int):
        self.m, self.block = m, min(2, m)
        self.low, self.starts, self.ends = low, starts, ends
        # of equal windows the first one stands for all, with the items of all
        keys = [rolling(h, h, m)[0][first] for h in (hashes, span_hash(low, starts, ends, 1))]
        by = np.lexsort((first, *keys))
        lead = groups(keys[0][by], keys[1][by])
        head = by[np.repeat(lead, np.diff(np.append(lead, len(by))))]
        other = np.ones(len(by), bool)
        other[self._same(low, starts, ends, first[by], first[head])] = False
        head[other] = by[other]  # equal hashes of different words
        pairs = np.unique(np.stack([head, item[by]]), axis=1)
        at = groups(pairs[0])
        self.first, self.item = first[pairs[0][at]], pairs[1]
        self.item_begin, self.item_n = at, np.diff(np.append(at, pairs.shape[1]))
        # SHIFT: by the hash of a block
        b = self.block
        blocks = hashes if b == 1 else rolling(hashes, hashes, b)[0]
        span = m - b + 1
        bits = min(24, max(10, math.ceil(math.log2(len(self.first) * span * 16))))
        self.down = U64(64 - bits)
        self.shift = np.full(1 << bits, span, np.uint8)
        for j in range(span):
            np.minimum.at(self.shift, (blocks[self.first + j] >> self.down).astype(np.int64), np.uint8(span - 1 - j))
        # HASH: patterns side by side under the hash of their last block
        last = blocks[self.first + span - 1]
        order = np.argsort(last, kind="stable")
        self.bucket, self.first, self.item_begin, self.item_n = last[order], self.first[order], self.item_begin[order], self.item_n[order]

    def find(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions where a pattern occurs, with the number of the pattern; bounds: where rows start."""
        m, b = self.m, self.block
        first, last = bounds[:-1], bounds[1:] - m + 1  # positions of windows, row by row
        lanes = np.maximum(0, -(-(last - first) // LANE))
        begin = np.repeat(first, lanes) + LANE * ragged(np.zeros(len(lanes), np.int64), lanes)
        limit = np.minimum(begin + LANE, np.repeat(last, lanes))
        at, found = begin, []
        while len(at):
            step = self.shift[(blocks[at + (m - b)] >> self.down).astype(np.int64)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            keep = at < limit
            at, limit = at[keep], limit[keep]
        place = np.concatenate(found) if found else np.zeros(0, np.int64)
        suffix = blocks[place + (m - b)] if len(place) else np.zeros(0, U64)
        lo, hi = np.searchsorted(self.bucket, suffix, "left"), np.searchsorted(self.bucket, suffix, "right")
        place, pattern = np.repeat(place, hi - lo), ragged(lo, hi - lo)
        same = self._same(low, starts, ends, place, self.first[pattern])
        return place[same], pattern[same]

    def _same(self, low, starts, ends, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Which windows of a text have the words of the pattern windows that begin at `first`."""
        out = []
        for at in range(0, len(place), 1 << 15):
            p = place[at : at + (1 << 15), None] + np.arange(self.m)[None, :]
            q = first[at : at + (1 << 15), None] + np.arange(self.m)[None, :]
            size = ends[p] - starts[p]
            same = np.flatnonzero((size == self.ends[q] - self.starts[q]).all(1))
            size = size[same].ravel()
            mine, theirs = low[ragged(starts[p[same]].ravel(), size)], self.low[ragged(self.starts[q[same]].ravel(), size)]
            wrong = np.repeat(np.repeat(np.arange(len(same)), self.m), size)[mine != theirs]
            out.append(at + np.delete(same, np.unique(wrong)))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def build(items: list[tuple[str | None, str | None]], width: int = WIDTH) -> tuple[list[Patterns], list[str | None]]:
    """Tables for each pattern length, and the ids that pattern items refer to."""
    names: list[str | None] = list(dict.fromkeys(i for i, _ in items))
    number = {i: k for k, i in enumerate(names)}
    low, starts, ends, rows, hashes = words(*buffers(pa.array([t for _, t in items], pa.string())))
    count = np.bincount(rows, minlength=len(items))
    bounds = np.append(0, np.cumsum(count))
    item = np.array([number[i] for i, _ in items], np.int64)
    out = []
    for m in sorted({min(c, width) for c in count.tolist() if c}):
        mine = np.flatnonzero(count == m) if m < width else np.flatnonzero(count >= width)
        windows = count[mine] - m + 1
        out.append(Patterns(low, starts, ends, hashes, ragged(bounds[mine], windows), np.repeat(item[mine], windows), m))
    return out, names


def _scan(shared: list, place: dict[str, int], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, schema.names[place["text"]]):
            n = batch.num_rows
            low, starts, ends, rows, hashes = words(*buffers(batch.column(place["text"])))
            blocks = rolling(hashes, hashes, 2)[0]
            bounds = row_starts(rows, n)
            mark = np.zeros(len(starts), bool)
            old_s, old_e, old_i = (batch.column(place[k]) for k in ("starts", "ends", "items"))
            counts = old_s.value_lengths().to_numpy(zero_copy_only=False)
            if counts.sum():  # what earlier passes have marked
                base = np.repeat(bounds[:-1], counts)
                s, e = old_s.flatten().to_numpy() + base, old_e.flatten().to_numpy() + base
                mark[ragged(s, e - s)] = True
            lists = [set(x) for x in old_i.to_pylist()]
            for held in shared:
                tables, names = held.value
                for t in tables:
                    at, pattern = t.find(low, starts, ends, hashes if t.block == 1 else blocks, bounds)
                    if len(at):
                        mark |= covered(at, t.m, len(starts))
                        count = t.item_n[pattern]
                        pairs = np.unique(np.repeat(rows[at], count) * len(names) + t.item[ragged(t.item_begin[pattern], count)])
                        for r, i in zip((pairs // len(names)).tolist(), (pairs % len(names)).tolist(), strict=True):
                            if names[i] is not None:
                                lists[r].add(names[i])
            s, e = runs(mark, rows)
            per, base = row_starts(rows[s], n), bounds[rows[s]]
            out = list(batch.columns)
            out[place["starts"]] = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array(s - base, pa.int32()))
            out[place["ends"]] = pa.ListArray.from_arrays(pa.array(per, pa.int32()), pa.array(e - base, pa.int32()))
            out[place["items"]] = pa.array([sorted(x) for x in lists], pa.list_(pa.string()))
            out[place["n_words"]] = pa.array(np.diff(bounds))
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def with_hits(docs: DataFrame, benchmark: DataFrame, names: dict[str, str], width: int = WIDTH, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All columns, and n_words, starts, ends and items under the given names, without a join."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, passes = max(1, math.ceil(size / block_bytes)), max(1, math.ceil(size / pass_bytes))
    schema = StructType(list(docs.schema.fields))
    for what, kind in (("n_words", LongType()), ("starts", ArrayType(IntegerType())), ("ends", ArrayType(IntegerType())), ("items", ArrayType(StringType()))):
        schema = schema.add(names[what], kind)
        docs = docs.withColumn(names[what], (F.lit(0) if what == "n_words" else F.array()).cast(kind))
    columns = docs.columns
    place = {"text": columns.index(text_col), **{k: columns.index(v) for k, v in names.items()}}
    for turn in range(passes):
        shared = []
        for block in range(turn, blocks, passes):
            part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block) if blocks > 1 else items
            shared.append(spark.sparkContext.broadcast(build([tuple(r) for r in part.collect()], width)))  # of about block_bytes of text
        docs = docs.mapInArrow(_scan(shared, place, to_arrow_schema(schema)), schema)
    return docs


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, hit_starts and hit_ends (word positions of the maximal hit runs), items (sorted ids that occur)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    names = {"n_words": "n_words", "starts": "hit_starts", "ends": "hit_ends", "items": "items"}
    return with_hits(rows, benchmark, names, width, block_bytes, pass_bytes, item_col=item_col, item_text_col=item_text_col).drop("text")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows without any hit, with their columns."""
    names: dict[str, str] = {}
    wide = docs
    for k in ("n_words", "starts", "ends", "items"):
        names[k] = free_name(wide, k)
        wide = wide.withColumn(names[k], F.lit(0))
    found = with_hits(docs, benchmark, names, **options)
    return found.where(F.size(names["starts"]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
