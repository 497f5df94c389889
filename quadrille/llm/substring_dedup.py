"""Removal of word passages that an earlier document holds, found by fixed-block anchors.

A window is `width` consecutive words, and a block is `(width + 1) // 2` of them, so
a window anywhere in a document has inside it one of the document's
non-overlapping blocks. Those are the index. Every rolling block of every
document probes it: a hit is a block that is an anchor in one document and lies
anywhere in another. Hits are extended, word by word on both sides, to all windows
that contain them; of each such window the smallest document is looked up, and in
the others it is removed. The union of the removed windows of a document is the
union of its maximal exact repeats with earlier documents. Extension goes by the
hashes of windows rather than by comparing each pair of hits, since a passage of
m documents would be m * m pairs.

Windows are equal if two independent 64-bit hashes are (blocks go by 39 bits and
their bucket; a false hit there costs work but removes nothing). What the
documents of one part share is settled inside it: of a block and of a window one
entry is sent for each part, so what a hot passage sends grows with the number of
parts, not of documents.

Defined results: a null text has no words; a null doc_id is smaller than any
other; doc_id must be an integer, since its order decides; rows that repeat a
doc_id have nothing removed on account of each other; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.kernel import NOT_SPACE, U64, buffers, covered, ragged, rolling, slices, span_hash, spans
from quadrille.llm.packed import COARSE, NULL_ID, SCHEMA, batch_of, by_bucket, by_part, coarse_of, dealt, entries, groups, measure, rows_of, table_of, with_part
from quadrille.llm.workspace import Workspace, free_name, integer_ids, with_row_key

WIDTH = 13
#: Entries that one bucket is meant to hold, and that a task gathers before it sends them.
BUCKET_ENTRIES = 1_000_000
STRETCH = 2_000_000
_LOW = U64((1 << 39) - 1)
_BLOCK = np.dtype([("bucket", "<u4"), ("lo", "<u4"), ("hi", "u1")])
_NARROW = np.dtype([("lo", "<u4"), ("hi", "u1")])
_CODE = np.dtype("<u8")
_WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("several", "u1")])


class _Text:
    """Words, rolling blocks and windows of some texts."""

    def __init__(self, column: pa.Array, width: int):
        self.data, self.off = buffers(column)
        self.n = len(self.off) - 1
        self.starts, self.ends, self.rows = spans(self.data, self.off, NOT_SPACE)
        self.words = span_hash(self.data, self.starts, self.ends)
        self.bounds = np.searchsorted(self.rows, np.arange(self.n + 1))
        self.width, self.block = width, (width + 1) // 2

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """Position and hash of each block in a text that has a window."""
        hashes, whole = rolling(self.words, self.rows, self.block)
        at = np.flatnonzero(whole & (np.diff(self.bounds) >= self.width)[self.rows[: len(whole)]])
        return at, hashes[at]

    def windows(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Position and two hashes of each window that holds a block at one of the places `hit`."""
        first, whole = rolling(self.words, self.rows, self.width)
        near = np.zeros(len(self.words) + 1, np.int64)
        near[hit + 1] = 1
        near = np.cumsum(near)
        at = np.flatnonzero(whole)
        # a window that begins up to width - block words before a hit contains it
        at = at[near[np.minimum(at + self.width - self.block + 1, len(near) - 1)] > near[at]]
        if not len(at):
            return at, first[at], first[at]
        second, _ = rolling(span_hash(self.data, self.starts, self.ends, 1), self.rows, self.width)
        return at, first[at], second[at]


def _code(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket and 39 bits of a block."""
    return ((hashes >> U64(40)) % U64(buckets)) << U64(39) | (hashes & _LOW)


def _probe(width: int, buckets: int, coarse: int):
    """Anchors and probes of each part by bucket; an entry says whether the part has an anchor, and whether two documents of it have the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, codes, held, seen = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            doc, code = np.concatenate(docs), np.concatenate(codes)  # code: with the mark of an anchor in the lowest bit
            names, which = np.unique(np.concatenate(parts), return_inverse=True)
            docs.clear(), parts.clear(), codes.clear()
            out = []
            for p, name in enumerate(names):
                mine = which[doc] == p if len(names) > 1 else slice(None)
                d, c = doc[mine], code[mine]
                by = np.argsort(c >> U64(1), kind="stable")  # documents come in order
                d, c = d[by], c[by]
                key = c >> U64(1)
                at = groups(key)
                anchor = np.maximum.reduceat(c & U64(1), at)
                several = d[at] != d[np.append(at[1:], len(d)) - 1]
                one = key[at] & _LOW
                bucket = (key[at] >> U64(39)).astype(np.int64)
                packed = one << U64(1)
                wide = buckets > coarse
                rec = np.zeros(len(at), _BLOCK if wide else _NARROW)
                rec["lo"], rec["hi"] = packed & U64(0xFFFFFFFF), packed >> U64(32)
                if wide:
                    rec["bucket"] = bucket
                mark = anchor.astype(np.int64) + 2 * several
                dealt_to = coarse_of(bucket, buckets, coarse)
                for kind in range(4):
                    use = mark == kind
                    out += rows_of(dealt_to[use], np.full(int(use.sum()), name), rec[use], kind)
            return batch_of(out)

        for batch in slices(batches, "text"):
            text = _Text(batch.column(1), width)
            at, hashes = text.blocks()
            row = text.rows[at]
            anchor = (at - text.bounds[row]) % text.block == 0
            docs.append(row + seen)
            parts.append(batch.column(0).to_numpy())
            codes.append(_code(hashes, buckets) << U64(1) | anchor.astype(U64))
            seen += text.n
            held += len(at)
            if held > STRETCH:
                yield flush()
                held = seen = 0
        if docs:
            yield flush()

    return run


def _find_hits(parts: int, buckets: int, coarse: int):
    """The blocks of a bucket that are an anchor somewhere and lie in two documents, by part."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        kind = _BLOCK if buckets > coarse else _NARROW
        found = [entries(table, k, kind) for k in range(4)]
        part = np.concatenate([x for x, _ in found])
        rec = np.concatenate([x for _, x in found])
        mark = np.repeat(np.arange(4), [len(x) for x, _ in found])
        code = (rec["lo"].astype(U64) | rec["hi"].astype(U64) << U64(32)) >> U64(1)
        by = np.argsort(code, kind="stable")
        at = groups(code[by])
        if not len(at):
            return table_of([])
        size = np.diff(np.append(at, len(by)))
        marks = np.bitwise_or.reduceat(mark[by], at)
        hit = np.repeat(((marks & 1) > 0) & ((size > 1) | (marks > 1)), size)
        mine = by[hit]
        return table_of(rows_of(coarse_of(part[mine], parts, coarse), part[mine], U64(key[0].as_py()) << U64(39) | code[mine]))

    return run


def _extend(width: int, block_buckets: int, buckets: int, coarse: int):
    """The windows around the hits of a part with their smallest document, by bucket."""

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        part = key[0].as_py()
        codes = np.sort(entries(answers, 0, _CODE)[1])
        found = []
        for batch in slices(texts.select(["doc", "text"]).to_batches(), "text") if len(codes) else ():
            text = _Text(batch.column(1), width)
            at, hashes = text.blocks()
            mine = _code(hashes, block_buckets)
            hit = codes[np.minimum(np.searchsorted(codes, mine), len(codes) - 1)] == mine
            at, h, g = text.windows(at[hit])
            rec = np.zeros(len(at), _WINDOW)
            rec["h"], rec["g"], rec["doc"] = h, g, batch.column(0).to_numpy()[text.rows[at]]
            found.append(_smallest(rec))
        if not found:
            return table_of([])
        rec = _smallest(np.concatenate(found))
        bucket = (rec["h"] % U64(buckets)).astype(np.int64)
        return table_of(rows_of(coarse_of(bucket, buckets, coarse), np.full(len(rec), part), rec))

    return run


def _smallest(rec: np.ndarray) -> np.ndarray:
    """One entry a window: its smallest document, and whether it has another."""
    by = np.lexsort((rec["doc"], rec["g"], rec["h"]))
    rec = rec[by]
    at = groups(rec["h"], rec["g"])
    if not len(at):
        return rec
    out = rec[at]
    last = np.append(at[1:], len(rec)) - 1
    out["several"] = np.maximum.reduceat(rec["several"], at) | (rec["doc"][last] != out["doc"])
    return out


def _judge(parts: int, coarse: int):
    """The windows of a bucket that some document has to give up, with the smallest document of all, by part."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part, rec = entries(table, 0, _WINDOW)
        by = np.lexsort((rec["doc"], rec["g"], rec["h"]))
        part, rec = part[by], rec[by].copy()
        at = groups(rec["h"], rec["g"])
        least = np.repeat(rec["doc"][at], np.diff(np.append(at, len(rec))))
        tell = (rec["doc"] > least) | (rec["several"] > 0)
        rec["doc"] = least
        return table_of(rows_of(coarse_of(part[tell], parts, coarse), part[tell], rec[tell]))

    return run


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of n texts that hold the given words with one space between them."""
    size = ends - starts + 1
    at = np.cumsum(size)
    out = np.full(int(size.sum()), 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[at - 1] = False
    out[inside] = data[ragged(starts, size - 1)]
    last = np.append(rows[1:] != rows[:-1], True) if len(rows) else np.zeros(0, bool)
    keep = np.ones(len(out), bool)
    keep[at[last] - 1] = False
    per = np.bincount(rows, weights=size, minlength=n).astype(np.int64)
    per -= per > 0
    return out[keep], np.concatenate([[0], np.cumsum(per)])


def _remove(width: int):
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(key: tuple[pa.Scalar, ...], texts: pa.Table, answers: pa.Table) -> pa.Table:
        _, told = entries(answers, 0, _WINDOW)
        told = told[np.lexsort((told["g"], told["h"]))]
        first = groups(told["h"])
        most = int(np.diff(np.append(first, len(told))).max()) if len(told) else 0
        out = []
        for batch in slices(texts.select(["doc", "text"]).to_batches(), "text"):
            text = _Text(batch.column(1), width)
            gone = np.zeros(len(text.words), bool)
            if len(told):
                doc = batch.column(0).to_numpy()
                h, whole = rolling(text.words, text.rows, width)
                at = np.flatnonzero(whole)
                place = np.searchsorted(told["h"], h[at])
                maybe = (place < len(told)) & (told["h"][np.minimum(place, len(told) - 1)] == h[at])
                at, place, h = at[maybe], place[maybe], h[at][maybe]
                if len(at):
                    g = rolling(span_hash(text.data, text.starts, text.ends, 1), text.rows, width)[0][at]
                    cut = np.zeros(len(at), bool)
                    for k in range(most):  # windows that share the first hash stand side by side
                        x = told[np.minimum(place + k, len(told) - 1)]
                        cut |= (x["h"] == h) & (x["g"] == g) & (x["doc"] < doc[text.rows[at]])
                    gone = covered(at[cut], width, len(text.words))
            data, off = joined_words(text.data, text.starts[~gone], text.ends[~gone], text.rows[~gone], text.n)
            kept = pa.LargeStringArray.from_buffers(text.n, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            counts = np.bincount(text.rows, minlength=text.n), np.bincount(text.rows[gone], minlength=text.n)
            out.append(pa.table([batch.column(0), pa.array(counts[0]), pa.array(counts[1]), kept], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, bucket_entries: int = BUCKET_ENTRIES, coarse: int = COARSE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, with one space between them) of every row."""
    work = Workspace(docs.sparkSession, "substring-dedup")
    key = free_name(docs, "row_key")
    doc = F.coalesce(integer_ids(docs, id_col), F.lit(NULL_ID)).alias("doc")
    rows = with_row_key(docs, work, key).select(doc, F.col(key).alias("row"), F.col(f"`{text_col}`").alias("text"))
    size, count = measure(rows)
    placed = with_part(rows, "row", size, count).select("part", "doc", "text")
    parts, buckets = max(1, math.ceil(size / (1 << 20))), max(1, math.ceil(size / 6 / bucket_entries))
    probes = placed.select("part", "text").mapInArrow(_probe(width, buckets, coarse), SCHEMA)
    probes = dealt(probes, buckets, lambda part, rec: rec["bucket"].astype(np.int64), _BLOCK, size, range(4), coarse)
    hits = by_bucket(probes, size).applyInArrow(_find_hits(parts, buckets, coarse), SCHEMA)
    hits = work.table(dealt(hits, parts, lambda part, code: part, _CODE, size, coarse=coarse), "hits")
    windows = by_part(placed, hits, size, _extend(width, buckets, buckets, coarse), SCHEMA)
    windows = dealt(windows, buckets, lambda part, rec: (rec["h"] % U64(buckets)).astype(np.int64), _WINDOW, size, coarse=coarse)
    gone = by_bucket(windows, size).applyInArrow(_judge(parts, coarse), SCHEMA)
    gone = work.table(dealt(gone, parts, lambda part, rec: part, _WINDOW, size, coarse=coarse), "windows")
    work.drop("hits")
    out = by_part(placed, gone, size, _remove(width), "doc long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("doc") != NULL_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept")
