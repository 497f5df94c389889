"""Many entries (part, key) packed into few rows, by bucket of the key or by part of the corpus.

A corpus has about as many keys as words, and a row for each would cost several
times the key. A part is a stretch of neighbouring rows with some MB of text. What
a part has to say about a key is one entry, however many of its documents hold
the key, so a hot passage sends a few bytes a part. Entries travel as rows of
(bucket, kind, docs, counts, keys): the parts in order, how many entries each has,
and the entries, numbers or records of a few bytes. Answers come back by part and
meet its texts in a cogroup.

Where there are more buckets than `COARSE`, rows are dealt by bucket modulo
`COARSE` first, gathered, and dealt again, so a row holds many entries whatever
the number of buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

U64 = np.uint64
NULL_ID = -(1 << 63)
#: Bytes of text that one part is meant to hold, and that one task of a cogroup reads.
PART_BYTES = 8 << 20
TASK_BYTES = 64 << 20
#: Buckets that entries are dealt into at once.
COARSE = 4096
#: Entries that are gathered before they are dealt again.
GATHER = 1_000_000
SCHEMA = "bucket long, kind int, docs binary, counts binary, keys binary"
_ARROW = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])


def measure(rows: DataFrame, text: str = "text") -> tuple[int, int]:
    """Bytes of all texts, and rows."""
    size, count = rows.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    return size or 0, count


def with_part(rows: DataFrame, key: str, size: int, count: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """Adds `part`: neighbours by row key, and the fewer of them the longer the text, so every part has a bounded size (or one text)."""
    mean = max(1.0, size / max(1, count))
    shift = max(0, math.floor(math.log2(max(1.0, part_bytes / mean))))
    longer = F.least(F.lit(shift), F.greatest(F.lit(0), F.floor(F.log2(F.coalesce(F.octet_length("text"), F.lit(0)) / mean + 1e-9)))).cast("int")
    return rows.withColumn("part", F.xxhash64(F.call_function("shiftright", F.col(key), F.lit(shift) - longer), longer))


def tasks_for(df: DataFrame, size: int) -> int:
    """Partitions of a shuffle of so many bytes."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))


def rows_of(bucket: np.ndarray, doc: np.ndarray, key: np.ndarray, kind: int = 0) -> list[tuple]:
    """One row for each bucket that occurs; keys are numbers or records."""
    if not len(doc):
        return []
    if ((bucket[1:] < bucket[:-1]) | ((bucket[1:] == bucket[:-1]) & (doc[1:] < doc[:-1]))).any():
        by = np.lexsort((doc, bucket))
        bucket, doc, key = bucket[by], doc[by], key[by]
    first = np.append(True, bucket[1:] != bucket[:-1])
    cut = np.flatnonzero(first)
    lead = np.flatnonzero(first | np.append(True, doc[1:] != doc[:-1]))  # entries of one bucket and part
    docs, counts = doc[lead].astype("<i8"), np.diff(np.append(lead, len(doc))).astype("<u4")
    at = np.searchsorted(lead, np.append(cut, len(doc)))
    out = []
    for b, lo, hi, x, y in zip(bucket[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(doc)], at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append((b, kind, docs[x:y].tobytes(), counts[x:y].tobytes(), key[lo:hi].tobytes()))
    return out


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def table_of(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch_of(rows)])


def entries(table: pa.Table, kind: int, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Parts and keys of all entries of a kind."""
    width = np.dtype(width)
    mine = table.filter(pa.array(table["kind"].to_numpy() == kind)) if table.num_rows else table
    raw = [b"".join(mine[n].to_pylist()) for n in ("docs", "counts", "keys")]
    docs, counts, keys = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[1], "<u4"), np.frombuffer(raw[2], width)
    return np.repeat(docs, counts), keys


def groups(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal sorted keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def dealt(rows: DataFrame, buckets: int, fine: Callable[[np.ndarray, np.ndarray], np.ndarray], width: np.dtype, size: int, kinds: tuple[int, ...] = (0,), coarse: int = COARSE) -> DataFrame:
    """Rows with their buckets; fine: the bucket of entries (part, key).

    The rows come with the bucket itself, or where there are more than `coarse`,
    with the bucket modulo `coarse`.
    """
    if buckets > coarse:

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, now, n = [], None, 0

            def flush() -> pa.RecordBatch:
                table, out = pa.Table.from_batches(held), []
                for kind in kinds:
                    doc, key = entries(table, kind, width)
                    out += rows_of(fine(doc, key), doc, key, kind)
                held.clear()
                return batch_of(out)

            for batch in batches:
                bucket = batch.column(0).to_numpy()
                for lo, hi in zip(cut := groups(bucket).tolist(), [*cut[1:], len(bucket)], strict=True):
                    if held and (bucket[lo] != now or n > GATHER):
                        yield flush()
                        n = 0
                    now, piece = bucket[lo], batch.slice(lo, hi - lo)
                    held.append(piece)
                    n += sum(map(len, piece.column(4).to_pylist())) // np.dtype(width).itemsize
            if held:
                yield flush()

        # a coarse bucket is gathered by several tasks, so none is a hot spot
        salted = rows.repartition(tasks_for(rows, size), "bucket", F.pmod(F.xxhash64("keys"), F.lit(64)))
        rows = salted.sortWithinPartitions("bucket").mapInArrow(deal, SCHEMA)
    return rows


def by_bucket(rows: DataFrame, size: int) -> GroupedData:
    return rows.repartition(tasks_for(rows, size), "bucket").groupBy("bucket")


def coarse_of(bucket: np.ndarray, buckets: int, coarse: int = COARSE) -> np.ndarray:
    """What the producer of rows deals by."""
    return np.mod(bucket, coarse) if buckets > coarse else bucket


def by_part(docs: DataFrame, answers: DataFrame, size: int, fn, schema: str) -> DataFrame:
    """Cogroup the texts (part, text and more) with the packed answers (bucket is the part)."""
    n = tasks_for(docs, size)
    left = docs.repartition(n, "part").groupBy("part")
    return left.cogroup(answers.withColumnRenamed("bucket", "part").repartition(n, "part").groupBy("part")).applyInArrow(fn, schema)
