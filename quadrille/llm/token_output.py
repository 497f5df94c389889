"""Token ids as ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are ranged by doc_id, so file after file and row after row holds
ascending ids. ORC encodes the ids with its integer run-length encoding, keeps
minimum and maximum of each column for every `row_index_stride` rows, and a Bloom
filter over doc_id, so a reader splits work by stripe and skips those that can't
hold a wanted document.

Defined results: a null text is an empty one (its row holds the end id alone);
rows that repeat a doc_id stand side by side, in the order of their text hash;
null doc_ids come first; other columns are ignored; an empty table writes no row.
"""

from __future__ import annotations

from collections.abc import Iterator
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.kernel import buffers, slices
from quadrille.llm.tokens import encoder, with_end

FILE_SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>"


def _encode_task(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, at = TaskContext.get().partitionId(), encoder(path), 0
        for batch in slices(batches, "text"):
            ids, off = with_end(*enc.encode(*buffers(batch.column(1))), end_id)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(at + off[:-1]), pa.array(np.diff(off)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids.astype(np.int32)))],
                ["doc_id", "part", "start_in_part", "n_tokens", "ids"],
            )
            at += int(off[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, stripe_bytes: int = 16 << 20, row_index_stride: int = 10_000, bloom_fpp: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each text, append `end_id`, and write the files under `path`."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ranged = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": bloom_fpp, "orc.stripe.size": stripe_bytes, "orc.row.index.stride": row_index_stride, "orc.create.index": True, "compression": "zstd"}
    ranged.mapInArrow(_encode_task(tokenizer, end_id), FILE_SCHEMA).write.mode("overwrite").options(**options).orc(path)


def _with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the ids of all earlier files to start_in_part; `rows` are few bytes each or already pruned."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    rest = [c for c in rows.columns if c not in ("doc_id", "part", "start_in_part")]
    return rows.join(bases, "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), *rest)


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all earlier rows of the whole output), n_tokens, ids; with doc_ids, stripes without them are skipped."""
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    return _with_starts(files if doc_ids is None else files.where(F.col("doc_id").isin(doc_ids)), files)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids (little-endian uint32), all from the ids as read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, off = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.concatenate([[0], np.cumsum(sizes)])
            crc = [zlib.crc32(flat[off[i] : off[i + 1]]) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    files = spark.read.schema(FILE_SCHEMA).orc(path)
    summed = files.select("doc_id", "part", "start_in_part", "ids").mapInArrow(run, "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return _with_starts(summed, files)
