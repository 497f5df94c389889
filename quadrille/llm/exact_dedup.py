"""Exact deduplication with a split for heavy hitters.

Every text is reduced to its SHA-256 digest once. A Misra-Gries summary of k
counters per task, merged by summing, names every digest with more than 2n/k
copies among at most k candidates. Their exact counts and winners are computed
by a partially aggregated pass, and since there are at most k of them (a bound
that does not depend on the input) they are broadcast and applied map-side. All
other digests have at most 2n/k copies and go through an ordinary shuffle.

Defined results: a null text counts as empty; of equal texts the row with the
largest doc_id stays (a null doc_id is smaller than any), and of rows that repeat
both doc_id and text one; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.llm.workspace import Workspace, free_name, small, with_row_key

#: Counters of a summary; also the most digests that are ever broadcast (32 bytes each and a winner).
COUNTERS = 4096


def misra_gries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """One task's summary of the `digest` column: at most `counters` rows (digest, seen)."""
    held: dict[bytes, int] = {}
    for batch in batches:
        pairs = batch.column(0).value_counts()
        for digest, n in zip(pairs.field(0).to_pylist(), pairs.field(1).to_pylist(), strict=True):
            held[digest] = held.get(digest, 0) + n
        if len(held) > counters:
            counts = np.fromiter(held.values(), np.int64, len(held))
            # Taking the (k+1)-th largest count from all leaves at most k and costs each at most n/(k+1).
            cut = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
            held = {d: n - cut for d, n in held.items() if n > cut}
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "seen"])


def heavy_digests(digests: DataFrame, total: int, counters: int = COUNTERS) -> DataFrame:
    """Every digest with more than 2 * total / counters rows, and at most `counters` in all."""
    parts = digests.select("digest").mapInArrow(lambda it: misra_gries(it, counters), "digest binary, seen long")
    # The merged counts sum to at most total, so fewer than `counters` can exceed total / counters.
    return parts.groupBy("digest").agg(F.sum("seen").alias("seen")).where(F.col("seen") > F.lit(total / counters)).select("digest")


def _digest(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def _groups(docs: DataFrame, row: Column, id_col: str, text_col: str, counters: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The digests of all rows, the groups of the heavy ones (for a broadcast), the other rows and their groups."""
    digests = small(docs.select(F.col(id_col).alias("doc_id"), _digest(text_col).alias("digest"), row.alias("row")))
    heavy = F.broadcast(small(heavy_digests(digests, digests.count(), counters)))

    def groups(rows: DataFrame) -> DataFrame:
        # of equal texts the largest doc_id stays, of several rows with that one the one that is numbered last
        best = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("group_size"))
        return best.select("digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")

    rest = digests.join(heavy, "digest", "left_anti")
    return digests, F.broadcast(small(groups(digests.join(heavy, "digest")))), rest, groups(rest)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest (binary SHA-256)."""
    # the numbers are written with the digests, so they are drawn once
    digests, winners, rest, sums = _groups(docs, F.monotonically_increasing_id(), id_col, text_col, counters)
    columns = ["doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest"]
    return digests.join(winners, "digest").select(*columns).unionByName(rest.join(sums, "digest").select(*columns))


def without_copies(docs: DataFrame, work: Workspace, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows that stay, with their columns: copies of heavy digests go map-side, the others by a join with the rows' keys."""
    key, digest, keep = (free_name(docs, x) for x in ("row_key", "row_digest", "row_that_stays"))
    keyed = with_row_key(docs, work, key)
    _, winners, rest, sums = _groups(keyed, F.col(key), id_col, text_col, counters)
    gone = work.table(rest.join(sums, "digest").where("row != keep_row").select(F.col("row").alias(key)), "copies")
    heavy = keyed.withColumn(digest, _digest(text_col)).join(F.broadcast(winners.select(F.col("digest").alias(digest), F.col("keep_row").alias(keep))), digest, "left")
    left = heavy.where(F.col(keep).isNull() | (F.col(keep) == F.col(key)))
    # copies are a share of the input, so their keys are never broadcast
    return left.join(gone.hint("merge"), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
