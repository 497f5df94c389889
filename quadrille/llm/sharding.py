"""Weighted rendezvous hashing of record keys over shards.

Each (key, shard) pair gets a hash, read as a uniform number u, and the score
-weight / ln(u); the shard with the highest score takes the key. Adding a shard
adds one score, so a key either stays or moves into the new shard, and the
expected share that moves is the new shard's weight over the total.

Slots number the rows of a shard without gaps. They come from a block of the
key's hash, whose count per shard is known, and a rank inside the block, so no
task ever sees a whole shard.

Defined results: a null key hashes as its own value; repeated keys share a shard
and get slots of their own; a null text has size `overhead` and the CRC of no
bytes; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one block of slots is meant to hold.
BLOCK_ROWS = 4096


def rendezvous(key: Column, weights: list[float]) -> Column:
    """The shard number for a key; the order of equal scores is the order of shards."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a positive weight")

    def score(shard: int, weight: float) -> Column:
        # 53 bits of the hash as a number in (0, 1)
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("back"))

    ranked = [score(i, w) for i, w in enumerate(weights)]
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
    return (-best["back"]).cast("int")


def shard(docs: DataFrame, shards: int, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard (the shard with one more shard of mean weight)."""
    weights = weights or [1.0] * shards
    if len(weights) != shards:
        raise ValueError("one weight for each shard")
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    blocks = max(1, math.ceil(docs.count() / shards / BLOCK_ROWS))
    key = F.col("doc_id")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + overhead).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.select("*", rendezvous(key, weights).alias("shard"), rendezvous(key, [*weights, sum(weights) / shards]).alias("grown_shard"), F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(blocks)).alias("block"))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    base = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "block", F.coalesce(F.sum("n").over(base), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.select("*", rank.alias("rank"))
    out = ranked.join(starts, ["shard", "block"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard")
