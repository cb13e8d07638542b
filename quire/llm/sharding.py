"""Rendezvous hashing of record keys over weighted shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the best score -weight / ln(u), where u is a hash of (key, shard) in (0, 1).

    A shard's score depends on nothing but the key, its number and its weight, so an added shard takes rows only into
    itself, a removed one gives up only its own, and each gets its weight's share.  A weight of 0 gets no rows.
    """
    scores = []
    for k, w in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(k)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
        score = F.lit(float(w)) / -F.ln(u) if w > 0 else F.lit(-1.0)
        scores.append(F.struct(score.alias("score"), F.lit(-k).alias("k")))
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return (-best["k"]).cast("int")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | Sequence[float] = 8, buckets: int = 256) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    ``shards``: a number, or one weight per shard.  Null text counts as empty; a null id is a key of its own.  Repeated
    rows get the same shard and different slots.  Slots run gapless from 0 in each shard, in the order of (bucket,
    id, crc): rows are numbered inside ``buckets`` hash buckets per shard, then shifted by the buckets before, so that no
    task holds a shard.  At most shards x buckets counts are broadcast.  The order inside is total up to equal rows.
    """
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("\x00null"))
    crc = F.crc32(text.cast("binary"))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        crc.alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        shard_of(key, [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
        # the crc keeps many rows of one id apart
        F.pmod(F.xxhash64(key, crc, F.lit("slot")), F.lit(buckets)).cast("int").alias("__q_bucket"),
    )
    counts = rows.groupBy("shard", "__q_bucket").agg(F.count(F.lit(1)).alias("__q_n"))
    from pyspark.sql import Window

    before = Window.partitionBy("shard").orderBy("__q_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__q_bucket", F.coalesce(F.sum("__q_n").over(before), F.lit(0)).alias("__q_start"))
    inside = Window.partitionBy("shard", "__q_bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("__q_at", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "__q_bucket"])
        .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("__q_start") + F.col("__q_at")).cast("long").alias("slot"), "grown_shard")
    )
