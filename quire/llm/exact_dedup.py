"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Texts are read once, into a table of (id, 64-bit hash, SHA-256).  Pass 1 over that table sets two cells of a blocked Bloom
filter for every hash and keeps the cells that were set more than once.  Pass 2 tests each row against those cells: a row
that misses one of them is certainly unique and passes straight through, without a shuffle.  Only the others are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import filter_bitmaps, filter_blocks, filter_cells, filter_test, join_sized, stage, unstage


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _hashes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = _text(text_col)
    return stage(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("__q_h"), F.sha2(text, 256).alias("__q_sha")), "hashes")


def _marked(rows: DataFrame, cells_per_row: int, max_blocks: int) -> DataFrame:
    """rows (with __q_h) plus __q_again: false only where the text certainly occurs once."""
    blocks = filter_blocks(rows.count(), cells_per_row, max_blocks)
    twice = filter_cells(rows, blocks).groupBy("__q_block", "__q_cell").agg(F.count(F.lit(1)).alias("__q_n")).where("__q_n > 1")
    return filter_test(rows, filter_bitmaps(twice), blocks, "__q_again")


def _groups(again: DataFrame) -> DataFrame:
    return again.groupBy("__q_sha").agg(F.max("doc_id").alias("__q_keep"), F.count(F.lit(1)).alias("__q_size")).where("__q_size > 1")


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells_per_row: int = 16, max_blocks: int = 16384, hot_share: int = 2000) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; texts are equal when identical.  The largest id of a group stays; rows that repeat both
    id and text are all returned and all kept here (``drop_copies`` leaves one).  A null id never wins over another.
    Texts are read once and never shuffle.  Groups of more than 1/``hot_share`` of the rows are joined from a broadcast of
    at most ``hot_share`` rows, so that no task gets such a group; the rest joins by its hash.  An empty table gives an
    empty result.  ``max_blocks`` bitmaps of 4 KB bound what the filter broadcasts: at ``cells_per_row`` it is full at about
    33 million rows, and what it then passes too much shuffles as 100 bytes a row, not as texts.
    """
    rows = _hashes(docs, id_col, text_col)
    marked = _marked(rows, cells_per_row, max_blocks).drop("__q_h")
    again = stage(marked.where("__q_again").drop("__q_again"), "again")
    groups = stage(_groups(again), "groups")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("__q_keep", docs.schema[id_col].dataType), ("__q_size", "long"))]
    single = marked.where("NOT __q_again").select("__q_sha", "doc_id", *none)
    found = single.unionByName(join_sized(again, groups, ["__q_sha"], "__q_size", rows.count(), how="left", hot_share=hot_share))
    alone = F.col("__q_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("__q_keep")).alias("keep_id"),
        F.coalesce("__q_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(alone, F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("__q_keep"))).alias("kept"),
        F.col("__q_sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cells_per_row: int = 16, max_blocks: int = 16384, hot_share: int = 2000) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``: of equal texts one row, of the largest id.

    Among rows repeating id and text an arbitrary one stays; a group with null ids only keeps one of them.  Texts are read
    twice: for their hashes, and to let rows pass.  In the second reading a Bloom filter of the groups' hashes tells which
    rows may be in a group, copies in groups of more than 1/``hot_share`` of the rows go where they are read, and only the
    other rows that may be in a group shuffle.
    """
    rows = _hashes(docs, id_col, text_col)
    groups = stage(_groups(_marked(rows, cells_per_row, max_blocks).where("__q_again")), "groups")
    least = rows.count() // hot_share + 1
    unstage(rows)
    blocks = filter_blocks(groups.count(), cells_per_row, max_blocks)
    sha = F.sha2(_text(text_col), 256)
    bitmaps = filter_bitmaps(filter_cells(groups.select(F.xxhash64("__q_sha").alias("__q_h")), blocks))
    tested = filter_test(docs.withColumn("__q_s", sha).withColumn("__q_h", F.xxhash64("__q_s")), bitmaps, blocks, "__q_in").drop("__q_h")
    single = tested.where("NOT __q_in").drop("__q_in", "__q_s")
    hot = F.broadcast(groups.where(F.col("__q_size") > least).select(F.col("__q_sha").alias("__q_s"), F.col("__q_keep").alias("__q_hot_keep"), F.lit(True).alias("__q_hot")))
    left = tested.where("__q_in").drop("__q_in").join(hot, "__q_s", "left")
    left = left.where(F.col("__q_hot").isNull() | F.col(id_col).eqNullSafe(F.col("__q_hot_keep"))).drop("__q_hot", "__q_hot_keep")
    keep = groups.select(F.col("__q_sha").alias("__q_s2"), "__q_keep")
    met = left.join(keep, F.col("__q_s") == F.col("__q_s2"), "left")
    # the filter passes a little too much: a text without a group occurs once, so it stays as its own only row
    stay = met.where(F.col("__q_s2").isNull() | F.col(id_col).eqNullSafe(F.col("__q_keep"))).dropDuplicates(["__q_s"]).select(*docs.columns)
    return single.unionByName(stay)
