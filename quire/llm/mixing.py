"""Mixing sources to target weights, with DataFrame functions only.

The words of each source are packed, end to end, into blocks of fixed length (the last one is shorter).  A source's target says how
many blocks, the last perhaps cut, it puts into the mix.  Output shards draw how many slots each source gets from a
multinomial; what is drawn beyond a source's blocks goes to the sources that were drawn too seldom, so that totals are exact.  The
j-th slot of a source maps to a block by a pseudorandom permutation of the source's block numbers, a new one for each pass over
them, and blocks join by number.  Every step is arithmetic on ids and sizes, so reruns agree, and lost executors change nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stage

WORD = r"[^\x20\x09-\x0D]+"
#: A source's target is at most this many times its size.
MOST = 3
_P = 2147483647
#: Rounds of the permutation; slots of a source's interval are looked up in this many cells.
ROUNDS, CELLS = 24, 4096
#: With more sources than this, the cells are not broadcast.
BROADCAST_SOURCES = 100_000


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; written out twice, it would be computed twice."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scattered(v: Column, key: Column | int) -> Column:
    """A pseudorandom number from 0 to 2^31 - 2, by arithmetic that any SQL engine can do.  ``v`` may be any long, ``key`` is not negative."""
    k = F.lit(key) if isinstance(key, int) else key
    return _let((v.bitwiseAND(F.lit(_P)) * 48271 + F.pmod(F.shiftright(v, 31), F.lit(_P)) * 69621 + k % _P * 40692) % _P, lambda u: (u * u + 12345) % _P)


def permuted(x: Column, n: Column, key: Column) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 to n - 1 (swap-or-not: in each round x and k - x change places or not)."""

    def step(acc: Column, r: Column) -> Column:
        k = (scattered(r, key) * _P + scattered(r, key + 1)) % n

        def choose(other: Column) -> Column:
            return _let(F.greatest(acc, other), lambda m: F.when(scattered(m, key + r + 2) % 2 == 1, other).otherwise(acc))

        return _let(F.pmod(k - acc, n), choose)

    return F.aggregate(F.array(*[F.lit(r).cast("long") for r in range(ROUNDS)]), x.cast("long"), step)


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", buckets: int = 256, keep_text: bool = False) -> DataFrame:
    """(doc_id, size, __q_src, __q_b, __q_tie[, __q_text]): what packing needs of each row.

    __q_src keeps the order of sources by code point, null last; __q_b is one of ``buckets`` parts of a source.
    """
    text, src, key = F.col(text_col), F.col(source_col).cast("string"), F.coalesce(F.col(id_col).cast("long"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.coalesce(F.concat(F.lit("s"), src), F.lit("z")).alias("__q_src"),
        (scattered(key, 5) % buckets).cast("int").alias("__q_b"), F.xxhash64(text).alias("__q_tie"), *([text.alias("__q_text")] if keep_text else []),
    )


def targets(sums: DataFrame, weights: Sequence[int], block_words: int, most: int = MOST) -> DataFrame:
    """One row per source of ``sums`` (__q_src, words): __q_no, source_size, target, and the numbers of blocks that follow from it.

    Weights repeat along the sources.  Targets share all words by weight; one that would be over ``most`` times its source's size
    stops there, and the rest is shared by weight among the others.  With sources ordered by size / weight, the share of one unit of weight is
    the largest that any beginning of that order, taken as stopped, leaves.  The list of sources (names and numbers, no rows) is
    ordered in one task.
    """
    by_name, by_cap = Window.orderBy("__q_src"), Window.orderBy("__q_cap_w", "__q_no")
    rows = sums.groupBy("__q_src").agg(F.sum("words").alias("source_size")).withColumn("__q_no", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("__q_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("__q_no") % len(weights) + 1)).withColumn("__q_cap", F.col("source_size") * most)
    rows = rows.withColumn("__q_cap_w", F.col("__q_cap") / F.col("__q_w"))
    stopped = F.coalesce(F.sum("__q_cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_w = F.sum("__q_w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    every = Window.partitionBy()
    rows = rows.withColumn("__q_level", (F.sum("source_size").over(every) - stopped).cast("double") / open_w)
    rows = rows.withColumn("target", F.least(F.col("__q_cap").cast("double"), F.col("__q_w") * F.max("__q_level").over(every)))
    rows = rows.withColumn("__q_t", F.round("target").cast("long"))
    blocks = lambda c: F.expr(f"({c} + {block_words - 1}) div {block_words}")
    rows = rows.withColumn("__q_full", F.expr(f"source_size div {block_words}")).withColumn("__q_blocks", blocks("source_size"))
    rows = rows.withColumn("__q_passes", F.expr("CASE WHEN source_size > 0 THEN __q_t div source_size ELSE 0 END"))
    rows = rows.withColumn("__q_slots", F.col("__q_passes") * F.col("__q_blocks") + blocks("(__q_t - __q_passes * source_size)"))
    return rows.select("__q_src", F.col("__q_no").cast("long").alias("__q_no"), "source_size", "target", "__q_t", "__q_full", "__q_blocks", "__q_slots")


def packed(rows: DataFrame, sums: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with their source's numbers, __q_k (their number in the bucket) and __q_start, their first word's place in the source.

    Places come from two levels, buckets in a source and rows in a bucket, so no task holds a source.
    """
    inside, before = Window.partitionBy("__q_src", "__q_b").orderBy("doc_id", "__q_tie", "size"), Window.unboundedPreceding
    base = F.coalesce(F.sum("words").over(Window.partitionBy("__q_src").orderBy("__q_b").rowsBetween(before, -1)), F.lit(0))
    starts = sums.withColumn("__q_base", base).drop("words").join(found, "__q_src")
    placed = rows.withColumn("__q_k", F.row_number().over(inside)).withColumn("__q_in", F.coalesce(F.sum("size").over(inside.rowsBetween(before, -1)), F.lit(0)))
    return placed.join(starts, ["__q_src", "__q_b"]).withColumn("__q_start", F.col("__q_base") + F.col("__q_in"))


def pieces(rows: DataFrame, block_words: int) -> DataFrame:
    """A row for each block that a packed row has words in: __q_block and the words' places __q_from to __q_to in it.  Rows without words get one, in no block."""
    n = block_words
    span = F.expr(f"CASE WHEN size > 0 THEN sequence(__q_start div {n}, (__q_start + size - 1) div {n}) ELSE array(-1L - __q_b) END")
    cut = rows.withColumn("__q_block", F.explode(span))
    first = F.col("__q_block") * n
    return cut.withColumn("__q_from", F.greatest(F.col("__q_start") - first, F.lit(0))).withColumn("__q_to", F.least(F.col("__q_start") + F.col("size") - first, F.lit(n)))


def draws(found: DataFrame, shard_slots: int, seed: int) -> DataFrame:
    """(shard, __q_no, n): how many of a shard's slots each source gets, drawn from the multinomial whose weights are the sources' slots."""
    spark = found.sparkSession
    total, count = found.agg(F.coalesce(F.sum("__q_slots"), F.lit(0)), F.count(F.lit(1))).first()
    by_no = Window.orderBy("__q_no").rowsBetween(Window.unboundedPreceding, 0)
    width = total // CELLS + 1
    ends = found.where("__q_slots > 0").select("__q_no", (F.sum("__q_slots").over(by_no)).alias("__q_hi"), "__q_slots").withColumn("__q_lo", F.col("__q_hi") - F.col("__q_slots"))
    cells = ends.withColumn("__q_cell", F.explode(F.expr(f"sequence(__q_lo div {width}, (__q_hi - 1) div {width})"))).drop("__q_slots")
    picks = spark.range(0, total, 1, max(spark.sparkContext.defaultParallelism, total // 2_000_000)).select(
        F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total))).alias("__q_pick")
    )
    picks = picks.withColumn("__q_cell", F.expr(f"__q_pick div {width}"))
    met = picks.join(F.broadcast(cells) if count <= BROADCAST_SOURCES else cells, "__q_cell").where("__q_pick >= __q_lo AND __q_pick < __q_hi")
    return met.groupBy("shard", "__q_no").agg(F.count(F.lit(1)).alias("n"))


def slots(found: DataFrame, drawn: DataFrame, block_words: int, seed: int, parts: int) -> DataFrame:
    """(shard, slot, __q_no, __q_pass, __q_block, __q_words): every slot of the mix, its block and how many of the block's words it takes.

    A source's slots are numbered along the shards.  Drawn slots beyond a source's number are void; the n-th void slot goes to the n-th slot that
    another source lacks.
    """
    along = Window.partitionBy("__q_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    rows = drawn.join(found.select("__q_no", "__q_slots"), "__q_no").withColumn("__q_j", F.coalesce(F.sum("n").over(along), F.lit(0)))
    # dealt out again by shard: a source's numbers may meet in a task, its slots may not
    rows = rows.repartition(parts, "shard", "__q_no").withColumn("__q_kept", F.least(F.col("n"), F.greatest(F.col("__q_slots") - F.col("__q_j"), F.lit(0))))
    by_no = Window.orderBy("__q_no").rowsBetween(Window.unboundedPreceding, -1)
    total = found.join(drawn.groupBy("__q_no").agg(F.sum("n").alias("__q_d")), "__q_no", "left").withColumn("__q_d", F.coalesce("__q_d", F.lit(0)))
    over, lack = F.greatest(F.col("__q_d") - F.col("__q_slots"), F.lit(0)), F.greatest(F.col("__q_slots") - F.col("__q_d"), F.lit(0))
    total = total.select("__q_no", "__q_d", lack.alias("__q_lack"), F.coalesce(F.sum(over).over(by_no), F.lit(0)).alias("__q_v0"), F.coalesce(F.sum(lack).over(by_no), F.lit(0)).alias("__q_l0"))
    each = lambda start, n: F.explode(F.expr(f"sequence({start}, {start} + {n} - 1)"))
    own = rows.where("__q_kept > 0").select("shard", "__q_no", each("__q_j", "__q_kept").alias("__q_j"))
    first_void = "(__q_v0 + greatest(__q_j, __q_slots) - __q_slots)"
    void = rows.where("n > __q_kept").join(total.select("__q_no", "__q_v0"), "__q_no").select("shard", each(first_void, "(n - __q_kept)").alias("__q_v"))
    lacks = total.where("__q_lack > 0").select("__q_no", "__q_d", "__q_l0", each("__q_l0", "__q_lack").alias("__q_v")).select("__q_no", (F.col("__q_d") + F.col("__q_v") - F.col("__q_l0")).alias("__q_j"), "__q_v")
    both = own.unionByName(void.join(lacks, "__q_v").select("shard", "__q_no", "__q_j"))
    both = both.join(found.drop("__q_src", "target"), "__q_no")
    both = both.withColumn("__q_pass", F.expr("__q_j div __q_blocks")).withColumn("__q_i", F.col("__q_j") - F.col("__q_pass") * F.col("__q_blocks"))
    place = permuted(F.col("__q_i"), F.greatest(F.col("__q_full"), F.lit(1)), F.col("__q_no") * 1009 + F.col("__q_pass") * 97 + seed)
    block = F.when(F.col("__q_i") < F.col("__q_full"), place).otherwise(F.col("__q_full"))
    size = F.when(F.col("__q_i") < F.col("__q_full"), block_words).otherwise(F.col("source_size") - F.col("__q_full") * block_words)
    words = F.least(size, F.col("__q_t") - F.col("__q_pass") * F.col("source_size") - F.col("__q_i") * block_words)
    slot = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("__q_no", "__q_j", F.lit(seed)), "__q_no", "__q_j")) - 1
    return both.select("shard", slot.alias("slot"), "__q_no", F.col("__q_pass").cast("int").alias("__q_pass"), block.alias("__q_block"), words.alias("__q_words"))


class Mix:
    """The mix of ``docs``: ``taken()`` says how many words of each row it takes, ``blocks()`` gives the blocks themselves.

    ``weights`` repeat along the sources, ordered by code point, null last.  Null text counts as empty; a null source is a source;
    repeated rows take part as rows of their own, and rows of one id share a bucket.  An empty table gives an empty mix.  A source's taken words are its target,
    rounded.  Other columns of ``docs`` are not looked at.
    """

    def __init__(self, docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = MOST, block_words: int = 256, shard_slots: int = 1024, seed: int = 11, rows_per_bucket: int = 100_000, keep_text: bool = True, **columns: str) -> None:
        self.block_words, self.seed = block_words, seed
        buckets = max(256, docs.count() // rows_per_bucket)
        self.rows = stage(sizes(docs, buckets=buckets, keep_text=keep_text, **columns), "sizes")
        self.sums = self.rows.groupBy("__q_src", "__q_b").agg(F.sum("size").alias("words"))
        self.targets = stage(targets(self.sums, weights, block_words, most), "targets")
        self.draws = stage(draws(self.targets, shard_slots, seed), "draws")

    def slots(self) -> DataFrame:
        spark = self.draws.sparkSession
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), self.draws.count() // 1000)
        return slots(self.targets, self.draws, self.block_words, self.seed, parts)

    def _pieces(self, rows: DataFrame) -> DataFrame:
        return pieces(packed(rows, self.sums, self.targets), self.block_words)

    def taken(self) -> DataFrame:
        """One row per document: doc_id, size, source, source_size, target, taken."""
        cut = self._pieces(self.rows.drop("__q_text")).join(self.slots().drop("shard", "slot"), ["__q_no", "__q_block"], "left")
        words = F.greatest(F.lit(0), F.least("__q_to", "__q_words") - F.col("__q_from"))
        one = cut.groupBy("__q_no", "__q_b", "__q_k", "doc_id", "size", "__q_src", "source_size", "target").agg(F.sum(F.when(F.col("__q_words").isNotNull(), words).otherwise(0)).alias("taken"))
        source = F.when(F.col("__q_src") != "z", F.expr("substring(__q_src, 2)"))
        return one.select("doc_id", "size", source.alias("source"), "source_size", "target", "taken")

    def blocks(self) -> DataFrame:
        """The mix: shard, slot, source, block, n_words, doc_ids, text (the words of the block, by single spaces)."""
        own = self._pieces(self.rows.where("size > 0"))
        at = F.greatest(F.col("__q_block") * self.block_words - F.col("__q_start"), F.lit(0)) + 1
        own = own.withColumn("__q_piece", F.slice(F.regexp_extract_all("__q_text", F.lit(WORD), F.lit(0)), at.cast("int"), (F.col("__q_to") - F.col("__q_from")).cast("int")))
        met = self.slots().join(own.select("__q_no", "__q_block", "__q_from", "__q_to", "__q_piece", "doc_id", "__q_src"), ["__q_no", "__q_block"]).where("__q_from < __q_words")
        part = F.struct("__q_from", F.slice("__q_piece", F.lit(1), F.least(F.col("__q_to"), F.col("__q_words")).cast("int") - F.col("__q_from").cast("int")).alias("w"), "doc_id")
        out = met.groupBy("shard", "slot", "__q_src", "__q_block", "__q_words").agg(F.array_sort(F.collect_list(part)).alias("p"))
        source = F.when(F.col("__q_src") != "z", F.expr("substring(__q_src, 2)"))
        return out.select("shard", "slot", source.alias("source"), F.col("__q_block").alias("block"), F.col("__q_words").alias("n_words"), F.col("p.doc_id").alias("doc_ids"), F.array_join(F.flatten(F.col("p.w")), " ").alias("text"))
