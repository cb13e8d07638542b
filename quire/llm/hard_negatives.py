"""Hard-negative mining: exact search in K-means inverted lists that are pruned by bounds.

Every row goes to the list of its nearest centroid, which stores the largest distance of its rows from the centroid (its radius).  By Cauchy-Schwarz no
row of a list scores more than a.c + |a| r with an anchor a, or less than a.c - |a| r.  An anchor visits lists from the highest upper bound
on, skips those whose interval misses its window, and stops where the bound falls strictly below its k-th best score.  Visits are made in
rounds: the first lists of all anchors, then what the k-th scores of the round before leave.

Lists are cut into blocks of about BLOCK_ROWS rows, anchors into batches; a visit is a product of two small integer matrices.
Results are exact whatever the centroids are: they only decide how much is skipped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stage

#: Centroids are fitted on at most SAMPLE rows (those of the smallest id hashes); there are at most MOST_LISTS.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 1024, 8
#: Rows of a block; anchors of a batch; visits that a worker gets at a time.
BLOCK_ROWS, BATCH_ANCHORS, BATCH_VISITS = 2048, 500, 16
#: Lists that an anchor visits in the first round.
FIRST = 8

Batches = Iterator[pa.RecordBatch]


def whole(x: Column) -> Column:
    """floor(256 x), x as a double."""
    return F.floor(x.cast("double") * 256).cast("long")


def clean(rows: DataFrame, id_col: str, vec_col: str, label: Column, scale: Callable[[Column], Column]) -> DataFrame:
    """(vec_id, label, vec): rows that take part, one for each id (of several the one with the smallest label, then vector)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf))
    kept = rows.where(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vec_col).isNotNull()).where(~F.exists(vec_col, bad))
    out = kept.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(vec_col, scale).alias("vec"))
    if out.groupBy("vec_id").count().where("count > 1").limit(1).count():
        out = out.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of integers; shorter vectors are filled up with zeros."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


def _pack(x: np.ndarray) -> bytes:
    """Integers in the narrowest of 2, 4 and 8 bytes that holds them, which the first byte tells."""
    most = int(np.abs(x).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind[-1].encode() + x.astype(kind).tobytes()


def _unpack(b: bytes, rows: int) -> np.ndarray:
    x = np.frombuffer(b, f"<i{chr(b[0])}", offset=1)
    return x.reshape(rows, -1) if rows else x.reshape(0, 0)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; an error where one may not fit 63 bits."""
    most = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("an inner product may be over 63 bits")


def top(score: np.ndarray, able: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
    """Mask of each row's first k able columns by (score, lower column first) among those of ``least`` at least."""
    low = np.iinfo(np.int64).min
    s = np.where(able & (score >= least[:, None]), score, low)
    if s.shape[1] > k:
        bound = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
    else:
        bound = np.full((len(s), 1), low)
    over, ties = s > bound, (s == bound) & (s > low)
    return over | ties & (np.cumsum(ties, axis=1) <= k - over.sum(axis=1)[:, None])


def centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Lloyd's rounds from the first rows on."""
    c = sample[:lists].astype(np.float64)
    x = sample.astype(np.float64)
    for _ in range(ROUNDS if len(c) else 0):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)


class Bounds:
    """What tasks know of the lists: centroids, radii and numbers of blocks."""

    def __init__(self, dim: int, centroids: np.ndarray, radii: np.ndarray, blocks: np.ndarray) -> None:
        self.dim, self.centroids, self.radii, self.blocks = dim, centroids, radii, blocks

    def of(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(upper, lower) bounds of the scores of each anchor with each list."""
        a = a.astype(np.float64)
        mid, wide = a @ self.centroids.T, np.sqrt((a * a).sum(axis=1))[:, None] * np.maximum(self.radii, 0)
        slack = 1e-6 + 1e-9 * (np.abs(mid) + wide)
        held = self.blocks > 0
        return np.where(held, mid + wide + slack, -np.inf), np.where(held, mid - wide - slack, np.inf)


class Lists:
    """Inverted lists over all rows of ``rows`` (vec_id, label, vec).  What is collected to the driver is the sample and the lists' sizes and radii."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS) -> None:
        n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
        dim = max(1, dim or 0)
        lists = min(MOST_LISTS, max(1, math.isqrt(n) // 2))
        few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").toArrow()["vec"].combine_chunks()
        fitted = centroids(_matrix(few, dim), lists) if n else np.zeros((1, dim))

        def assign(batches: Batches) -> Batches:
            for batch in batches:
                x = _matrix(batch["vec"], dim).astype(np.float64)
                near = _nearest(x, fitted)
                away = np.sqrt(((x - fitted[near]) ** 2).sum(axis=1))
                yield pa.record_batch([batch["vec_id"], batch["label"], batch["vec"], pa.array(near, pa.int32()), pa.array(away, pa.float64())], names=["vec_id", "label", "vec", "list", "away"])

        self.rows = stage(rows.mapInArrow(assign, "vec_id long, label long, vec array<long>, list int, away double"), "assigned")
        found = self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect()
        radii, blocks = np.full(len(fitted), -np.inf), np.zeros(len(fitted), np.int64)
        for r in found:
            radii[r["list"]], blocks[r["list"]] = r["r"] * (1 + 1e-9) + 1e-6, -(-r["n"] // block_rows)
        self.bounds = Bounds(dim, fitted, radii, blocks)

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by("vec_id")
            x = _matrix(table["vec"].combine_chunks(), dim)
            one = lambda v, t: pa.array([v], t)
            return pa.table(
                {
                    "list": table["list"][:1], "block": table["block"][:1], "n": one(len(x), pa.int32()), "ids": one(table["vec_id"].to_numpy().tobytes(), pa.binary()),
                    "labels": one(table["label"].to_numpy().tobytes(), pa.binary()), "vecs": one(_pack(x), pa.binary()),
                }
            )

        count = F.element_at(F.array(*[F.lit(max(1, int(b))) for b in blocks]), F.col("list") + 1)
        block = F.pmod(F.xxhash64("vec_id"), count).cast("int")
        self.packed = stage(self.rows.drop("away").withColumn("block", block).groupBy("list", "block").applyInArrow(pack, "list int, block int, n int, ids binary, labels binary, vecs binary"), "lists")


_VISIT = "list int, block int, n_anchors int, a_ids binary, a_labels binary, a_vecs binary, lo binary, hi binary, kth binary"
_LOW = np.iinfo(np.int64).min


def _ints(v: pa.Array, width: int) -> np.ndarray:
    """A column of arrays with ``width`` longs each."""
    return v.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _visits(bounds: Bounds, width: int, first: int, later: bool) -> Callable[[Batches], Batches]:
    """Which blocks each batch of anchors visits: those of its ``first`` lists, or (``later``) of all others that can still matter.

    Anchors have ``width`` windows: a score s counts for one if lo <= 100 s <= hi; ``kth`` is the k-th score that it has.
    """
    dim, blocks = bounds.dim, bounds.blocks

    def visit(batches: Batches) -> Batches:
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, BATCH_ANCHORS):
                batch = whole_batch.slice(at, BATCH_ANCHORS)
                ids, labels, x = batch["vec_id"].to_numpy(), batch["label"].to_numpy(), _matrix(batch["vec"], dim)
                lo, hi, kth = (_ints(batch[c], width) for c in ("lo", "hi", "kth"))
                upper, lower = bounds.of(x)
                # bounds are floats: windows as floats may be a little wide, never narrow
                open_ = np.zeros(upper.shape, bool)
                for w in range(width):
                    open_ |= (100 * upper >= lo[:, w, None] * (1 - 1e-12)) & (100 * lower <= hi[:, w, None] * (1 + 1e-12)) & (lo[:, w] <= hi[:, w])[:, None] & (upper >= kth[:, w, None])
                rank = np.argsort(np.argsort(np.where(open_, -upper, np.inf), axis=1, kind="stable"), axis=1)
                chosen = open_ & ((rank >= first) if later else (rank < first))
                out: list[list] = [[] for _ in range(9)]
                for j in np.flatnonzero(chosen.any(axis=0)):
                    mine = np.flatnonzero(chosen[:, j])
                    row = (len(mine), ids[mine].tobytes(), labels[mine].tobytes(), _pack(x[mine]), lo[mine].tobytes(), hi[mine].tobytes(), kth[mine].tobytes())
                    for b in range(int(blocks[j])):
                        for o, v in zip(out, (int(j), b, *row), strict=True):
                            o.append(v)
                    if len(out[0]) >= 64:
                        yield _visit_batch(out)
                        out = [[] for _ in range(9)]
                if out[0]:
                    yield _visit_batch(out)

    return visit


def _visit_batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 6
    return pa.record_batch([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=[c.split()[0] for c in _VISIT.split(", ")])


def _score(width: int, k: int, same: bool) -> Callable[[Batches], Batches]:
    """Of each visit the first k rows for each anchor and window: of the anchor's label (``same``) or of another."""

    def score(batches: Batches) -> Batches:
        for batch in batches:
            for r in batch.to_pylist():
                m, n = r["n_anchors"], r["n"]
                a_ids, ids = np.frombuffer(r["a_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                s = dots(_unpack(r["a_vecs"], m), _unpack(r["vecs"], n))
                like = np.frombuffer(r["a_labels"], np.int64)[:, None] == np.frombuffer(r["labels"], np.int64)[None, :]
                able = like & (a_ids[:, None] != ids[None, :]) if same else ~like
                lo, hi, kth = (np.frombuffer(r[c], np.int64).reshape(m, width) for c in ("lo", "hi", "kth"))
                for w in range(width):
                    inside = able & (s >= -(-lo[:, w, None] // 100)) & (s <= hi[:, w, None] // 100)
                    row, col = np.nonzero(top(s, inside, k, kth[:, w]))
                    if len(row):
                        yield pa.record_batch([pa.array(a_ids[row]), pa.array(np.full(len(row), w, np.int32)), pa.array(ids[col]), pa.array(s[row, col])], names=["anchor_id", "w", "vec_id", "score"])

    return score


def search(lists: Lists, anchors: DataFrame, width: int, k: int, same: bool, first: int = FIRST) -> DataFrame:
    """(anchor_id, w, rank, vec_id, score): the first k rows for each anchor and window, by score, then smaller id.

    ``anchors``: vec_id, label, vec, lo, hi (arrays of ``width`` longs).  Exact.  A window without rows gives none.
    """
    best_of = Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "vec_id")
    none = F.array_repeat(F.lit(_LOW), width)
    kinds = "anchor_id long, w int, vec_id long, score long"
    best = None
    for later in (False, True):
        if best is None:
            asked = anchors.withColumn("kth", none)
        else:  # a window that has no k rows yet has no k-th score
            each = best.groupBy("anchor_id", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
            held = each.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("m"))
            kth = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda w: F.coalesce(F.col("m")[w], F.lit(_LOW)))
            asked = anchors.join(held, anchors["vec_id"] == held["anchor_id"], "left").withColumn("kth", kth).drop("anchor_id", "m")
        asked = asked.repartitionByRange("list", "vec_id").select("vec_id", "label", "vec", "lo", "hi", "kth")
        visits = stage(asked.mapInArrow(_visits(lists.bounds, width, first, later), _VISIT), "visits")
        found = visits.join(lists.packed, ["list", "block"]).mapInArrow(_score(width, k, same), kinds)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stage(found.withColumn("rank", F.row_number().over(best_of)).where(F.col("rank") <= k), "best", batch_rows=BATCH_VISITS)
    return best


def mine(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, scale: Callable[[Column], Column] = whole, positives: int = 5, negatives: int = 3,
    window: Sequence[int] = (50, 95), first: int = FIRST, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    ``anchor`` tells anchors among the columns vec_id and label.  Positives are an anchor's first rows of its own label, negatives the first rows of other labels
    whose score is ``window`` percent of the positive's: both by score, ties by smaller id.  Rows with a null id, label or vector, or with a null or
    non-finite component, take no part; of rows with one id one does; short vectors are filled up with zeros; an inner product of over 63 bits is an error.
    A negative positive score leaves no window; an empty table gives no rows.
    """
    lists = Lists(clean(rows, id_col, vec_col, F.col("label") if label is None else label, scale), sample, block_rows)
    asked = lists.rows.where(anchor).select("vec_id", "label", "vec", "list")
    wide = F.array(F.lit(-(1 << 62)).cast("long")), F.array(F.lit(1 << 62).cast("long"))
    near = search(lists, asked.withColumn("lo", wide[0]).withColumn("hi", wide[1]), 1, positives, True, first)
    held = near.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("rank") - 1).alias("w"), "score"))).alias("m"))
    empty = {0: F.lit(1), 1: F.lit(0)}  # no such positive: a window that nothing meets
    edge = lambda k: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda w: F.coalesce(F.col("m")[w] * window[k], empty[k].cast("long")))
    windows = asked.join(held, asked["vec_id"] == held["anchor_id"]).select("vec_id", "label", "vec", "list", edge(0).alias("lo"), edge(1).alias("hi"))
    far = search(lists, windows, positives, negatives, False, first)
    pos = near.select("anchor_id", (F.col("rank") - 1).alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(pos, ["anchor_id", "w"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
