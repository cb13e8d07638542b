"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find grouping."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import among, counter, join_sized, mix, ranges, shingle_sets, signed, sliced, stage, text_buffers, unstage

#: A pair at the threshold shares no band with at most this probability, whatever the threshold.
MISS = 5e-8
#: Registers of a signature, and the most that low thresholds may take.
REGISTERS, MOST_REGISTERS = 128, 512
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = counter(MOST_REGISTERS, 53)


def banding(percent: int) -> tuple[int, int]:
    """(bands, rows): the widest bands that miss a pair of similarity ``percent`` / 100 with a probability of MISS at most.

    At 80 % these are 32 bands of 4, for 128 registers.  Low thresholds take more registers in bands of 1; those that
    would need over MOST_REGISTERS (below 4 %) are an error.
    """
    if percent >= 100:
        return 8, 16  # equal sets have equal signatures
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** rows))) if percent > 0 else MOST_REGISTERS + 1
        if bands * rows <= (REGISTERS if rows > 1 else MOST_REGISTERS):
            return bands, rows
    raise ValueError(f"no banding of {MOST_REGISTERS} registers finds pairs at {percent} %")


def superminhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One SuperMinHash signature (m registers) per set, as uint64; an empty set's registers are all ones.

    Round j gives every element a fresh rank r and the j-th place of its own random permutation of the registers, and
    register values are ordered by (j, r).  So a set whose registers are all filled after round j needs no further round:
    large sets stop after one to three.  All sets of the list take part in a round at once.
    """
    reg = np.full(len(sets) * m, _FULL)
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    swaps: list[np.ndarray] = []
    for j in range(m):
        if not len(x):
            break
        h = mix(x + _STEP[j])
        k = j + ((h & np.uint64(0xFFFF)) * np.uint64(m - j) >> np.uint64(16)).astype(np.int64)
        place = k.copy()
        for i in range(j - 1, -1, -1):  # what earlier swaps have put at k
            at = swaps[i]
            place = np.where(place == i, at, np.where(place == at, i, place))
        slot = of * m + place
        empty = np.flatnonzero(reg[slot] >= np.uint64(j) << np.uint64(48))  # not filled in an earlier round
        np.minimum.at(reg, slot[empty], (np.uint64(j) << np.uint64(48)) | (h[empty] >> np.uint64(16)))
        swaps.append(k)
        if j < 3 or j % 4 == 0:
            more = (reg.reshape(-1, m) == _FULL).any(1)[of]
            x, of = x[more], of[more]
            swaps = [s[more] for s in swaps]
    return reg.reshape(-1, m)


_SIGNED = "doc_id long, n long, h1 long, h2 long, bands array<long>"


def _signatures(width: int, bands: int, rows: int):
    m = bands * rows
    salt = counter(rows, 61)
    per_band = counter(bands, 67)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, offsets = text_buffers(batch.column(1))
            for a, b in ranges(offsets):
                sets = shingle_sets(data, offsets[a : b + 1], width)
                sig = superminhash(sets, m)
                n = np.array([len(s) for s in sets], np.int64)
                s = [np.array([x.sum(dtype=np.uint64), mix(x).sum(dtype=np.uint64)], np.uint64) for x in sets]
                h = np.array(s, np.uint64).reshape(-1, 2)
                band = mix((mix(sig).reshape(-1, bands, rows) * salt).sum(2, dtype=np.uint64) + per_band)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, bands, dtype=np.int32)), pa.array(signed(np.ascontiguousarray(band).reshape(-1))))
                yield pa.record_batch(
                    [batch.column(0)[a:b], pa.array(n), pa.array(signed(np.ascontiguousarray(h[:, 0]))), pa.array(signed(np.ascontiguousarray(h[:, 1]))), lists],
                    names=["doc_id", "n", "h1", "h2", "bands"],
                )

    return run


def _sets(width: int):
    """(id, shingles array<long>): the distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, offsets = text_buffers(batch.column(1))
            for a, b in ranges(offsets):
                yield pa.record_batch([batch.column(0)[a:b], _lists(shingle_sets(data, offsets[a : b + 1], width))], names=["id", "shingles"])

    return run


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(signed(np.concatenate(sets))))


#: Bits of a set's bitmap.
BITMAP = 1024


def _shingles(width: int):
    """(id, shingles array<long>, bits array<long>): the sorted distinct shingle hashes, and a bitmap with a bit set for each.

    Two bitmaps differ in no more bits than the sets do in shingles, so they bound the similarity from above.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, offsets = text_buffers(batch.column(1))
            for a, b in ranges(offsets):
                sets = shingle_sets(data, offsets[a : b + 1], width)
                flat = np.concatenate(sets)
                marks = np.zeros((b - a, BITMAP), np.uint8)
                marks[np.repeat(np.arange(b - a), [len(s) for s in sets]), (flat >> np.uint64(40)).astype(np.int64) % BITMAP] = 1
                bits = np.packbits(marks, axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, bits.shape[1], dtype=np.int32)), pa.array(bits.reshape(-1)))
                yield pa.record_batch([batch.column(0)[a:b], _lists(sets), lists], names=["id", "shingles", "bits"])

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find inside a partition, in blocks: links become (node, smallest node of its tree) links."""
    for batch in batches:
        root: dict[int, int] = {}

        def find(v: int, root=root) -> int:
            while (p := root.setdefault(v, v)) != v:
                root[v] = root[p] if p in root else p
                v = root[v]
            return v

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
        made = [(v, r) for v in list(root) if (r := find(v)) != v]
        if made:
            yield pa.record_batch([pa.array([v for v, _ in made], pa.int64()), pa.array([r for _, r in made], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over links (a, b), for every node with a link to another.

    Union-find contracts the links of each partition to a forest; large-star and small-star rounds then join the forests
    until nothing changes (a logarithmic number in practice).  Minima aggregate on the map side and hot nodes are
    skew-splittable joins: nothing is collected but a count and a checksum.
    """
    forest = links.where("a <> b").mapInArrow(_forest, "a long, b long")
    edges = stage(forest.distinct(), "edges", batch_rows=None)
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        fresh = stage(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "edges")
        now = fresh.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        unstage(edges)
        edges = fresh
        if now == mark:
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out._quire_path = edges._quire_path
            return out
        mark = now


def _linked(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Sets are made anew, where the texts are read, for documents that may be in a pair; texts don't shuffle.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    wanted = among(docs, "doc_id", ids, ids.count()).where("__q_in").select("doc_id", "text")
    sets = stage(wanted.mapInArrow(_sets(width), "id long, shingles array<long>"), "sets")
    links = _alike(pairs, sets, percent)
    unstage(sets)
    return links


def _alike(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their ``sets`` (id, shingles).

    Pairs of sets are compared row by row in the JVM: as Arrow batches, they would take memory there and in the workers.
    """
    rows = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    sized = rows.select("a", "b", (F.size("x") + F.size("y")).cast("long").alias("sum"), F.size(F.array_intersect("x", "y")).cast("long").alias("same"))
    return stage(sized.where(F.col("same") * (100 + percent) >= F.col("sum") * percent).select("a", "b"), "links")


def _labelled(rows: DataFrame, grouped: DataFrame) -> DataFrame:
    """rows (doc_id, ...) plus comp: the component found so far."""
    return rows.join(grouped.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id")).drop("component")


def _again(shared: DataFrame, grouped: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that may join components: in each band bucket of ``shared`` (band, doc_id, n) one class of the bucket's largest component with each class outside it.

    The one is drawn anew in each bucket, so a class is compared with as many different ones as it has bands: most copies
    that the first center missed find their component here, for pairs in proportion to the buckets' sizes.
    """
    rows = stage(_labelled(shared.select("band", "doc_id", "n"), grouped), "in_band")
    drawn = F.min(F.struct(F.xxhash64("band", "doc_id").alias("h"), F.col("doc_id").alias("a"), F.col("n").alias("na"))).alias("one")
    each = rows.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("k"), drawn)
    top = each.groupBy("band").agg(F.max(F.struct("k", "comp", "one")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("k").alias("members")).where("comps > 1")
    top = stage(top.select("band", F.col("top.comp").alias("most"), F.col("top.one.a").alias("a"), F.col("top.one.na").alias("na"), "members"), "tops")
    met = join_sized(rows, top, ["band"], "members", rows.count()).where("comp <> most").where(F.least("n", "na") * 100 >= F.greatest("n", "na") * percent)
    pairs = stage(met.select("a", F.col("doc_id").alias("b")).distinct(), "pairs")
    for t in (rows, top):
        unstage(t)
    return pairs


def _marked_sets(near: DataFrame, source: DataFrame, width: int) -> DataFrame:
    """(id, shingles, bits) of the documents in ``near``: read once, for their meetings and for the links among those that meet."""
    ids = near.select("doc_id").distinct()
    wanted = among(source, "doc_id", ids, ids.count()).where("__q_in").select("doc_id", "text")
    return stage(wanted.mapInArrow(_shingles(width), "id long, shingles array<long>, bits array<long>").dropDuplicates(["id"]), "shingles")


def _across(near: DataFrame, source: DataFrame, width: int, percent: int, sets: DataFrame | None = None) -> DataFrame:
    """Candidate pairs (a, b) among the rows (a, doc_id, n, comp) of ``near`` that share ``a`` and differ in comp: by prefix filter.

    Inside a group the shingles of a set are ranked from rare to frequent.  Sets x and y, x the smaller, with
    100 * intersection >= p * union share one of the first n_x - ceil(2p n_x / (100 + p)) + 1 shingles of x and the first
    n_y - ceil(p n_y / 100) + 1 of y; that is exact.  Shingles of a template that a whole group has rank last, so its
    documents meet only where they are alike beyond it.  Of those that meet, pairs go on that their places in the ranking
    and their bitmaps allow to be alike, both exact bounds.  ``sets``: those of ``_marked_sets``, if made already.
    """
    sets = _marked_sets(near, source, width) if sets is None else sets
    tokens = stage(near.join(sets.drop("bits"), F.col("doc_id") == F.col("id")).select("a", "doc_id", "n", "comp", F.size("shingles").alias("m"), F.explode("shingles").alias("t")), "tokens")
    often = stage(tokens.groupBy("a", "t").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("a", "t", "df"), "often")
    # a shingle that only one component has can't be shared across components: it meets nothing, but it takes one of the first places in the prefix
    counted = join_sized(tokens, often, ["a", "t"], "df", tokens.count())
    of = Window.partitionBy("a", "doc_id")
    ranked = counted.withColumn("k", (F.col("m") - F.count(F.lit(1)).over(of) + F.row_number().over(of.orderBy("df", "t"))).cast("int"))
    long = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    first = ranked.where(F.col("k") <= long).select("a", "t", "doc_id", "n", "comp", "k")
    prefix = stage(first.join(sets.select("id", "bits"), F.col("doc_id") == F.col("id")).drop("id"), "prefix")
    for t in (tokens, often):
        unstage(t)
    return _met(prefix, percent)


def _met(prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of the rows (a, t, doc_id, n, comp, k, bits) of ``prefix`` that meet in (a, t), differ in comp and may be alike.

    In each (a, t) rows of the largest component don't meet one another, only the others: a component of any size with the same template costs a few outliers
    their number each, not its own square.
    """
    each = prefix.groupBy("a", "t", "comp").agg(F.count(F.lit(1)).alias("c"))
    top = each.groupBy("a", "t").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("members")).where("comps > 1")
    top = stage(top.select("a", "t", F.col("top.comp").alias("most"), "members"), "tops")
    rows = stage(join_sized(prefix, top, ["a", "t"], "members", prefix.count()).withColumn("large", F.col("comp") == F.col("most")).drop("most", "members"), "prefix")
    unstage(prefix)
    p, q = rows.where("NOT large").alias("p"), rows.alias("q")
    met = (F.col("p.a") == F.col("q.a")) & (F.col("p.t") == F.col("q.t")) & (F.col("p.comp") != F.col("q.comp"))
    once = F.col("q.large") | (F.col("p.doc_id") < F.col("q.doc_id"))
    first = (F.col("p.n") < F.col("q.n")) | ((F.col("p.n") == F.col("q.n")) & (F.col("p.doc_id") < F.col("q.doc_id")))
    xn, yn = F.least("p.n", "q.n"), F.greatest("p.n", "q.n")
    xk = F.when(first, F.col("p.k")).otherwise(F.col("q.k"))
    need = F.ceil((xn + yn) * percent / (100 + percent))
    short = xk <= xn - F.ceil(xn * (2 * percent) / (100 + percent)) + 1
    fits = xn * 100 >= yn * percent
    # at the first common shingle of an alike pair all the others still follow; a pair may be met there only
    room = F.least(F.col("p.n") - F.col("p.k"), F.col("q.n") - F.col("q.k")) + 1 >= need
    # alike sets differ in (100 - p) / (100 + p) * (x + y) shingles at most
    differ = sum((F.bit_count(F.col("p.bits")[i].bitwiseXOR(F.col("q.bits")[i])) for i in range(BITMAP // 64)), F.lit(0))
    alike = differ * (100 + percent) <= (xn + yn) * (100 - percent)
    pairs = p.join(q, met & once & short & fits & room & alike).select(F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b")).distinct()
    pairs = stage(pairs, "pairs")
    for t in (top, rows):
        unstage(t)
    return pairs


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set holds the distinct ``width``-word shingles (fewer words:
    the whole sequence as one).  Documents are linked where 100 * intersection >= ``percent`` * union.  Null or wordless
    texts have an empty set and stand alone, and so does a row with a null id (component null, kept).  Rows repeating an
    id count as one document and are all returned.  An empty table gives an empty result.

    Documents with equal sets form a class, represented by its smallest id, so copies never pair with each other.  Each
    band bucket links all its classes to the one that meets most others, then those of other components to one of its
    largest component (_again); only groups that still hold different components go on to compare classes across those
    components (_across).  A pair at the threshold is lost only where
    it shares no band, with a probability of MISS at most (banding()); more similar pairs less often, and a lost pair
    only counts where no other links join its documents.
    """
    return _decided(docs, id_col, text_col, width, percent)[0]


def _decided(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result of ``near_duplicates``, and the staged tables that it still reads; all others are deleted as soon as they have been read."""
    bands, rows = banding(percent)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sigs = stage(source.mapInArrow(_signatures(width, bands, rows), _SIGNED), "signatures")
    some = "n > 0 AND doc_id IS NOT NULL"
    classes = sigs.where(some).groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = stage(classes, "classes")
    reps = sigs.where("n > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    members = stage(reps.select("doc_id", "n", F.explode("bands").alias("band")), "members")
    sizes = stage(members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    # nearly all bands have one class only; these don't shuffle again
    total = members.count()
    again = stage(among(members, "band", sizes.select("band"), sizes.count()).where("__q_in").drop("__q_in"), "members")
    unstage(members)
    shared = stage(join_sized(again, sizes, ["band"], "size", total), "shared")
    for t in (again, sizes):
        unstage(t)
    # the class that meets the most others is nearest to what a bucket's classes were copied from
    met = shared.groupBy("doc_id").agg(F.sum("size").alias("met"))
    center = F.max(F.struct(F.col("met"), (-F.col("doc_id")).alias("id"), F.col("n").alias("na"))).alias("c")
    buckets = shared.join(met, "doc_id").groupBy("band").agg(center, F.count(F.lit(1)).alias("members")).select("band", (-F.col("c.id")).alias("a"), F.col("c.na").alias("na"), "members")
    buckets = stage(buckets, "buckets")
    near = stage(join_sized(shared, buckets, ["band"], "members", shared.count()).where(F.col("doc_id") != F.col("a")).select("a", "na", "doc_id", "n").distinct(), "near")
    unstage(buckets)
    star = near.where(F.least("n", "na") * 100 >= F.greatest("n", "na") * percent).select("a", F.col("doc_id").alias("b"))
    pairs = stage(star, "pairs")
    links = [_linked(pairs, source, width, percent)]
    final = components(links[0])
    unstage(pairs)
    pairs = _again(shared, final, percent)
    if not pairs.isEmpty():
        links.append(_linked(pairs, source, width, percent))
        unstage(final)
        final = components(links[0].unionByName(links[1]))
    for t in (pairs, shared):
        unstage(t)
    labelled = stage(_labelled(near.select("a", "doc_id", "n"), final), "labelled")
    unstage(near)
    mixed = labelled.groupBy("a").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")).where("lo <> hi").select("a", "members")
    mixed = stage(mixed, "mixed")
    # the center has been compared with all the others
    left = join_sized(labelled, mixed, ["a"], "members", labelled.count()).drop("members")
    sets = _marked_sets(left, source, width)
    pairs = _across(left, source, width, percent, sets)
    for t in (labelled, mixed):
        unstage(t)
    if not pairs.isEmpty():
        links.append(_alike(pairs, sets, percent))
        unstage(final)
        final = components(reduce(DataFrame.unionByName, links))
    for t in (pairs, sets, *links):
        unstage(t)
    # the classes that have copies or links; every other document is its own component
    known = classes.join(final, F.col("rep") == F.col("node"), "left").where("copies > 1 OR component IS NOT NULL").select("h1", "h2", "n", F.coalesce("component", "rep").alias("group"), "copies")
    known = stage(known, "known")
    for t in (classes, final):
        unstage(t)
    plain = sigs.select("doc_id", "n", "h1", "h2")
    found = join_sized(plain.where(some), known, ["h1", "h2", "n"], "copies", sigs.count(), how="left").drop("copies").select("doc_id", "n", "group")
    found = found.unionByName(plain.where(f"NOT ({some}) OR doc_id IS NULL").select("doc_id", "n", F.lit(None).cast("long").alias("group")))
    group = F.coalesce("group", "doc_id")
    decided = found.select("doc_id", F.col("n").alias("n_shingles"), group.alias("component_id"), F.coalesce(group == F.col("doc_id"), F.lit(True)).alias("kept"))
    return decided, [sigs, known]


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents of ``docs`` that stay, with its columns: of each group the one with the smallest id.  A row with a null id stays."""
    decided, read = _decided(docs, id_col, text_col, width, percent)
    gone = stage(decided.where("NOT kept").select(F.col("doc_id").alias("__q_gone")).distinct(), "gone")
    for t in read:
        unstage(t)
    tested = among(docs, id_col, gone, gone.count())
    passed = tested.where("NOT __q_in").drop("__q_in")
    # only rows that may go are shuffled
    rest = tested.where("__q_in").drop("__q_in").join(gone, F.col(id_col).cast("long") == F.col("__q_gone"), "left_anti")
    return passed.unionByName(rest)
