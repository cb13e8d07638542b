"""Merkle manifest of a table: a hash of every row, trees of arity 3 over each group's rows, and one tree over the groups' roots.

Fragments of the forest form a monoid.  A fragment holds the nodes that it could not resolve, keyed by tree, level and index; two
fragments merge by putting their nodes together and replacing every complete run of siblings with its parent.  How many
siblings a run has follows from the number of leaves, so the last, shorter run needs no end mark.  Merging is associative and an
empty fragment is its neutral element; a fragment of neighbouring rows keeps few nodes of each level, whatever its length.

Rows are range-partitioned by (group, id).  Each partition makes its fragment, fragments of neighbouring partitions merge in a tree of
DESCENT, and what the merges resolved goes back to the partitions that have leaves below it, which then have all nodes of their rows' proofs.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import stage

ARITY = 3
#: Fragments that merge into one in each round.
DESCENT = 16
#: Rows of a partition.
PART_ROWS = 20_000
#: The tree over the groups' roots; groups' own trees have their number, from 0.
TOP = -1
_LEVELS = 40
_NODE = pa.struct([("tree", pa.int64()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("hash", pa.string())])
_NODE_DDL = "struct<tree:bigint,n:bigint,level:int,idx:bigint,hash:string>"

#: A node's key, (tree, level, index), and its tree's number of leaves with its hash.
Nodes = dict[tuple[int, int, int], tuple[int, str]]


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level of a tree of n leaves."""
    return -(-n // ARITY**level)


def resolve(nodes: Nodes, groups: int, keep: bool = False, made: list | None = None) -> Nodes:
    """Replaces complete runs with their parents until none is left; a group's root becomes a leaf of the tree over ``groups`` groups.

    ``keep`` leaves the children in as well; ``made`` gets the keys of new nodes.
    """
    todo = defaultdict(set)
    for tree, level, idx in nodes:
        todo[level].add((tree, idx // ARITY))

    def add(key: tuple[int, int, int], n: int, value: str) -> None:
        if key not in nodes:
            nodes[key] = (n, value)
            if made is not None:
                made.append(key)
            todo[key[1]].add((key[0], key[2] // ARITY))

    while todo:
        level = min(todo)
        for tree, run in todo.pop(level):
            keys = [(tree, level, run * ARITY + k) for k in range(ARITY)]
            found = [k for k in keys if k in nodes]
            if not found:
                continue
            n = nodes[found[0]][0]
            wide = width(n, level)
            if len(found) < min(ARITY, wide - run * ARITY):
                continue
            if wide == 1:
                if tree != TOP:
                    add((TOP, 0, tree), groups, nodes[found[0]][1])
                    if not keep:
                        del nodes[found[0]]
                continue
            value = digest(*(nodes[k][1] for k in found))
            if not keep:
                for k in found:
                    del nodes[k]
            add((tree, level + 1, run), n, value)
    return nodes


def merge(fragments: Iterable[Nodes], groups: int, made: list | None = None) -> Nodes:
    """The monoid's operation, on any number of fragments with different leaves."""
    out: Nodes = {}
    for f in fragments:
        out |= f
    return resolve(out, groups, made=made)


def _paths(nodes: Nodes, groups: int):
    """A function of a node's key: (left siblings, right siblings, the same of its parent), up to the root over all groups."""
    memo: dict[tuple[int, int, int], tuple | None] = {}

    def path(key: tuple[int, int, int], n: int, remember: bool = True):
        if key in memo:
            return memo[key]
        tree, level, idx = key
        wide = width(n, level)
        if wide == 1:
            out = None if tree == TOP else path((TOP, 0, tree), groups)
        else:
            first = idx - idx % ARITY
            run = range(first, min(first + ARITY, wide))
            out = ("".join(nodes[tree, level, k][1] for k in run if k < idx), "".join(nodes[tree, level, k][1] for k in run if k > idx), path((tree, level + 1, idx // ARITY), n))
        if remember:
            memo[key] = out
        return out

    return path


def leaf(columns: Sequence[Column]) -> Column:
    """Hash of a row: each value as byte count, colon and text; null as a dash."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[("src", "ascending"), ("id", "ascending"), ("leaf", "ascending")], null_placement="at_start"))


def _leaf_nodes(rows: pa.Table, runs: list[dict]) -> Nodes:
    """Level 0 of a partition: its rows in order, numbered by the runs of its groups."""
    values, at, out = rows["leaf"].to_pylist(), 0, {}
    for r in runs:
        for k in range(r["size"]):
            out[r["tree"], 0, r["start"] + k] = (r["n"], values[at + k])
        at += r["size"]
    return out


def _rows(nodes: Nodes, keys: Iterable | None = None) -> list[dict]:
    return [{"tree": k[0], "n": nodes[k][0], "level": k[1], "idx": k[2], "hash": nodes[k][1]} for k in (nodes if keys is None else keys)]


def _dict(rows: Iterable[dict]) -> Nodes:
    return {(r["tree"], r["level"], r["idx"]): (r["n"], r["hash"]) for r in rows}


def _fragment_table(part: int, kept: Nodes, made: list[dict]) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int64()), "open": pa.array([_rows(kept)], pa.list_(_NODE)), "made": pa.array([made], pa.list_(_NODE))})


class Manifest:
    """The manifest of ``docs``: ``root`` is the table's hash, ``proofs()`` gives each row's.

    A row is hashed by ``fields``; groups are the values of ``group``, null first, then in byte order; rows of a group ascend by ``order``
    (null first), ties by hash.  ``changed`` names columns that a tampered copy of a row has instead, whose leaf is then checked against the original
    siblings; rows where it changes nothing verify.  Rows that repeat are leaves of their own.  An empty table has no root (None) and no proofs.
    Other columns are not looked at.
    """

    def __init__(self, docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", changed: Mapping[str, Column] | None = None, part_rows: int = PART_ROWS) -> None:
        spark = docs.sparkSession
        src = F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit(""))
        own = leaf([F.col(f) for f in fields])
        other = leaf([(changed or {}).get(f, F.col(f)) for f in fields])
        rows = docs.select(F.col(order).alias("id"), src.alias("src"), own.alias("leaf"), other.alias("other"))
        rows = stage(rows.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other"))), "leaves")
        total = rows.count()
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // part_rows + 1)
        placed = rows.repartitionByRange(parts, "src", F.col("id").asc_nulls_first(), "leaf")
        self.rows = stage(placed.withColumn("part", F.spark_partition_id().cast("long")), "parts")
        self.runs, self.groups = self._runs()
        self._reduce(parts)

    def _runs(self) -> tuple[DataFrame, int]:
        """(part, runs): of each partition's groups the tree, its leaves, the first one here and their number here."""
        along = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        counts = self.rows.groupBy("src", "part").agg(F.count(F.lit(1)).alias("size"))
        trees = counts.groupBy("src").agg(F.sum("size").alias("n")).withColumn("tree", F.row_number().over(Window.orderBy("src")).cast("long") - 1)
        each = counts.withColumn("start", F.coalesce(F.sum("size").over(along), F.lit(0))).join(trees, "src")
        runs = each.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("src", "tree", "n", "start", "size"))).alias("runs"))
        runs = stage(runs, "runs")
        groups = runs.agg(F.max(F.expr("aggregate(runs, -1L, (a, r) -> greatest(a, r.tree))"))).first()[0]
        return runs, 0 if groups is None else groups + 1

    def _reduce(self, parts: int) -> None:
        groups = self.groups

        def fragment(rows: pa.Table, side: pa.Table) -> pa.Table:
            runs = side["runs"][0].as_py()
            return _fragment_table(side["part"][0].as_py(), resolve(_leaf_nodes(_sorted(rows), runs), groups), [])

        def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            made: list = []
            nodes: Nodes = {}
            for f in table["open"].to_pylist():
                nodes |= _dict(f)
            logged = dict(nodes)
            resolve(logged, groups, keep=True, made=made)
            return _fragment_table(key[0].as_py(), resolve(nodes, groups), _rows(logged, made))

        schema = f"part long, open array<{_NODE_DDL}>, made array<{_NODE_DDL}>"
        level = stage(self.rows.groupBy("part").cogroup(self.runs.groupBy("part")).applyInArrow(fragment, schema), "fragments")
        spine = [level.select(F.inline("open"))]
        while parts > 1:
            parts = -(-parts // DESCENT)
            level = stage(level.withColumn("part", F.floor(F.col("part") / DESCENT)).groupBy("part").applyInArrow(merged, schema), "fragments")
            spine.append(level.select(F.inline("made")))
        last = level.select(F.inline("open")).first()
        self.root: str | None = None if last is None else last["hash"]
        self._spine = spine[0]
        for s in spine[1:]:
            self._spine = self._spine.unionByName(s)

    def _known(self) -> DataFrame:
        """(part, runs, known): with the nodes of other partitions that are siblings above this one's rows: few in each level."""
        each = self.runs.select("part", F.inline("runs"))
        split = each.where("size < n").select("part", "tree", "n", F.col("start").alias("a"), (F.col("start") + F.col("size") - 1).alias("b"))
        top = each.groupBy("part").agg(F.min("tree").alias("a"), F.max("tree").alias("b")).select("part", F.lit(TOP).cast("long").alias("tree"), F.lit(self.groups).cast("long").alias("n"), "a", "b")
        powers = F.array(*[F.lit(ARITY**k) for k in range(_LEVELS)]).cast("array<long>")
        each_level = split.unionByName(top).select("part", "tree", "n", "a", "b", F.posexplode(powers).alias("level", "p")).where("p < n * 3")
        wanted = each_level.select("part", "tree", "level", F.explode(F.array_distinct(F.array(F.expr(f"a div p div {ARITY}"), F.expr(f"b div p div {ARITY}")))).alias("run"))
        spine = self._spine.withColumn("run", F.expr(f"idx div {ARITY}"))
        known = wanted.join(spine, ["tree", "level", "run"]).groupBy("part").agg(F.collect_set(F.struct("tree", "n", "level", "idx", "hash")).alias("known"))
        return self.runs.join(known, "part", "left")

    def proofs(self) -> DataFrame:
        """One row per row: id, source, leaf, subroot, root, proof_sha256, folded_root, verified."""
        groups, root = self.groups, self.root

        def prove(rows: pa.Table, side: pa.Table) -> pa.Table:
            rows, runs = _sorted(rows), side["runs"][0].as_py()
            nodes = _leaf_nodes(rows, runs) | _dict(side["known"][0].as_py() or ())
            path = _paths(resolve(nodes, groups, keep=True), groups)
            leaves, others, at, out = rows["leaf"].to_pylist(), rows["other"].to_pylist(), 0, []
            for r in runs:
                subroot = nodes[TOP, 0, r["tree"]][1]
                for k in range(r["size"]):
                    step, siblings, value = path((r["tree"], 0, r["start"] + k), r["n"], remember=False), [], others[at] or leaves[at]
                    while step is not None:
                        left, right, step = step
                        siblings += (left, right)
                        value = digest(left, value, right)
                    out.append((leaves[at], subroot, root, digest(*siblings), value, value == root))
                    at += 1
            names = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            columns = [list(c) for c in zip(*out, strict=True)]
            return pa.table({"id": rows["id"], "source": rows["src"], **dict(zip(names, columns, strict=True))})

        kind = self.rows.schema["id"].dataType.simpleString()
        schema = f"id {kind}, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        out = self.rows.groupBy("part").cogroup(self._known().groupBy("part")).applyInArrow(prove, schema)
        return out.withColumn("source", F.when(F.col("source") != "", F.expr("substring(source, 2)")))
