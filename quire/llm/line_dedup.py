"""Line dedup over every pair of neighbouring lines and every single long line, by line hashes.

This is not content-defined chunking, which misses most passages of two or three lines: a passage shorter than the distance of two
chosen boundaries holds no whole chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import among, filter_bitmaps, filter_blocks, filter_cells, filter_test, join_sized, sliced, stage, unstage

#: Lines of a window; the columns below hold two hashes, so it can't be another number.  Every line begins a window, so a passage is
#: the union of its windows, wherever it stands, and ends where windows stop being ones that occur elsewhere.
WINDOW = 2
#: A line of so many words, or so many bytes (scripts without blanks), is a passage by itself.
LONG_WORDS, LONG_BYTES = 50, 300
#: Bytes of a line's hash.
DIGEST = 16

_HASHES = ["a1", "a2", "b1", "b2"]


def line_hash(line: bytes, digest: int = DIGEST) -> tuple[int, int]:
    d = hashlib.blake2b(line, digest_size=digest).digest().ljust(16, b"\0")
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def windows(lines: list[bytes], digest: int = DIGEST) -> list[tuple[int, int, int, int, int, int]]:
    """(first line, number of lines, hash of the first, hash of the second or zeros): neighbouring lines, and long single ones."""
    hashes = [line_hash(x, digest) for x in lines]
    out = [(k, WINDOW, *hashes[k], *hashes[k + 1]) for k in range(len(lines) - WINDOW + 1)]
    return out + [(k, 1, *hashes[k], 0, 0) for k, x in enumerate(lines) if len(x) >= LONG_BYTES or len(x.split()) >= LONG_WORDS]


def _table(digest: int):
    names = ["doc_id", "row", "first", "n", *_HASHES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows: list[tuple[int, ...]] = []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if text.is_valid:
                    rows += [(doc, row, *w) for w in windows(text.as_py().encode().split(b"\n"), digest)]
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def _lines(digest: int):
    """(text) to (l1, l2, line): hash and bytes of its distinct lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            lines = {x for text in batch.column(0) for x in text.as_py().encode().split(b"\n")}
            hashes = [line_hash(x, digest) for x in lines]
            yield pa.record_batch([pa.array([h[0] for h in hashes], pa.int64()), pa.array([h[1] for h in hashes], pa.int64()), pa.array(list(lines), pa.binary())], names=["l1", "l2", "line"])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        texts, total, gone = [], [], []
        for text, drop in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            raw = text.as_py()
            lines = raw.split("\n") if raw is not None else []
            cut = {k for d in drop or () for k in range(d["first"], d["first"] + d["n"])}
            total.append(len(lines))
            gone.append(len(cut))
            texts.append(raw if not cut else "\n".join(x for k, x in enumerate(lines) if k not in cut))
        yield pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_removed", "text"])


def drop_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: int = DIGEST) -> DataFrame:
    """(doc_id, n_lines, n_removed, text): each text without passages that occur before it, here or elsewhere.

    A passage is two or more lines in a row, or a long one (see windows()); all of its lines go, wherever it begins and
    whatever stands around it.  The occurrence of a window with the smallest (id, hash of the text, line) is the first; it
    may lose a line only to a passage that occurs before it, so every line stays somewhere.  A row is known by its id and
    text: rows that repeat an id with other texts are rows of their own, and rows equal in both get equal results.
    Null text has no lines and stays null; rows with a null id keep all lines and are not compared.  An empty table gives
    an empty result.

    Repeats are found by 128-bit line hashes.  Then the bytes are compared: a hash that stands for two different lines
    anywhere is found by distinct (hash, line) pairs, which combine where they are made, and windows with such a line stay.
    What shuffles are window hashes and the distinct lines of repeated windows; whole texts only where a line goes.
    Occurrences of one window are never gathered: they meet one row of the first occurrence, hot windows in a broadcast.
    """
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(id_col).cast("long"), text).alias("row"), text.alias("text"))
    known = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    table = stage(known.mapInArrow(_table(digest), "doc_id long, row long, first long, n long, a1 long, a2 long, b1 long, b2 long"), "windows")
    place = F.min(F.struct("doc_id", "row", "first"))
    leads = table.groupBy("n", *_HASHES).agg(place.alias("f"), F.count(F.lit(1)).alias("size")).where("size > 1")
    leads = stage(leads, "leads")
    again = join_sized(table, leads, ["n", *_HASHES], "size", table.count()).where("doc_id <> f.doc_id OR row <> f.row OR first <> f.first")
    again = stage(again.select("doc_id", "row", "first", "n", *_HASHES, "f"), "again")
    drop = _compared(again, leads, known, digest)
    # a line said three times in a row: the second window overlaps the first, whose lines stay
    own = (F.col("doc_id") == F.col("f.doc_id")) & (F.col("row") == F.col("f.row"))
    start = F.when(own, F.greatest("first", F.col("f.first") + F.col("n"))).otherwise(F.col("first"))
    gone = drop.select("doc_id", "row", start.alias("first"), (F.col("first") + F.col("n") - start).cast("int").alias("n"))
    drop = stage(gone.groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "n")).alias("drop")), "drop")
    for t in (table, leads, again):
        unstage(t)
    tested = among(rows, "row", drop.select("row"), drop.count())
    passed = tested.where("NOT __q_in").select("doc_id", "text", F.lit(None).cast(drop.schema["drop"].dataType).alias("drop"))
    hit = tested.where("__q_in").join(drop, ["doc_id", "row"], "left").select("doc_id", "text", "drop")
    return passed.unionByName(hit).mapInArrow(_without, "doc_id long, n_lines long, n_removed long, text string")


def _compared(again: DataFrame, leads: DataFrame, rows: DataFrame, digest: int) -> DataFrame:
    """The windows of ``again`` whose lines are, byte for byte, all lines of their hashes."""
    ids = again.select("row").unionByName(leads.select(F.col("f.row").alias("row"))).distinct()
    holders = among(rows, "row", ids, ids.count()).where("__q_in").select("text")
    wanted = stage(leads.select(F.inline(F.array(F.struct(F.col("a1").alias("l1"), F.col("a2").alias("l2")), F.struct(F.col("b1").alias("l1"), F.col("b2").alias("l2"))))).distinct(), "wanted")
    blocks = filter_blocks(wanted.count())
    h = F.xxhash64("l1", "l2").alias("__q_h")
    made = holders.mapInArrow(_lines(digest), "l1 long, l2 long, line binary").select("*", h)
    lines = filter_test(made, filter_bitmaps(filter_cells(wanted.select(h), blocks)), blocks, "__q_in").where("__q_in").select("l1", "l2", "line").distinct()
    unlike = stage(lines.groupBy("l1", "l2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("l1", "l2"), "unlike")
    out = again
    for a, b in (("a1", "a2"), ("b1", "b2")):
        out = out.join(unlike, (F.col(a) == F.col("l1")) & (F.col(b) == F.col("l2")), "left_anti")
    unstage(wanted)
    return out
