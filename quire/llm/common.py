"""Shared helpers: shared-folder staging, Arrow text access and byte-vectorised word hashing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager, nullcontext
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.tables import spread

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
_GOLDEN = 0x9E3779B97F4A7C15


# --- staging ---------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests) gets a temporary folder; a cluster raises, since executors don't share one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local()


@lru_cache(maxsize=1)
def _local() -> str:
    return tempfile.mkdtemp(prefix="quire-")


_roots: dict[str, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _root(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{shared_dir(spark).rstrip('/')}/quire-{app}"

        def clean() -> None:
            try:
                _delete(spark, _roots[app])
            except Exception:  # the JVM has gone already
                pass

        atexit.register(clean)
    return _roots[app]


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_batch_lock = threading.Lock()
_batch_writers: list[str] = []


@contextmanager
def _batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches for Python workers hold at most ``most`` rows inside; afterwards the session has its own setting again.

    Writes that overlap in several threads share the small batches; the last one to end puts the setting back.
    """
    with _batch_lock:
        own = _batch_writers[0] if _batch_writers else spark.conf.get(_BATCH)
        _batch_writers.append(own)
        if int(own) <= 0 or int(own) > most:
            spark.conf.set(_BATCH, most)
    try:
        yield
    finally:
        with _batch_lock:
            _batch_writers.pop()
            if not _batch_writers:
                spark.conf.set(_BATCH, own)


#: Rows of whole texts that a Python worker gets at a time.
BATCH_ROWS = 1000


def stage(df: DataFrame, name: str, batch_rows: int | None = BATCH_ROWS) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet in the shared folder and reads it back, so a lost executor costs no recomputation.

    While it writes, Python workers get ``batch_rows`` rows at a time (None: as many as the session says): a split's whole
    texts in one batch would take several times their size in an executor.  A table that is staged already is returned as it is.
    """
    if getattr(df, "_quire_path", None):
        return df
    spark = df.sparkSession
    path = f"{_root(spark)}/{name}-{uuid.uuid4().hex}"
    with _batches(spark, batch_rows) if batch_rows else nullcontext():
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    path = getattr(df, "_quire_path", None)
    if path:
        _delete(df.sparkSession, path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


# --- blocked Bloom filters, with DataFrame functions only ----------------------

#: Cells in a block: what one bitmap of Spark's bitmap functions holds (4 KB).
BLOCK = 32768
PROBES = 2


def _probe(h: Column, k: int) -> Column:
    """The k-th cell of a hash in its block."""
    return F.shiftrightunsigned(h, 15 * k).bitwiseAND(F.lit(BLOCK - 1)).cast("int")


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(blocks)).cast("int")


def filter_blocks(n: int, cells_per_row: int = 16, max_blocks: int = 16384) -> int:
    """Blocks for n keys, under a fixed bound: beyond it a filter passes more than it need, but never less."""
    return min(max_blocks, n * cells_per_row // BLOCK + 1)


def filter_cells(keys: DataFrame, blocks: int) -> DataFrame:
    """The cells (__q_block, __q_cell) of each key's hash __q_h; one row per distinct cell of a key."""
    h = F.col("__q_h")
    return keys.select(_block(h, blocks).alias("__q_block"), F.explode(F.array_distinct(F.array(*[_probe(h, k) for k in range(PROBES)]))).alias("__q_cell"))


def filter_bitmaps(cells: DataFrame) -> DataFrame:
    return cells.groupBy("__q_block").agg(F.bitmap_construct_agg(F.col("__q_cell").cast("long")).alias("__q_bits"))


def filter_test(rows: DataFrame, bitmaps: DataFrame, blocks: int, out: str) -> DataFrame:
    """rows (with __q_h) plus ``out``: false only where the key is certainly not in the filter.

    Broadcast are at most ``max_blocks`` bitmaps of 4 KB: a bound that does not grow with the data.
    """
    tested = rows.withColumn("__q_block", _block(F.col("__q_h"), blocks)).join(F.broadcast(bitmaps), "__q_block", "left")
    hit = F.lit(True)
    for k in range(PROBES):
        cell = _probe(F.col("__q_h"), k)
        byte = F.conv(F.hex(F.substring("__q_bits", F.shiftright(cell, 3) + 1, F.lit(1))), 16, 10).cast("int")
        hit &= byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), cell.bitwiseAND(F.lit(7)))) != 0
    return tested.withColumn(out, F.coalesce(hit, F.lit(False))).drop("__q_block", "__q_bits")


def among(rows: DataFrame, key: str, keys: DataFrame, n: int, out: str = "__q_in") -> DataFrame:
    """rows plus ``out``: false only where ``key`` is certainly not in the one column of ``keys``.  Nothing but the keys' cells shuffles."""
    blocks = filter_blocks(n)
    cells = filter_cells(keys.select(F.xxhash64(F.col(keys.columns[0]).cast("long")).alias("__q_h")), blocks)
    return filter_test(rows.withColumn("__q_h", F.xxhash64(F.col(key).cast("long"))), filter_bitmaps(cells), blocks, out).drop("__q_h")


# --- joins with hot keys ---------------------------------------------------------

#: A key with more than 1 / HOT_SHARE of all rows is hot; there are at most HOT_SHARE such keys.
HOT_SHARE = 2000


def join_sized(rows: DataFrame, keyed: DataFrame, on: Sequence[str], size: str, total: int, how: str = "inner", hot_share: int = HOT_SHARE) -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row per key and in ``size`` the number of rows of that key.

    Keys with more than ``total`` / ``hot_share`` rows are joined from a broadcast, so no task gets all rows of such a key; the
    rest meets by a shuffle.  There are ``hot_share`` of them at most; the hashes of these few tell both sides apart, so a key
    that only shares such a hash is broadcast with them and nothing is lost.  Both tables are read twice: pass staged ones.
    """
    key = F.xxhash64(*on)
    hot = [r[0] for r in keyed.where(F.col(size) > total // hot_share + 1).select(key).distinct().collect()]
    if not hot:
        return rows.join(keyed, list(on), how)
    mine = key.isin(*hot)
    return rows.where(mine).join(F.broadcast(keyed.where(mine)), list(on), how).unionByName(rows.where(~mine).join(keyed.where(~mine), list(on), how))


# --- Arrow text ------------------------------------------------------------


def give_back() -> None:
    """Returns a process's free memory to the system, where its C library can: an idle worker would hold its peak."""
    trim = getattr(ctypes.pythonapi, "malloc_trim", None)
    if trim is not None:
        trim(0)


def sliced(batches: Iterator[pa.RecordBatch], most: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``most`` rows, so that what a worker makes of whole texts at a time stays small.

    Spark bounds the incoming ones by rows and bytes (spark.sql.execution.arrow.maxBytesPerBatch); slices copy nothing.
    After the last one the worker gives back what it no longer uses.
    """
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            yield batch.slice(a, most)
    give_back()


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty.  The bytes are not copied unless there are nulls."""
    if col.null_count:
        col = pc.fill_null(col, "")
    _, off, data = col.buffers()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(off, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def ranges(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (a longer row stands alone), so that working arrays stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


# --- hashing ---------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an unsigned array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def counter(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd 64-bit numbers."""
    start = np.uint64((seed * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLDEN) + start) | np.uint64(1)


_BYTE = counter(256, 11)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW_BYTE = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])
_place = counter(256, 23)


def _places(n: int) -> np.ndarray:
    global _place
    if n > len(_place):
        _place = counter(n + n // 4, 23)
    return _place


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the A-Z-lower-cased words ``[^\\x20\\x09-\\x0D]+`` of consecutive texts, and the number of words before each text.

    Runs on bytes: white space here is ASCII, which never occurs inside a longer UTF-8 sequence.
    """
    base, offs = int(offsets[0]), offsets - offsets[0]
    part = data[base : base + int(offs[-1])]
    if not len(part):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    word = ~_SPACE[part]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = offs[:-1][offs[:-1] < len(part)]
    first[heads] = word[heads]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    place = np.arange(at[0], len(part)) - np.repeat(at, np.diff(np.append(at, len(part))))
    tail = part[at[0] :]
    sums = np.add.reduceat(_LOW_BYTE[tail] * _places(int(place.max()) + 1)[place], at - at[0])
    return mix(sums), np.searchsorted(at, offs, "left")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles; of fewer words the whole sequence as one."""
    words, before = word_hashes(data, offsets)
    salts = counter(width + 1, 37)
    n = len(words) - width + 1
    if n > 0:
        rolled = np.zeros(n, np.uint64)
        for k in range(width):
            rolled += words[k : k + n] * salts[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            few = (words[a:b] * salts[: b - a]).sum(dtype=np.uint64, keepdims=True)
            few += np.array([b - a], np.uint64) * salts[width]
            out.append(mix(few))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

