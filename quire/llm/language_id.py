"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import sliced

#: Length of a profile, and of the part of a document's own ranking that is compared with it.
TOP = 400
#: A training sample takes so many labelled texts of a language, in expectation, by hash of the id.
SAMPLE = 1500
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point: its lower-case letter, or a space."""
    every = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            every[i] = ord(low) if len(low) == 1 else i
    return every


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of a whole text's 1- to 3-grams of letters, words padded by a space; keys ascend."""
    points = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]]).astype(np.int64)
    gap = points == 32
    points = points[~(gap & np.append(False, gap[:-1]))]  # runs of spaces become one
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = points == 32
    two = points[:-1] | points[1:] << 21
    three = two[:-1] | points[2:] << 42
    return np.unique(np.concatenate([points[~gap], two, three[~gap[1:-1]]]), return_counts=True)


def ranking(keys: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The most frequent keys, in order; of equally frequent ones the smaller key first."""
    if len(keys) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))[:top]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) rows to (lang, key, n) counts."""
    for batch in sliced(batches):
        parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            keys, counts = ngrams(text.as_py() or "")
            parts.setdefault(lang, []).append((keys, counts))
        for lang, found in parts.items():
            keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n)], names=["lang", "key", "n"])


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, top: int = TOP, most_langs: int = 500) -> dict[str, list[int]]:
    """A profile (ranked n-gram keys) for each non-null language of labelled ``docs``.

    Counts all texts of a sample of about ``sample`` texts a language, chosen by hash of the id (all of them where
    there are fewer).  To the driver come ``top`` keys a language; more than ``most_langs`` languages are an error.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_langs + 1).collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"over {most_langs} languages")
    if not sizes:
        return {}
    share = F.coalesce(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))])[F.col("lang")], F.lit(0.0))
    chance = F.shiftrightunsigned(F.xxhash64("id", F.lit("language")), 11).cast("double") / float(1 << 53)
    counted = rows.where(chance < share).select("lang", "text").mapInArrow(_counts, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    best = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("rank") <= top)
    profiles: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["key"])
    return profiles


class Judge:
    """Compares texts with profiles by out-of-place distance."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP) -> None:
        self.langs = sorted(profiles)
        self.top = top
        self.keys = np.unique(np.concatenate([np.asarray(profiles[x], np.int64) for x in self.langs])) if self.langs else np.zeros(0, np.int64)
        # the rank of each key in each profile; one more row for keys in none
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), top, np.int64)
        self.known = np.zeros(self.ranks.shape, bool)
        for k, lang in enumerate(self.langs):
            at = np.searchsorted(self.keys, np.asarray(profiles[lang], np.int64))
            self.ranks[at, k] = np.arange(len(at))
            self.known[at, k] = True

    def __call__(self, text: str | None) -> tuple[str, float]:
        keys = ranking(*ngrams(text or ""), self.top)
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.keys, keys).clip(max=max(len(self.keys) - 1, 0))
        at = np.where(self.keys[at] == keys, at, len(self.keys))
        place = np.arange(len(keys))[:, None]
        distance = np.where(self.known[at], np.abs(self.ranks[at] - place), self.top).sum(0)
        best = int(distance.argmin())  # of equal distances the first language by name
        return self.langs[best], float(1 - distance[best] / (self.top * len(keys)))


def _predict(profiles: dict[str, list[int]], top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, top)
        for batch in sliced(batches):
            found = [judge(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(doc_id, lang_pred, score in [0, 1]) from whole texts; ``und`` and 0 for null text, text without letters or no profiles."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_predict(profiles, top), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", top: int = TOP) -> DataFrame:
    """The rows of ``docs`` whose language is found: those predicted ``und`` go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles, top)
        for batch in sliced(batches):
            keep = [judge(x.as_py())[0] != UNKNOWN for x in batch.column(batch.schema.get_field_index(text_col))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod == rest, F.lit(False))
