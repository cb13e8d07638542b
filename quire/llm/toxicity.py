"""Toxicity by a weighted lexicon: homoglyph and digit folding, Aho-Corasick, exception phrases, length normalisation."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import sliced, stage, unstage

#: Letters of other scripts, digits and signs that stand for Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ս": "u", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i",
}
#: Harmless phrases that hold a word which may be in the lexicon.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "class clown", "pond scum", "soap scum", "worthless check")
#: Labelled texts of either label that a training sample takes, in expectation, by hash of the id.
SAMPLE = 6000
_WORD = re.compile(r"[^\W_]+")
_FULL_WIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_TABLE = str.maketrans(HOMOGLYPHS) | _FULL_WIDTH
_PLAIN = str.maketrans({k: v for k, v in HOMOGLYPHS.items() if k not in "0134578@$!"}) | _FULL_WIDTH
_MIXED = re.compile(r"(?<![\w@$!])(?=[\w@$!]*[^\W\d_])[\w@$]*[0134578@$!][\w@$!]*\w")


def fold(text: str) -> str:
    """Lower case, with homoglyphs as Latin letters, and digits and signs too inside words that have letters; same length."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c) == 1 else x for x, c in zip(text, map(str.lower, text), strict=True))
    if not low.isascii():
        low = low.translate(_PLAIN)
    return _MIXED.sub(lambda m: m[0].translate(_TABLE), low)


class Lexicon(NamedTuple):
    """weights: folded words, or stems (ending in ``*``, which match at a word's start).  bias, by_sum, by_rate: calibration."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    bias: float = -3.0
    by_sum: float = 2.0
    by_rate: float = 0.5


class Scorer:
    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.match = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            word = fold(term.rstrip("*"))
            if word:
                self.match.add_word(word, (len(word), weight, term.endswith("*")))
        for phrase in lexicon.exceptions:
            p = fold(phrase)
            self.match.add_word(p, (len(p), -1.0, False))
        self.any = len(self.match) > 0
        if self.any:
            self.match.make_automaton()

    def features(self, text: str) -> tuple[float, int]:
        """(sum of the weights that count, number of words).  A hit inside an exception phrase, or inside a longer hit, doesn't count."""
        low = fold(text)
        hits = []
        for end, (size, weight, stem) in self.match.iter(low) if self.any else ():
            a, b = end - size + 1, end + 1
            if (a and low[a - 1].isalnum()) or (not stem and b < len(low) and low[b].isalnum()):
                continue
            hits.append((a, -b, weight))
        total, until = 0.0, -1
        hits.sort()
        for a, b, weight in hits:
            if -b <= until:
                continue
            until = -b
            if weight > 0:
                total += weight
        return total, low.count(" ") + low.count("\n") + 1

    def __call__(self, text: str | None) -> float:
        total, words = self.features(text or "")
        return self.calibrated(total, words)

    def calibrated(self, total: float, words: int) -> float:
        x = self.lexicon.bias
        if total > 0:
            x += self.lexicon.by_sum * math.log1p(total) + self.lexicon.by_rate * math.log1p(100 * total / words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def _terms(low: int, high: int):
    """(text, toxic) rows to (term, bad, good): in how many texts a word of any length, or a stem of ``low`` to ``high`` letters, occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            count: dict[str, list[int]] = {}
            for text, bad in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                words = set(_WORD.findall(fold(text.as_py() or "")))
                terms = words | {w[:k] + "*" for w in words for k in range(low, min(high, len(w) - 1) + 1)}
                for t in terms:
                    count.setdefault(t, [0, 0])[0 if bad else 1] += 1
            keys = list(count)
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array([count[k][0] for k in keys], pa.int64()), pa.array([count[k][1] for k in keys], pa.int64())], names=["term", "bad", "good"])

    return run


def _feature_rows(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(lexicon)
        for batch in sliced(batches):
            made = [score.features(x.as_py() or "") for x in batch.column(0)]
            yield pa.record_batch([pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.int64()), batch.column(1)], names=["total", "words", "toxic"])

    return run


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", sample: int = SAMPLE, stem: tuple[int, int] = (4, 7)) -> Lexicon:
    """A lexicon from texts and their 0/1 labels (other labels and null ids are left out).

    Takes about ``sample`` labels of either kind by hash of the id (all where there are fewer): so few that they are
    broadcast to the texts, which don't shuffle.  Counts in how many texts of each label every folded word, of any length, and every
    word stem of ``stem`` letters occurs; keeps all terms that are in three label-1 texts and 0.3 % of them at least and rare in
    label-0 texts, weighted by log odds; then fits the calibration on the same sample.  To the driver come those terms and three
    numbers a sampled text: the sample bounds both, since a term costs its texts an occurrence each.  Without both labels the lexicon is empty.
    """
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic IN (0, 1) AND id IS NOT NULL").distinct()
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon({}, bias=-3.0)
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    chance = F.shiftrightunsigned(F.xxhash64("id", F.lit("toxic")), 11).cast("double") / float(1 << 53)
    chosen = F.broadcast(rows.where(chance < share))
    picked = stage(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id").select("text", "toxic"), "labelled")
    n = {r["toxic"]: r["n"] for r in picked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Lexicon({}, bias=-3.0)
    counted = picked.mapInArrow(_terms(*stem), "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.ln((F.col("bad") + 0.5) / (n[1] + 1.0)) - F.ln((F.col("good") + 0.5) / (n[0] + 1.0))
    least = max(3, round(0.003 * n[1]))
    strong = counted.where(F.col("bad") >= least).withColumn("odds", odds).where("odds > 3")
    found = {r["term"]: (r["bad"], r["good"], r["odds"]) for r in strong.collect()}
    weights: dict[str, float] = {}
    for term, (bad, _good, weight) in sorted(found.items(), key=lambda x: (len(x[0]), x[0])):
        word = term.rstrip("*")
        shorter = [found[word[:k] + "*"] for k in range(1, len(word) + (not term.endswith("*"))) if word[:k] + "*" in weights]
        if shorter:  # a stem that is kept already covers it
            continue
        # a stem earns its place only if it is found in clearly more texts than each word it covers
        if term.endswith("*") and max([x[0] for t, x in found.items() if not t.endswith("*") and t.startswith(word)], default=0) >= 0.9 * bad:
            continue
        weights[term] = min(weight, 8.0) / 4
    lexicon = Lexicon(weights)
    data = picked.mapInArrow(_feature_rows(lexicon), "total double, words long, toxic int").collect()
    unstage(picked)
    return calibrate(lexicon, np.array([[r["total"], r["words"]] for r in data]), np.array([r["toxic"] for r in data]), sizes[1] / (sizes[0] + sizes[1]), n[1] / (n[0] + n[1]))


def calibrate(lexicon: Lexicon, x: np.ndarray, y: np.ndarray, share: float, sampled_share: float) -> Lexicon:
    """Logistic fit of (bias, log of the sum, log of the rate per 100 words) by Newton steps, with the sample's label share undone."""
    w = np.where(y == 1, share / sampled_share, (1 - share) / (1 - sampled_share))
    f = np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(100 * x[:, 0] / x[:, 1])])
    b = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(f @ b).clip(-30, 30)))
        g = f.T @ (w * (y - p)) - 0.02 * len(x) * np.array([0.01, 0.01, 0.01]) * b
        h = (f * (w * p * (1 - p))[:, None]).T @ f + np.eye(3) * 0.0002 * len(x)
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return lexicon._replace(bias=float(b[0]), by_sum=float(b[1]), by_rate=float(b[2]))


def _score(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(lexicon)
        for batch in sliced(batches):
            yield pa.record_batch([batch.column(0), pa.array([score(x.as_py()) for x in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score in [0, 1]) of whole texts; null text counts as empty.  No shuffle."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(lexicon), "doc_id long, score double")
