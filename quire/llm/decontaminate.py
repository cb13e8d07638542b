"""Benchmark decontamination by pigeonhole edit matching, verified with Myers' bit-parallel distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import sliced, stage

#: Edits allowed per character of an item.
RATE = 0.08
#: Bytes of item text that one pass over the documents holds; larger benchmarks take more passes.
BLOCK_BYTES = 8_000_000
_GAP = re.compile(r"[\W_]+")


def normalise(text: str | None) -> str:
    """Lower case; each run of anything but letters and digits is one space, none at the ends."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(start, text) of budget + 1 pieces that cover the item; one of them is unharmed by any ``budget`` edits."""
    n = budget + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def best_match(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """(least edit distance of the item to a substring of text, end of the first such substring), bit-parallel over the item.

    ``masks``: for each character the bits of its places in the item.
    """
    every, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = every, 0, size
    best, at = size, 0
    for k, c in enumerate(text):
        eq = masks.get(c, 0)
        low = eq | minus
        hit = (((eq & plus) + plus) ^ plus) | eq
        up = minus | ~(hit | plus)
        down = plus & hit
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        if score < best:
            best, at = score, k + 1
        up = (up << 1) & every  # a match may start anywhere: no carry into the first row
        plus = ((down << 1) | ~(low | up)) & every
        minus = up & low
    return best, at


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float = RATE) -> None:
        self.items: list[tuple[int, str, int, dict[str, int]]] = []
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, raw in items:
            text = normalise(raw)
            if not text:
                continue
            budget = int(len(text) * rate)
            masks: dict[str, int] = {}
            for k, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << k
            for start, piece in pieces(text, budget):
                at.setdefault(piece, []).append((len(self.items), start + len(piece)))
            self.items.append((item_id, text, budget, masks))
        self.match = ahocorasick.Automaton()
        for piece, places in at.items():
            self.match.add_word(piece, places)
        if at:
            self.match.make_automaton()

    def __call__(self, raw: str | None) -> list[tuple[int, int, int, int, int]]:
        """(item, distance, budget, start and end in the normalised text) for each item found in a text: its best match."""
        text = normalise(raw)
        if not self.items or not text:
            return []
        seen: dict[int, set[int]] = {}
        for end, places in self.match.iter(text):
            for k, piece_end in places:
                seen.setdefault(k, set()).add(end + 1 - piece_end)  # where the item would start
        out = []
        for k, begins in seen.items():
            item_id, item, budget, masks = self.items[k]
            best = None
            exact = next((b for b in sorted(begins) if b >= 0 and text.startswith(item, b) and (budget or self._whole(text, b, b + len(item)))), None)
            if exact is not None:
                best = (0, exact, exact + len(item))
            elif budget:
                # windows that overlap are one, so no part of the text is gone over twice
                spans: list[list[int]] = []
                for begin in sorted(begins):
                    a, b = max(0, begin - budget), begin + len(item) + budget
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = b
                    else:
                        spans.append([a, b])
                for a, b in spans:
                    distance, end = best_match(masks, len(item), text[a:b])
                    if distance <= budget and (best is None or distance < best[0]):
                        best = (distance, max(0, a + end - len(item)), a + end)
            if best is not None:
                out.append((item_id, best[0], budget, best[1], best[2]))
        return sorted(out)

    @staticmethod
    def _whole(text: str, a: int, b: int) -> bool:
        """Does [a, b) start and end at word edges?"""
        return (a <= 0 or text[a - 1] == " ") and (b >= len(text) or text[b] == " ")


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of bounded size; the driver holds one at a time.  The last may be empty."""
    block, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct().orderBy("i", "t").toLocalIterator():
        if size + len(r["t"]) > block_bytes and block:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    yield block


def _find(block: list[tuple[int, str]], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(block, rate)
        for batch in sliced(batches):
            found = [(k, *m) for k, x in enumerate(batch.column(1)) for m in matcher(x.as_py())]
            if found:
                cols = list(zip(*found, strict=True))
                yield pa.record_batch([batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", "item_id", "distance", "budget", "start", "end"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, budget, start, end): the best match of every item within its error budget.

    Texts and items are normalised (``normalise``); an item of n characters has a budget of ``rate`` * n edits, found
    anywhere in the whole text; a budget of 0 asks for whole words.  Null or empty texts and items match nothing.
    Rows that repeat an id are searched each.  Documents are read once per block of items and not shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = last = None
    for block in item_blocks(items, block_bytes=block_bytes):
        made = rows.mapInArrow(_find(block, rate), "doc_id long, item_id long, distance long, budget long, start long, end long")
        if last is not None:  # more than one block: what a block finds is written before the next one is read
            kept = stage(last, "leaks")
            out = kept if out is None else out.unionByName(kept)
        last = made
    return last if out is None else out.unionByName(last)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with its columns.  No shuffle."""
    first = True
    for block in item_blocks(items, block_bytes=block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for batch in sliced(batches):
                keep = [not matcher(x.as_py()) for x in batch.column(batch.schema.get_field_index(text_col))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        # all blocks but the last are written at once, so that the plan holds one block
        docs = (docs if first else stage(docs, "clean")).mapInArrow(run, docs.schema)
        first = False
    return docs
