"""Byte-level BPE by backtracking over Aho-Corasick matches; decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from tokenizers import pre_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import give_back, sliced

#: Fixed value: the split of byte-level tokenizers.  Letters stand first, being most frequent; no other branch can start with one.
PATTERN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept with their ids by each worker, and the longest piece (in characters) worth keeping.
CACHE, CACHED_CHARS = 220_000, 48
_NEVER = 1 << 60


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _pack(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Newer(Exception):
    """A piece holds a character that only newer Unicode tables class as a letter or digit."""


@lru_cache(maxsize=1)
def _newer() -> frozenset[str]:
    """The letters and digits of this process's Unicode tables that the tokenizers library's tables don't know."""
    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    every = "".join(map(chr, (*range(0x20, 0xD800), *range(0xE000, 0x110000))))
    recent = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    odd = [c for c in recent if len(split.pre_tokenize_str("a" + c)) == 2 and len(split.pre_tokenize_str("1" + c)) == 2]
    return frozenset(odd)


class Bpe(dict):
    """An encoder and decoder of one vocabulary.  As a dict it maps a piece of text to its ids (packed, little-endian)."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]) -> None:
        super().__init__()
        value = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda t: bytes(value[c] for c in t)
        self.added = added
        self.split_added = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pieces = regex.compile(PATTERN)
        self.newer = _newer()
        if self.newer:
            odd = "[" + "".join(map(regex.escape, sorted(self.newer))) + "]"
            old = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|{odd})")
            old = old.replace(r"?\p{L}+", rf"?[\p{{L}}--{odd}]+").replace(r"?\p{N}+", rf"?[\p{{N}}--{odd}]+")
            self.old_pieces = regex.compile(old, regex.V1)
        # arrays by token and pairs as one number: objects in each of them would take several times the memory, in every worker
        most = self.most = max([-1, *vocab.values(), *added.values()]) + 1
        self.pair_rank: dict[int, int] = {}
        self.made_of = (array("i", [-1]) * most, array("i", [-1]) * most)
        self.made_at = array("q", [_NEVER]) * most
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pair_rank.setdefault(x * most + y, rank)
            if self.made_at[z] == _NEVER:
                self.made_of[0][z], self.made_of[1][z], self.made_at[z] = x, y, rank
        texts = {i: raw(t) for t, i in vocab.items() if all(c in value for c in t) and t not in added}
        table = texts | {i: raw(a) if all(c in value for c in a) else a.encode() for a, i in added.items()}
        self.match = ahocorasick.Automaton()
        for i, t in texts.items():
            if len(t) == 1 or self.made_at[i] < _NEVER:
                self.match.add_word(t.decode("latin-1"), i)
        self.match.make_automaton()
        self.size = array("i", [0]) * most
        # of each token the longest other token that it starts with, or -1
        self.shorter = array("i", [-1]) * most
        of = {t: i for i, t in texts.items() if len(t) == 1 or self.made_at[i] < _NEVER}
        for i, t in texts.items():
            self.size[i] = len(t)
            self.shorter[i] = next((of[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in of), -1)
        sizes = np.zeros(most, np.int64)
        for i, t in table.items():
            sizes[i] = len(t)
        self.sizes, self.starts = sizes, np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.blob = np.frombuffer(b"".join(table.get(i, b"") for i in range(most)), np.uint8)
        self._fits: dict[int, bool] = {}
        self.older: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> Iterator[tuple[int, int]]:
        """The parts of a token that touch its left (0) or right (1) edge, each with the rank at which it becomes part of more."""
        until, part, made = _NEVER, self.made_of[side], self.made_at
        while token >= 0:
            yield token, until
            until, token = made[token], part[token]

    def fits(self, a: int, b: int) -> bool:
        """The pair-compatibility table, filled as asked: would the merges leave tokens a, b side by side as they are?

        They would not if some pair of parts that meet at the seam merges before either part is used up.  Of pairs
        of equal rank the left one merges first.
        """
        known = self._fits.get(a * self.most + b)
        if known is None:
            known = True
            right = list(self._spine(b, 0))
            for x, x_until in self._spine(a, 1):
                for y, y_until in right:
                    rank = self.pair_rank.get(x * self.most + y)
                    if rank is not None and rank < x_until and rank <= y_until:
                        known = False
            if len(self._fits) > 260_000:
                self._fits.clear()
            self._fits[a * self.most + b] = known
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one piece: longest matches first, stepping back to shorter ones where neighbours don't fit.

        Where nothing fits the last token, the place is dead: that token gives way to its next shorter prefix.
        """
        text = piece.encode().decode("latin-1")
        if not text:
            return []
        n, sizes, shorter, known, most = len(text), self.size, self.shorter, self._fits, self.most
        out: list[int] = []
        dead: set[int] = set()
        at, last, matches, follows = 0, -1, self.match.iter_long(text), True
        token = next(matches)[1]
        while True:
            while token >= 0:
                if at + sizes[token] not in dead:
                    if last < 0:
                        break
                    ok = known.get(last * most + token)
                    if ok or (ok is None and self.fits(last, token)):
                        break
                token, follows = shorter[token], False
            if token >= 0:
                out.append(token)
                at += sizes[token]
                if at == n:
                    return out
                last = token
                if not follows:  # the longest matches from here on are others
                    matches, follows = self.match.iter_long(text, at), True
                token = next(matches)[1]
            else:
                if not out:
                    raise ValueError("text has bytes that the vocabulary lacks")
                dead.add(at)
                gone = out.pop()
                at -= sizes[gone]
                token, follows = shorter[gone], False
                last = out[-1] if out else -1

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is not None:
            self._keep(piece, packed)
            return packed
        if not (piece.isascii() or self.newer.isdisjoint(piece)):  # a pattern of that many characters would take longer than the merges
            raise _Newer
        packed = _pack(self.encode_piece(piece))
        if len(piece) <= CACHED_CHARS:
            self._keep(piece, packed)
        return packed

    def _keep(self, piece: str, packed: bytes) -> None:
        """Two generations: pieces that are asked for again outlive the change."""
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        self[piece] = packed

    def forget(self) -> None:
        """Drops the pieces and pairs met so far: a worker that goes on to other work would hold them idle."""
        for met in (self, self.older, self._fits):
            met.clear()
        give_back()

    def _packed(self, text: str) -> bytes:
        try:
            return b"".join(map(self.__getitem__, self.pieces.findall(text)))
        except _Newer:
            return b"".join(_pack(self.encode_piece(x)) for x in self.old_pieces.findall(text))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        if not any(a in text for a in self.added):
            return np.frombuffer(self._packed(text), "<u4")
        parts = self.split_added.split(text)
        return np.frombuffer(b"".join(_pack([self.added[x]]) if k % 2 else self._packed(x) for k, x in enumerate(parts)), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 of ids: each token's bytes copied from one blob by its start and size; broken sequences become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.blob[np.arange(total) + np.repeat(self.starts[ids] - (ends - sizes), sizes)].tobytes()
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """The vocabulary of a tokenizers JSON file, once per worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return Bpe(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])})


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in sliced(batches):
            texts, ids, n_rows, weight = batch.column(1), [], 0, 0
            for row in range(len(texts)):
                made = bpe.encode(texts[row].as_py() or "").tobytes()
                ids.append(made)
                weight += len(made)
                if weight > 8_000_000 or row == len(texts) - 1:
                    yield pa.record_batch([batch.column(0)[n_rows : row + 1], pa.array(ids, pa.binary())], names=["doc_id", "ids"])
                    ids, n_rows, weight = [], row + 1, 0
        bpe.forget()

    return run


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): every whole text as token ids, packed as little-endian unsigned 32-bit integers.

    Null text counts as empty and gives no ids.  Strings of added tokens in a text become those tokens.  No shuffle.
    ``vocabulary``: a tokenizers JSON file of a byte-level BPE at a path that every executor has.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encode(vocabulary), "doc_id long, ids binary")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in sliced(batches):
            texts = [bpe.decode(np.frombuffer(x.as_py() or b"", "<u4")).decode() for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of packed ids; null ids count as none."""
    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(_decode(vocabulary), "doc_id long, text string")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in sliced(batches):
            n, a, b = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return run


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every whole text encoded, and its ids decoded again, in one pass of one worker."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_digests(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
