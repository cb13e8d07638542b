"""Chat formatting with loss masks aligned to token offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.common import sliced

#: Marks of the template.  A turn is OPEN role MIDDLE text CLOSE.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this and of other common templates, which texts must not smuggle in.
CONTROL = (OPEN, MIDDLE, CLOSE, "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ESCAPE = "\\"
_ESCAPED = re.compile("|".join(map(re.escape, (ESCAPE, *sorted(CONTROL, key=len, reverse=True)))))
_UNESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(f"{re.escape(OPEN)}(.*?){re.escape(MIDDLE)}(.*?){re.escape(CLOSE)}", re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes, and puts one after the first character of every control string."""
    return _ESCAPED.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    """The inverse of ``escape``: no escaped control string has a backslash of its own."""
    return _UNESCAPED.sub(r"\1", text)


class Rendered(NamedTuple):
    text: str
    spans: list[tuple[int, int]]  # of the turns' texts, ascending
    roles: list[str]


def render(turns: list[tuple[str | None, str | None]]) -> Rendered:
    """The whole conversation as one string, with each turn's span."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role or '')}{MIDDLE}", escape(text or "")
        spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at = spans[-1][1] + len(CLOSE)
    return Rendered("".join(parts), spans, [r or "" for r, _ in turns])


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, read back from the string."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    made.add_special_tokens([OPEN, MIDDLE, CLOSE])
    return made


def mask_of(offsets: Sequence[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """For each token 1 if its offsets lie in one of the ascending, disjoint spans: found by binary search over token starts and ends."""
    at = np.asarray(offsets, np.int32).reshape(-1, 2)
    mask = np.zeros(len(at), np.int32)
    if spans:
        edges = np.asarray(spans, np.int32)
        for a, b in zip(np.searchsorted(at[:, 0], edges[:, 0], "left"), np.searchsorted(at[:, 1], edges[:, 1], "right"), strict=True):
            mask[a:b] = 1
    return mask


_COLUMNS = "conv_id long, n_turns long, formatted string, ids array<int>, mask array<int>, starts array<int>, ends array<int>"


#: Conversations that become Python objects at a time, and tokens after which a batch of results leaves the worker.
SOME, TOKENS = 32, 200_000


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))


def _format(path: str, loss_roles: tuple[str, ...]):
    """Encodes one conversation after the other and keeps arrays only: the library's encodings take over 100 bytes a token."""

    def coded(tokenizer: Tokenizer, turns: list[dict]) -> tuple:
        made = render([(t["role"], t["text"]) for t in turns])
        code = tokenizer.encode(made.text, add_special_tokens=False)
        offsets = np.array(code.offsets, np.int32).reshape(-1, 2)
        mask = mask_of(offsets, [s for s, r in zip(made.spans, made.roles, strict=True) if r in loss_roles])
        return len(made.spans), made.text, np.array(code.ids, np.int32), mask, offsets[:, 0], offsets[:, 1]

    def packed(ids: list, rows: list[tuple]) -> pa.RecordBatch:
        n, texts, *lists = zip(*rows, strict=True)
        columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(texts, pa.string()), *map(_lists, lists)]
        return pa.record_batch(columns, names=["conv_id", "n_turns", "formatted", "ids", "mask", "starts", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in sliced(batches, SOME):
            ids, rows, weight = [], [], 0
            for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows.append(coded(tokenizer, turns.as_py()))
                ids.append(conv)
                weight += len(rows[-1][2])
                if weight > TOKENS:
                    yield packed(ids, rows)
                    ids, rows, weight = [], [], 0
            if rows:
                yield packed(ids, rows)

    return run


def format_chats(turns: DataFrame, vocabulary: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: the formatted string, token ids, loss mask and token offsets (in code points).

    Rows are ordered by turn, of equal turns by role and text; null roles and texts count as empty; rows with a null
    id form one conversation.  A conversation is encoded once and whole, so it must fit into a worker's memory.
    The marks are added tokens, so no token crosses the edge of a turn's text.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    grouped = turns.groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    return grouped.mapInArrow(_format(vocabulary, tuple(loss_roles)), _COLUMNS)


def masked_text(formatted: str, mask: Sequence[int], starts: Sequence[int], ends: Sequence[int]) -> str:
    """The text under the mask.  Tokens of one character's bytes share its offsets; it counts once."""
    keep = np.flatnonzero(np.asarray(mask))
    if not len(keep):
        return ""
    at, until = np.asarray(starts)[keep], np.maximum.accumulate(np.asarray(ends)[keep])
    heads = np.flatnonzero(np.append(True, at[1:] > until[:-1]))  # of runs without a gap
    tails = np.append(heads[1:], len(keep)) - 1
    return unescape("".join(formatted[a:b] for a, b in zip(at[heads].tolist(), until[tails].tolist(), strict=True)))
