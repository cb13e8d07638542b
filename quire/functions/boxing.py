"""A text over several boxes: a greedy start by shares and capacities, then boundaries of overfull boxes move back.

Costs are prefix sums, so every candidate cut of a box is scored at once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
TOKEN = re.compile(r"(<[futnvc]\d+-[0-9a-z]{3}/>|\[\[FORMULA_\d+]]|\$(?!\s)(?:\\.|[^$\n]){1,240}?\$|\s+|[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*|[一-鿿]|.)", re.DOTALL)
MATH_TOKEN = re.compile(r"(?<!\\)\$(?:\\.|[^$\\\n])+(?<!\\)\$|\s+|[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*|[一-鿿]|.", re.DOTALL)
FORMULA = re.compile(r"<[futnvc]\d+-[0-9a-z]{3}/>|\[\[FORMULA_\d+]]|\$(?!\s)(?:\\.|[^$\n]){1,240}?\$")
WORD = re.compile(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*")
STYLE_COMMAND = re.compile(r"\\(?:left|right|mathrm|mathbf|mathit|mathsf|mathtt|text|operatorname|displaystyle|textstyle|scriptstyle|scriptscriptstyle)\b")
STOPS = (".", "。", "!", "！", "?", "？", ";", "；", ":", "：", ",", "，")
REACH, FILL, OVER, FUTURE_OVER, UNDER, UNDER_WEIGHT, NO_STOP = 24, 0.98, 1.01, 1.03, 0.55, 0.1, 1.25
OVERFLOW = {True: (28.0, 140.0), False: (72.0, 108.0)}
PASSES, WINDOW, SETTLED, TRIGGER, MOVE_NO_STOP, LEAST_MOVE, RATIO_GAP, RATIO_WEIGHT = 3, 80, 3.5, 12.0, 1.75, 18.0, 0.08, 6.0
# -----------------------------------------------------------------------------


def formula_length(formula: str) -> int:
    """Visible signs of a formula: style commands count nothing, other commands one; a formula without any counts by its characters."""
    seen = re.sub(r"\s+", "", re.sub(r"\\[A-Za-z]+", "x", STYLE_COMMAND.sub("", formula)).replace("{", "").replace("}", "").replace("~", ""))
    return len(seen) or len(re.sub(r"\s+", "", formula))


def token_cost(token: str, formulas: dict[str, str]) -> float:
    """Width in full-width units; ``formulas`` tells what tokens stand for."""
    if token.isspace():
        return max(0.2, len(token) * 0.25)
    if FORMULA.fullmatch(token):
        return max(1.35, formula_length(formulas.get(token, token.strip("$"))) * 0.42)
    if WORD.fullmatch(token):
        return max(1.0, len(token) * 0.55)
    return 1.0 if "一" <= token <= "鿿" and len(token) == 1 else 0.45


class _Text:
    """Tokens with prefix costs; ``stop(a, p)``: does the last visible token of a to p end in punctuation?"""

    def __init__(self, tokens: list[str], formulas: dict[str, str]) -> None:
        self.tokens, self.n = tokens, len(tokens)
        self.before = np.concatenate([[0.0], np.cumsum([token_cost(t, formulas) for t in tokens])])
        self.bare = np.concatenate([[0.0], np.cumsum([token_cost(t, {}) for t in tokens])]) if formulas else self.before
        seen = np.array([not t.isspace() for t in tokens])
        self.last = np.concatenate([[-1], np.maximum.accumulate(np.where(seen, np.arange(self.n), -1))])
        self.ends = np.array([t.endswith(STOPS) for t in tokens])

    def stop(self, a: int, p: np.ndarray) -> np.ndarray:
        last = self.last[p]
        return (last >= a) & self.ends[np.maximum(last, 0)]

    def cost(self, a: int, b: int) -> float:
        return float(self.before[b] - self.before[a])

    def part(self, a: int, b: int) -> str:
        return "".join(self.tokens[a:b]).strip()


def _greedy(t: _Text, capacities: list[float], preferred: list[float]) -> list[int]:
    """Ends of all boxes."""
    ends, at, left, wanted = [], 0, float(t.before[-1]), sum(preferred)
    for k, capacity in enumerate(capacities[:-1]):
        last = t.n - (len(capacities) - k - 1)
        if last <= at:  # fewer tokens than boxes
            ends.append(min(at + 1, t.n))
        else:
            target = left * preferred[k] / max(1.0, wanted)
            anchor = int(np.clip(np.searchsorted(t.before, t.before[at] + min(target, capacity * FILL), "left"), at + 1, last))
            p = np.arange(at + 1, last + 1)
            stops = t.stop(at, p)
            p = p[(np.abs(p - anchor) <= REACH) | stops | (p == at + 1) | (p == last)]
            stops = t.stop(at, p)
            now = t.before[p] - t.before[at]
            after = sum(capacities[k + 1 :])
            over, future = OVERFLOW[after > 0 and capacity >= after * 2]
            score = np.maximum(0.0, now - capacity * OVER) * over + np.maximum(0.0, left - now - after * FUTURE_OVER) * future + np.abs(now - target) + np.maximum(0.0, capacity * UNDER - now) * UNDER_WEIGHT + np.where(stops, 0.0, NO_STOP)
            ends.append(int(p[np.argmin(score)]))
        left = max(0.0, left - t.cost(at, ends[-1]))
        wanted = max(1.0, wanted - preferred[k])
        at = ends[-1]
    return [*ends, t.n]


def _moved(t: _Text, a: int, b: int, c: int, left_capacity: float, right_capacity: float) -> int:
    """Where the boundary b of two boxes' texts a to b and b to c should be."""
    left, right = t.cost(a, b), t.cost(b, c)
    if a >= b or b >= c or left + right <= 0:
        return b
    target = (left + right) * left_capacity / (left_capacity + right_capacity)
    if left - target <= TRIGGER or left / left_capacity <= right / right_capacity + RATIO_GAP:
        return b
    # the last place from which on the surplus fits into the right box
    ideal = int(np.searchsorted(t.bare, t.bare[b] - (left - target), "right")) - 1
    ideal = ideal if ideal > a else b - 1
    p = np.arange(a + 1, b)
    stops = t.stop(a, p)
    moved = t.before[b] - t.before[p]
    able = (np.abs(p - ideal) <= WINDOW) | stops | (p == a + 1) | (p == b - 1)
    able &= (moved > 0) & ((moved >= LEAST_MOVE) | stops)
    if not able.any():
        return b
    kept = t.before[p] - t.before[a]
    score = np.abs(kept - target) + np.abs(kept / left_capacity - (moved + right) / right_capacity) * RATIO_WEIGHT + np.where(stops, 0.0, MOVE_NO_STOP)
    best = int(p[np.argmin(np.where(able, score, np.inf))])
    return best if abs(t.cost(a, best) - left) > SETTLED else b


def _rebalanced(t: _Text, capacities: list[float], ends: list[int]) -> list[int]:
    ends = list(ends)
    for _ in range(PASSES):
        before = list(ends)
        for k in range(len(ends) - 1):
            ends[k] = _moved(t, ends[k - 1] if k else 0, ends[k], ends[k + 1], capacities[k], capacities[k + 1])
        if ends == before:
            break
    return ends


def split_for_boxes(text: str, capacities: Sequence[float], formulas: dict[str, str] | None = None, preferred: Sequence[float] | None = None, math: bool = False, rebalance: bool = True) -> list[str]:
    """One part of ``text`` for each box, in order; every token is in one part.  Null counts as empty; without boxes or with one the text stays whole.

    A box's cut weighs overflow now and later, its share, and punctuation; then, up to three times over, a box that holds much more than its share gives its end to the next.
    """
    text = text or ""
    if len(capacities) <= 1:
        return [text.strip()]
    tokens = (MATH_TOKEN if math else TOKEN).findall(text)
    room = [max(1.0, float(c)) for c in capacities]
    if not tokens:
        return [""] * len(room)
    t = _Text(tokens, formulas or {})
    ends = _greedy(t, room, [max(1.0, float(p)) for p in preferred] if preferred else room)
    if rebalance:
        ends = _rebalanced(t, room, ends)
    return [t.part(a, b) for a, b in zip([0, *ends], ends, strict=False)]


def split_for_boxes_udf(*columns):
    """(text, capacities) as a vectorised function."""

    def run(texts: pd.Series, capacities: pd.Series) -> pd.Series:
        return pd.Series([split_for_boxes(t, [] if c is None else list(c)) for t, c in zip(texts, capacities, strict=True)])

    return F.pandas_udf(run, "array<string>")(*columns)
