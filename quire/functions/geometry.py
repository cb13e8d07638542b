"""Rectangle and typesetting arithmetic as native Columns; a rectangle is a struct (x0, y0, x1, y1) of doubles."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of merging.
GROWTH, ROW_SLACK, OVERLAP, GAP = 2.4, 6.0, 0.8, 3.0
#: Width of a character in font sizes; exact, so that its product with a decimal size is.
CHAR_WIDTH = Decimal("0.92")


def _zero(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def area(r: Column) -> Column:
    return _zero(r["x1"] - r["x0"]) * _zero(r["y1"] - r["y0"])


def overlap_area(a: Column, b: Column) -> Column:
    return _zero(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) * _zero(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def union(a: Column, b: Column) -> Column:
    return rect(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def iou(a: Column, b: Column) -> Column:
    inter = overlap_area(a, b)
    return F.when(inter <= 0, 0.0).otherwise(inter / (area(a) + area(b) - inter))


def x_overlap_ratio(a: Column, b: Column) -> Column:
    width = lambda r: r["x1"] - r["x0"]
    return _zero(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])) / F.greatest(F.lit(1.0), F.least(width(a), width(b)))


def should_merge(a: Column, b: Column) -> Column:
    """Little growth, and either overlap (same row or mostly) or a small gap in the same row."""
    both = area(a) + area(b)
    row = (F.abs(a["y0"] - b["y0"]) <= ROW_SLACK) & (F.abs(a["y1"] - b["y1"]) <= ROW_SLACK)
    inter = overlap_area(a, b)
    overlapped = row | (inter / F.greatest(F.lit(1.0), F.least(area(a), area(b))) >= OVERLAP)
    gap = _zero(F.greatest(a["x0"], b["x0"]) - F.least(a["x1"], b["x1"]))
    return (both > 0) & (area(union(a, b)) <= GROWTH * both) & F.when(inter > 0, overlapped).otherwise(row & (gap <= GAP))


def contains_point(r: Column, x: Column, y: Column) -> Column:
    return (r["x0"] <= x) & (x <= r["x1"]) & (r["y0"] <= y) & (y <= r["y1"])


def center_x(r: Column) -> Column:
    return (r["x0"] + r["x1"]) / 2


def center_y(r: Column) -> Column:
    return (r["y0"] + r["y1"]) / 2


def chars_per_line(r: Column, font_pt: Column) -> Column:
    return F.greatest(F.lit(4.0), F.greatest(F.lit(8.0), r["x1"] - r["x0"]) / F.greatest(font_pt * F.lit(CHAR_WIDTH), F.lit(1.0)))


def line_step(font_pt: Column, leading_em: Column) -> Column:
    return F.greatest(font_pt * 1.02, font_pt * (leading_em + 1.0))


def box_capacity_units(r: Column, font_pt: Column, leading_em: Column) -> Column:
    lines = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(8.0), r["y1"] - r["y0"]) / line_step(font_pt, leading_em)))
    return lines * chars_per_line(r, font_pt) * 0.98


def required_lines(r: Column, demand: Column, font_pt: Column) -> Column:
    return F.when(demand <= 0, 1).otherwise(F.greatest(F.lit(1), F.ceil(demand / F.greatest(chars_per_line(r, font_pt) * 0.98, F.lit(1.0)))))


def text_demand_units(text: Column) -> Column:
    """Width of formula-free text in full-width units: a CJK sign 1, an ASCII word 0.55 a letter (1 at least), a run of
    white space 0.25 a character (0.2 at least), anything else 0.45."""
    n = lambda p: F.regexp_count(text, F.lit(p))
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"), F.lit(0))
    gaps = F.regexp_extract_all(text, F.lit(r"\s+"), F.lit(0))
    rest = F.regexp_replace(F.regexp_replace(text, r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*", ""), r"[\s一-鿿]", "")
    # in whole hundredths: a sum of fractions would go astray, and a line more be needed for it
    none = F.lit(0).cast("long")
    sized = F.aggregate(words, none, lambda acc, w: acc + F.greatest(F.lit(100), F.length(w) * 55))
    spaced = F.aggregate(gaps, none, lambda acc, w: acc + F.greatest(F.lit(20), F.length(w) * 25))
    return (sized + spaced + n("[一-鿿]") * 100 + F.length(rest) * 45) / 100


def formula_discount(units: Column) -> Column:
    return F.round(F.lit(1.0) - F.lit(0.14) * (F.lit(1.0) - F.exp(units * -1.7)), 3)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def affine(a: Column, b: Column) -> Column:
    """Product of two 3x2 matrices given as arrays of six doubles."""
    g = lambda m, i: m[i]
    return F.array(
        g(a, 0) * g(b, 0) + g(a, 1) * g(b, 2), g(a, 0) * g(b, 1) + g(a, 1) * g(b, 3),
        g(a, 2) * g(b, 0) + g(a, 3) * g(b, 2), g(a, 2) * g(b, 1) + g(a, 3) * g(b, 3),
        g(a, 4) * g(b, 0) + g(a, 5) * g(b, 2) + g(b, 4), g(a, 4) * g(b, 1) + g(a, 5) * g(b, 3) + g(b, 5),
    )
