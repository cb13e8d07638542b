"""Repair of two-column pages and smoothing of neighbouring bodies: passes whose every step changes what the next one sees.

What a step looks at (columns, bands, first places, neighbours) is stated with windows and page arrays; Python gets only pages where there is something to do, and runs
one pass over the few blocks concerned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G

# --- fixed values ------------------------------------------------------------
SLOT_AREA, SLOT_HEIGHT, BAND_TEXT, CARRY_TEXT, CONTEXT_GAP = 8000.0, 48.0, 12, 48, 96.0
BODY_LABELS = ("text", "abstract")
BAND_OVERLAP, SPLIT_LEAST_TEXT, PEER_SHARE, EDGE, PART_LEAST = 0.25, 16, (0.18, 0.55), 4, 6
DENSITY, GAP_MOST, GAP_HEIGHT, WIDTH_RATIO, WIDTH_OVERLAP, GAP_LEAST = 0.92, 42.0, 0.45, 0.72, 0.64, -4.0
LEFT_DELTA, CENTER_DELTA, BOX_HEIGHT, BOX_WIDTH, PAGE_WIDTH_RATIO, SOURCE_WORDS, ZH_CHARS = (18.0, 0.06), (22.0, 0.08), 36.0, 64.0, 0.38, 10, 18
FONT_DELTA, LEADING_DELTA, GROW_DENSITY = (0.24, 0.34), (0.06, 0.09), (0.95, 0.99)
FONT_SHARE, LEADING_SHARE, FONT_LEAST, LEADING_LEAST, PRESSURE, LEADING_RANGE = 0.6, 0.35, 6.4, 0.18, 0.9, (0.44, 0.68)
HALVINGS = 8
# -----------------------------------------------------------------------------


# --- two-column repair ---------------------------------------------------------------


def _plain(c: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))


def body_candidates(blocks: DataFrame, page: list[str]) -> DataFrame:
    """Adds ``body``: text and abstract blocks, after the front matter where a page has one that ends."""
    w = Window.partitionBy(*page)
    label, text = F.lower(F.trim(F.coalesce("label", F.lit("")))), _plain("text")
    front = label.isin("doc_title", "abstract") | ((label == "paragraph_title") & (text == "abstract"))
    rows = blocks.withColumn("__front", F.max(F.when(front, F.col("order"))).over(w))
    opens = ((label == "paragraph_title") & (text != "") & (text != "abstract")) | (label.isin(*BODY_LABELS) & (text != "") & ~text.startswith("keywords:"))
    rows = rows.withColumn("__start", F.min(F.when((F.col("order") > F.col("__front")) & opens, F.col("order"))).over(w))
    return rows.withColumn("body", label.isin(*BODY_LABELS) & (F.col("__start").isNull() | (F.col("order") >= F.col("__start")))).drop("__front", "__start")


def _overlapping(a: tuple, b: tuple) -> bool:
    """Do two (top, bottom) bands share a quarter of the lower one?"""
    return min(a[1], b[1]) - max(a[0], b[0]) >= BAND_OVERLAP * min(max(1.0, a[1] - a[0]), max(1.0, b[1] - b[0]))


def _gap(a: tuple, b: tuple) -> float:
    return 0.0 if _overlapping(a, b) else max(0.0, b[0] - a[1], a[0] - b[1])


def cut_at(text: str, share: float) -> int | None:
    """Where a text of single blanks is cut so that about ``share`` of it stays: the blank nearest to that, within a sixth of the text; None if there is none."""
    n = len(text)
    target = math.floor(n * share)
    reach = max(8, n // 6)
    low, high = max(EDGE, target - reach), min(n - EDGE, target + reach)
    if n < SPLIT_LEAST_TEXT or low >= high:
        return None
    before, after = text.rfind(" ", low, min(target, high) + 1), text.find(" ", max(low, target), high + 1)
    if before < 0 and after < 0:
        return None
    at = after if before < 0 or (after >= 0 and after - target < target - before) else before
    return at if min(len(text[:at].strip()), len(text[at:].strip())) >= PART_LEAST else None


class _Page:
    """The body records of a page.  Texts shrink and grow, records are used up; whether one was empty at first does not change."""

    def __init__(self, records: list[dict]) -> None:
        self.all = sorted(records, key=lambda r: r["order"])
        self.used: set[int] = set()
        for r in self.all:
            r["band"] = (r["y0"], r["y1"])

    def carrier(self, slot: dict) -> dict | None:
        """The block of the other column whose end belongs into ``slot``: only if the slot is the first of its column, with long text near by."""
        column = [r for r in self.all if r["column"] == slot["column"]]
        solid = [r for r in column if r["area"] >= SLOT_AREA or len(r["text"]) >= CARRY_TEXT]
        if not solid or min(solid, key=lambda r: (r["y0"], r["order"])) is not slot:
            return None
        if not any(r is not slot and not r["was_empty"] and len(r["text"]) >= CARRY_TEXT and _gap(slot["band"], r["band"]) <= CONTEXT_GAP for r in column):
            return None
        other = [r for r in self.all if r["column"] == ("right" if slot["column"] == "left" else "left") and not r["was_empty"] and r["order"] not in self.used]
        earlier = [r for r in other if r["order"] < slot["order"]]
        tries = ([earlier[-1]] if earlier else []) + ([max(other, key=lambda r: (r["y1"], r["order"]))] if other else [])
        return next((r for r in tries if len(r["text"]) >= CARRY_TEXT), None)

    def neighbour(self, slot: dict) -> dict | None:
        """The largest block beside ``slot`` in another column; none if its text may come from the other column's end."""
        if self.carrier(slot):
            return None
        beside = [r for r in self.all if r is not slot and r["order"] not in self.used and not r["was_empty"] and r["column"] != slot["column"] and len(r["text"]) >= BAND_TEXT and _overlapping(r["band"], slot["band"])]
        return max(beside, key=lambda r: r["area"], default=None)

    def give(self, donor: dict, slot: dict, strategy: str) -> None:
        """The donor's end becomes the slot's text, by their areas; an unsafe cut is noted."""
        note = {"strategy": strategy, "attempted": True, "applied": False}
        if not donor["text"] or slot["text"]:
            return
        whole = " ".join(donor["text"].split())
        peer = max(PEER_SHARE[0], min(PEER_SHARE[1], slot["area"] / (donor["area"] + slot["area"])))
        at = cut_at(whole, 1.0 - peer)
        if at is None:
            for r, p in ((donor, slot), (slot, donor)):
                r |= note | {"role": r.get("role"), "peer_order": p["order"]}
            return
        first_length = len(donor["text"])
        donor["text"], slot["text"] = whole[:at].strip(), whole[at:].strip()
        for r, p, role, length in ((donor, slot, "absorber", first_length), (slot, donor, "peer", 0)):
            r |= note | {"applied": True, "role": role, "peer_order": p["order"], "split_index": at, "original_length": length}
            self.used.add(r["order"])

    def repair(self) -> list[dict]:
        slots = [r for r in self.all if r["slot"]]
        for strategy, find in (("column_carryover", self.carrier), ("same_band", self.neighbour)):
            for slot in slots:
                if slot["order"] not in self.used and (donor := find(slot)):
                    self.give(donor, slot, strategy)
        return self.all


_NOTES = "repaired string, attempted boolean, applied boolean, role string, strategy string, peer_order int, split_index int, original_length int"


def repair_columns(blocks: DataFrame, page: list[str]) -> DataFrame:
    """blocks plus repaired (its text after repair) and what was done: attempted, applied, role, strategy, peer_order, split_index, original_length.

    ``blocks``: page..., order, label, text, column (left, right, full or unknown), r.  On pages of two columns an empty slot of body size takes the end of
    the text that was read into another block: of the other column's last block before it if the slot opens its column, else of the
    largest block beside it.  Both passes go by ``order``; a block is used once.  Null text is empty; a null column is unknown; blocks without a box are no candidates.  Pages without a slot don't leave the JVM.
    """
    rows = body_candidates(blocks, page)
    r = F.col("r")
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    size = F.greatest(F.lit(1.0), r["x1"] - r["x0"]) * F.greatest(F.lit(1.0), r["y1"] - r["y0"])
    rows = rows.withColumn("__body", F.col("body") & r.isNotNull() & G.area(r).isNotNull()).withColumn("__empty", F.length(clean) < 2).withColumn("__area", size)
    side = F.coalesce(F.col("column"), F.lit("unknown"))
    slot = F.col("__body") & F.col("__empty") & (F.col("__area") >= SLOT_AREA) & (r["y1"] - r["y0"] >= SLOT_HEIGHT) & side.isin("left", "right")
    w = Window.partitionBy(*page)
    n = lambda c: F.count(F.when(F.col("__body") & c, 1)).over(w)
    left, right, gaps = n(side == "left"), n(side == "right"), n(F.col("__empty") & side.isin("left", "right"))
    double = (left > 0) & (right > 0) & (((left >= 2) & (right >= 2)) | (gaps > 0))
    rows = rows.withColumn("__slot", slot).withColumn("__todo", double & (F.max(slot).over(w)))
    done = rows.where(F.col("__todo") & F.col("__body")).select(
        *page, "order", clean.alias("text"), side.alias("column"), r["y0"].alias("y0"), r["y1"].alias("y1"), F.col("__area").alias("area"), F.col("__empty").alias("was_empty"), F.col("__slot").alias("slot")
    )
    names = [c.split()[0] for c in _NOTES.split(", ")]
    kinds = dict(zip(names, [pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()], strict=True))

    def one(table: pa.Table) -> pa.Table:
        records = table.to_pylist()
        out = [r for r in _Page(records).repair() if r.get("attempted")]
        columns = {c: pa.array([r[c] for r in out], table.schema.field(c).type) for c in [*page, "order"]}
        return pa.table(columns | {c: pa.array([r["text"] if c == "repaired" else r.get(c) for r in out], kinds[c]) for c in names})

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in done.select(*page, "order").schema)
    notes = done.groupBy(*page).applyInArrow(one, f"{keys}, {_NOTES}")
    out = rows.drop("body", "__body", "__empty", "__area", "__slot", "__todo").join(notes, [*page, "order"], "left")
    return out.withColumn("repaired", F.coalesce("repaired", clean)).withColumn("attempted", F.coalesce("attempted", F.lit(False))).withColumn("applied", F.coalesce("applied", F.lit(False)))


# --- smoothing of neighbouring bodies ----------------------------------------------------


def next_in_column(blocks: DataFrame, page: list[str]) -> DataFrame:
    """blocks plus ``next``: the number (__k, from the top) of the body that follows in the column; of several the one with the smallest gap, then the nearest center.

    ``blocks``: page..., id, r, able.  Only able blocks are paired; __k numbers them by (top, left, id).
    """
    r = F.col("r")
    k = F.row_number().over(Window.partitionBy(*page, "able").orderBy(r["y0"], r["x0"], "id")) - 1
    rows = blocks.withColumn("__k", F.when(F.col("able"), k))
    pages = rows.where("able").groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("__k", "r", "id"))).alias("all"))
    wide = lambda b: F.greatest(F.lit(8.0), b["x1"] - b["x0"])
    high = lambda b: F.greatest(F.lit(8.0), b["y1"] - b["y0"])
    center = lambda b: (b["x0"] + b["x1"]) / 2

    def follows(a: Column, b: Column) -> Column:
        small, large = F.least(wide(a), wide(b)), F.greatest(wide(a), wide(b))
        gap = b["y0"] - a["y1"]
        aligned = (F.abs(a["x0"] - b["x0"]) <= F.greatest(F.lit(LEFT_DELTA[0]), large * LEFT_DELTA[1])) | (F.abs(center(a) - center(b)) <= F.greatest(F.lit(CENTER_DELTA[0]), large * CENTER_DELTA[1]))
        overlap = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
        return (b["y0"] >= a["y0"]) & (small / large >= WIDTH_RATIO) & (overlap / small >= WIDTH_OVERLAP) & (gap >= GAP_LEAST) & (gap <= F.greatest(F.lit(GAP_MOST), F.least(high(a), high(b)) * GAP_HEIGHT)) & aligned

    def nearest(a: Column, i: Column) -> Column:
        later = F.slice("all", i + 2, F.greatest(F.size("all") - i - 1, F.lit(0)))
        keyed = F.transform(F.filter(later, lambda b: follows(a["r"], b["r"])), lambda b: F.struct(F.greatest(F.lit(GAP_LEAST), b["r"]["y0"] - a["r"]["y1"]).alias("gap"), F.abs(center(a["r"]) - center(b["r"])).alias("off"), b["__k"].alias("k")))
        return F.struct(a["id"].alias("id"), F.array_min(keyed)["k"].alias("next"))

    found = pages.select(*page, F.inline(F.transform("all", nearest)))
    return rows.join(found, [*page, "id"], "left")


def _density(b: dict, font: float, leading: float) -> float:
    """Estimated height of a block's text in it, by the height of the block."""
    line = max(4.0, b["width"] / max(font * 0.92, 1.0)) * 0.98
    lines = 1 if b["units"] <= 0 else max(1, math.ceil(b["units"] / max(line, 1.0)))
    return lines * max(font * 1.02, font * (1.0 + leading)) * b["discount"] / b["space"]


def _grown(b: dict, name: str, to: float, limit: float) -> float:
    """The largest value up to ``to`` at which the block is no denser than ``limit``, by halving."""
    low, high, best = b[name], to, b[name]
    if to <= low:
        return round(to, 2)
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        font, leading = (mid, b["leading"]) if name == "font" else (b["font"], mid)
        if _density(b, font, leading) <= limit:
            best = low = mid
        else:
            high = mid
    return round(best, 2)


def _approach(a: dict, b: dict, name: str, most: float, share: float, least: float, limit: float) -> None:
    """Brings two blocks' fonts or leadings within ``most``: the smaller grows if it may, the larger gives up the rest."""
    small, large = (a, b) if a[name] <= b[name] else (b, a)
    excess = large[name] - small[name] - most
    if excess <= 0:
        return
    grown = 0.0
    if not (small["fit"] or small["heavy"] or small["dense"]) and _density(small, small["font"], small["leading"]) <= limit:
        value = _grown(small, name, small[name] + excess * share, limit)
        grown, small[name] = max(0.0, value - small[name]), value
    large[name] = round(max(least, large[name] - max(0.0, excess - grown)), 2)


def smooth_pair(a: dict, b: dict) -> None:
    """Brings font and leading of two bodies closer; pages that are dense or need fitting get the wider limits."""
    wide = max(_density(x, x["font"], x["leading"]) for x in (a, b)) > DENSITY or any(x["dense"] or x["fit"] for x in (a, b))
    limit = GROW_DENSITY[wide]
    _approach(a, b, "font", FONT_DELTA[wide], FONT_SHARE, FONT_LEAST, limit)
    pressure = [max(max(0.0, x["pitch"] / max(0.1, x["font"]) - 1.0) if x["pitch"] > 0 else 0.0, min(4.0, x["lines"] / 4.0)) for x in (a, b)]
    if abs(pressure[0] - pressure[1]) <= PRESSURE:
        _approach(a, b, "leading", LEADING_DELTA[wide], LEADING_SHARE, LEADING_LEAST, max(DENSITY, limit - 0.02))
    for x in (a, b):
        x["leading"] = round(min(max(x["leading"], LEADING_RANGE[0]), max(LEADING_RANGE[1], x["leading_cap"])), 2)



def smooth_bodies(blocks: DataFrame, page: list[str]) -> DataFrame:
    """blocks plus smooth_font and smooth_leading: each body, from the top, is brought closer to the next one of its column, which may have changed already.

    ``blocks``: page..., id, r, body, markdown, source_words, zh_chars, page_width_med, font, leading, units and discount (demand of the text), dense, fit, heavy, and pitch and lines of the source, space (the height that counts for
    density; null: the box's) and leading_cap (null: the usual one).  Other blocks keep their values.  Who follows whom does not depend on fonts, so the pairs are found first; Python runs the pass over pages with pairs.
    """
    r = F.col("r")
    wide, high = F.greatest(F.lit(8.0), r["x1"] - r["x0"]), F.greatest(F.lit(8.0), r["y1"] - r["y0"])
    least = F.greatest(F.lit(BOX_WIDTH), F.when(F.col("page_width_med") > 0, F.col("page_width_med") * PAGE_WIDTH_RATIO).otherwise(0.0))
    able = F.col("body") & F.col("markdown") & ~F.col("heavy") & (high >= BOX_HEIGHT) & (wide >= least) & ((F.col("source_words") >= SOURCE_WORDS) | (F.col("zh_chars") >= ZH_CHARS))
    rows = next_in_column(blocks.withColumn("able", F.coalesce(able, F.lit(False))), page)
    # only blocks of pairs take part: those that another one has as its next, too
    targets = F.collect_set("next").over(Window.partitionBy(*page))
    todo = rows.where("able").withColumn("__paired", F.col("next").isNotNull() | F.array_contains(targets, F.col("__k"))).where("__paired").select(
        *page, "id", "__k", "next", "font", "leading", "units", "discount", wide.alias("width"), F.greatest(F.lit(8.0), F.coalesce("space", high)).alias("space"), "dense", "fit", "heavy", F.coalesce("pitch", F.lit(0.0)).alias("pitch"), F.coalesce("lines", F.lit(0)).alias("lines"),
        F.coalesce("leading_cap", F.lit(0.0)).alias("leading_cap"),
    )
    todo = todo.repartition(*page).sortWithinPartitions(*page, "__k")

    def smooth(bodies: list[dict]) -> None:
        at = {b["__k"]: b for b in bodies}
        for b in bodies:
            if b["next"] is not None:
                smooth_pair(b, at[b["next"]])

    def made(bodies: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([b[c] for b in bodies], schema.field(c).type) for c in (*page, "id")]
        return pa.record_batch([*columns, pa.array([b["font"] for b in bodies], pa.float64()), pa.array([b["leading"] for b in bodies], pa.float64())], names=[*page, "id", "smooth_font", "smooth_leading"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pages come in order, one after the other; one may go on in the next batch."""
        of = lambda b: tuple(b[c] for c in page)
        held: list[dict] = []
        schema = None
        for batch in batches:
            schema, done = batch.schema, []
            for b in batch.to_pylist():
                if held and of(b) != of(held[0]):
                    smooth(held)
                    done += held
                    held = []
                held.append(b)
            if done:
                yield made(done, schema)
        if held:
            smooth(held)
            yield made(held, schema)

    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.select(*page, "id").schema)
    new = todo.mapInArrow(run, f"{keys}, smooth_font double, smooth_leading double")
    out = rows.drop("able", "__k", "next").join(new, [*page, "id"], "left")
    return out.withColumn("smooth_font", F.coalesce("smooth_font", "font")).withColumn("smooth_leading", F.coalesce("smooth_leading", "leading"))
