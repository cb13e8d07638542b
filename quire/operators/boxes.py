"""Boxes of a page against one another: difference from any number of guards, boxes fitted to their neighbours, text that an item may remove.

What meets by place meets in grid cells; what is nearest in a column is looked up in a page's boxes, ordered from top to bottom.  A page is
a sheet of a document: its boxes fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators.layout import dedup_rects, rect_overlaps
from quire.operators.outputs import let

# --- fixed values ------------------------------------------------------------
LEAST_AREA = 0.5
INSET_RATIO, INSET_LEAST, GAP_LEAST, GAP_MOST, GAP_RATIO, INSET_SIDE, HEIGHT_LEFT = 0.03, 0.35, 1.2, 4.0, 0.08, 0.08, 8.0
SAME_COLUMN_OVERLAP, COLUMN_TOLERANCE, COLUMN_RATIO = 0.55, 18.0, 0.035
ANCHORS, ANCHOR_RATIO, SHORT_HEIGHT, SHORT_WIDTH, TOP_GROWTH, RIGHT_GROWTH, TOP_GAP, RIGHT_LEAST, PAGE_EDGE = 2, 0.10, 0.72, 0.78, 0.05, 0.30, 1.0, 0.5, 4.0
TITLE_LEFT, TITLE_GROWTH = 18.0, 1.18
SAFE_SIZE, SAFE_IOU, WORD_PAD, ITEM_PAD = 0.05, 0.8, (1.0, 0.6), (1.5, 1.0)
WORDS = r"[A-Za-z0-9]+(?:[-./][A-Za-z0-9]+)*|[一-鿿]+"
# -----------------------------------------------------------------------------


# --- difference --------------------------------------------------------------------


def _outside(r: Column, guard: Column) -> Column:
    """The pieces of a rectangle outside one guard: left and right of it in full height, above and below it between them."""

    def cut(i: Column) -> Column:
        pieces = F.array(G.rect(r["x0"], r["y0"], i["x0"], r["y1"]), G.rect(i["x1"], r["y0"], r["x1"], r["y1"]), G.rect(i["x0"], r["y0"], i["x1"], i["y0"]), G.rect(i["x0"], i["y1"], i["x1"], r["y1"]))
        return F.when(G.area(i) > LEAST_AREA, F.filter(pieces, lambda p: G.area(p) > LEAST_AREA)).otherwise(F.array(r))

    both = G.rect(F.greatest(r["x0"], guard["x0"]), F.greatest(r["y0"], guard["y0"]), F.least(r["x1"], guard["x1"]), F.least(r["y1"], guard["y1"]))
    return let(both, cut)


def subtract_all(rects: DataFrame, guards: DataFrame, page: list[str]) -> DataFrame:
    """(page..., id, n_guards, r): the pieces of each rectangle outside all guards of its page; one that is covered has none.

    ``rects`` and ``guards``: page..., id, r.  Guards apply in the order of their ids, each to what the ones before left; those that overlap the rectangle by no more than 0.5 change nothing.  Pieces
    don't overlap, and pieces of 0.5 or less go.
    """
    met = rect_overlaps(rects, guards, page).where(F.col("inter") > LEAST_AREA).select(*page, F.col("a_id").alias("id"), F.col("b_id").alias("g_id"))
    mine = met.join(guards.select(*page, F.col("id").alias("g_id"), F.col("r").alias("g")), [*page, "g_id"]).groupBy(*page, "id").agg(F.array_sort(F.collect_list(F.struct("g_id", "g"))).alias("gs"))
    rows = rects.select(*page, "id", "r").join(mine, [*page, "id"], "left")
    left = F.aggregate("gs", F.array("r"), lambda pieces, g: F.flatten(F.transform(pieces, lambda p: _outside(p, g["g"]))))
    return rows.select(*page, "id", F.coalesce(F.size("gs"), F.lit(0)).alias("n_guards"), F.explode(F.coalesce(left, F.array("r"))).alias("r"))


# --- boxes fitted to their neighbours --------------------------------------------------


def _width(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["x1"] - r["x0"])


def _height(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["y1"] - r["y0"])


def same_column(a: Column, b: Column, page_width: Column) -> Column:
    """Half of the narrower one and more lies under the other, or both start at about the same x."""
    overlap = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    narrow = F.least(F.greatest(F.lit(1.0), a["x1"] - a["x0"]), F.greatest(F.lit(1.0), b["x1"] - b["x0"]))
    return (overlap >= narrow * SAME_COLUMN_OVERLAP) | (F.abs(a["x0"] - b["x0"]) <= F.greatest(F.lit(COLUMN_TOLERANCE), page_width * COLUMN_RATIO))


def _median(values: Column) -> Column:
    """Of the positive values of an array; 0 where there are none."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        at = lambda k: F.get(s, k.cast("int"))
        return F.when(n == 0, 0.0).otherwise((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)

    return let(F.array_sort(F.filter(values, lambda v: v > 0)), middle)


def _boxes(kind: str) -> Column:
    """A page's boxes of one kind, from top to bottom."""
    row = F.struct("r.y0", "r.x0", "pos", F.col("r.x1").alias("x1"), F.col("r.y1").alias("y1"), "id", "locked")
    return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, row)))


def _inset(bodies: Column, gap: Column, page_width: Column) -> Column:
    """Bodies that nearly touch the next one of their column lose a little at the top and at the bottom."""

    def shrink(b: Column, k: Column) -> Column:
        below = F.get(F.filter(F.slice(bodies, k + 2, F.greatest(F.size(bodies) - k - 1, F.lit(0))), lambda c: same_column(b, c, page_width)), F.lit(0))

        def sized(space: Column) -> Column:
            h = _height(b)
            inset = h * INSET_RATIO * F.least(F.lit(1.0), (gap - space) / F.greatest(gap, F.lit(0.01)))
            side = F.least(h * INSET_SIDE, inset / 2)
            close = (gap > 0) & ~b["locked"] & space.isNotNull() & (space > -gap) & (space < gap) & (h > 0) & (inset >= INSET_LEAST) & (side > 0) & (h - side * 2 >= HEIGHT_LEFT)
            return F.struct(
                F.when(close, F.round(b["y0"] + side, 3)).otherwise(b["y0"]).alias("y0"), b["x0"].alias("x0"), b["pos"].alias("pos"), b["x1"].alias("x1"), F.when(close, F.round(b["y1"] - side, 3)).otherwise(b["y1"]).alias("y1"),
                b["id"].alias("id"), b["locked"].alias("locked"),
            )

        return let(below["y0"] - b["y1"], sized)

    return F.transform(bodies, shrink)


def fitted_boxes(blocks: DataFrame, page: list[str], page_width: float) -> DataFrame:
    """(page..., id, kind, r): boxes after three adjustments, each from what the ones before left.

    ``blocks``: page..., id, pos, kind (body, region, title or anything else), locked, r.  Bodies that nearly touch the next body of their column shrink; short region boxes grow up towards, and to
    the right as far as, the two bodies above them; titles grow to the right as far as bodies below them.  Locked boxes stay.  A page's boxes are looked at together.
    """
    w = F.lit(float(page_width))
    pages = blocks.groupBy(*page).agg(*[_boxes(k).alias(k) for k in ("body", "region", "title")])
    gap = F.when(F.size("body") < 2, 0.0).otherwise(
        let(_median(F.transform("body", _height)), lambda m: F.when(m <= 0, 0.0).otherwise(F.least(F.lit(GAP_MOST), F.greatest(F.lit(GAP_LEAST), m * GAP_RATIO))))
    )
    pages = pages.withColumn("gap", gap).withColumn("body", _inset(F.col("body"), F.col("gap"), w))
    pages = pages.withColumn("body", F.array_sort("body")).withColumn("mh", _median(F.transform("body", _height))).withColumn("mw", _median(F.transform("body", _width)))
    few = (F.size("body") < ANCHORS) | (F.size("body") + F.size("region") < ANCHORS + 1) | (F.col("mh") <= 0) | (F.col("mw") <= 0)

    def grown(c: Column) -> Column:
        reach = F.greatest(F.lit(18.0), w * ANCHOR_RATIO)
        earlier = lambda b: (b["y0"] < c["y0"]) | ((b["y0"] == c["y0"]) & ((b["x0"] < c["x0"]) | ((b["x0"] == c["x0"]) & (b["pos"] < c["pos"]))))
        above = F.filter("body", lambda b: earlier(b) & (b["y1"] <= c["y0"]) & (F.abs(b["x0"] - c["x0"]) <= reach) & (b["x1"] > c["x1"]) & same_column(b, c, w))

        def by(near: Column) -> Column:
            h, wide = _height(c), _width(c)
            able = ~few & ~c["locked"] & (h > 0) & (wide > 0) & (h <= F.col("mh") * SHORT_HEIGHT) & (wide <= F.col("mw") * SHORT_WIDTH) & (F.size(near) >= ANCHORS)
            up = F.least(h * TOP_GROWTH, F.greatest(F.lit(0.0), c["y0"] - F.array_max(F.transform(near, lambda b: b["y1"])) - TOP_GAP))
            right = F.least(F.array_max(F.transform(near, lambda b: b["x1"])), w - PAGE_EDGE, c["x1"] + wide * RIGHT_GROWTH)
            return F.struct(
                F.when(able & (up > 0), F.round(c["y0"] - up, 3)).otherwise(c["y0"]).alias("y0"), c["x0"].alias("x0"), F.when(able & (right > c["x1"] + RIGHT_LEAST), F.round(right, 3)).otherwise(c["x1"]).alias("x1"), c["y1"].alias("y1"), c["id"].alias("id"),
            )

        return let(let(above, lambda a: F.slice(a, F.greatest(F.size(a) - ANCHORS + 1, F.lit(1)), F.lit(ANCHORS))), by)

    def widened(t: Column) -> Column:
        ends = F.transform(F.filter("body", lambda b: (b["y0"] >= t["y0"]) & (F.abs(b["x0"] - t["x0"]) <= TITLE_LEFT) & (b["x1"] > t["x1"])), lambda b: b["x1"])
        to = let(F.array_max(ends), lambda e: F.when(e.isNotNull(), F.round(F.greatest(t["x1"], F.least(e, w - PAGE_EDGE, t["x0"] + _width(t) * TITLE_GROWTH)), 3)))
        return F.struct(t["y0"].alias("y0"), t["x0"].alias("x0"), F.when(t["locked"] | (_width(t) <= 0), t["x1"]).otherwise(F.coalesce(to, t["x1"])).alias("x1"), t["y1"].alias("y1"), t["id"].alias("id"))

    plain = lambda b: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), b["x1"].alias("x1"), b["y1"].alias("y1"), b["id"].alias("id"))
    marked = lambda kind, arr: F.transform(arr, lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("b")))
    all_boxes = F.concat(marked("body", F.transform("body", plain)), marked("region", F.transform("region", grown)), marked("title", F.transform("title", widened)))
    out = pages.select(*page, F.inline(all_boxes)).select(*page, F.col("b.id").alias("id"), "kind", G.rect(F.col("b.x0"), F.col("b.y0"), F.col("b.x1"), F.col("b.y1")).alias("r"))
    return out.unionByName(blocks.where(~F.col("kind").isin("body", "region", "title")).select(*page, "id", "kind", "r"))


# --- text that an item may remove --------------------------------------------------------


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0)), F.lower)


def padded(r: Column, pad: tuple[float, float]) -> Column:
    return G.rect(r["x0"] - pad[0], r["y0"] - pad[1], r["x1"] + pad[0], r["y1"] + pad[1])


def enough_words(source: Column, n_found: Column, overlap: Column) -> Column:
    """Do texts share enough words?  ``source``: words of the item; ``overlap``: distinct words that both have."""
    n = F.size(source)
    least = F.when(n <= 3, 1).when(n <= 8, 2).otherwise(F.greatest(F.lit(2), F.floor(n * 0.3)))
    return F.when(n == 0, n_found >= 2).otherwise(overlap >= least)


def removable_text(items: DataFrame, spans: DataFrame, blocks: DataFrame, words: DataFrame, math: DataFrame, page: list[str]) -> DataFrame:
    """(page..., id, route, r): rectangles of the page's text that an item may remove, by the first of three ways that finds any.

    ``items``, ``spans``, ``blocks``, ``words``: page..., id, r, text; ``math``: page..., id, r.  Text belongs to the item whose center is nearest (of equal distances the smaller id; equal boxes share).  direct: exactly one own span has about the item's box.
    block: own blocks that share enough words with the item.  word: own words, if all of them together do; where the item's text has no word, its
    box (item), if there are two words.  Rectangles that meet math go; if the direct one does, the item has none.  Rectangles equal to a tenth of a point count once.
    Entries meet the boxes of their page as one array and everything after that stays on the page, so texts shuffle once.
    """
    entry = lambda t, kind, text: t.where(F.trim("text") != "").select(*page, F.lit(kind).alias("kind"), F.col("id").alias("e_id"), F.col("r").alias("er"), text.alias("e_text"))
    entries = entry(spans, "direct", F.lit(None).cast("string")).unionByName(entry(blocks, "block", F.col("text"))).unionByName(entry(words, "word", F.col("text")))
    pages = items.where(G.area(F.col("r")) > 0).groupBy(*page).agg(F.collect_list(F.struct("id", F.col("r").alias("rect"), "text")).alias("__items")).join(math.groupBy(*page).agg(F.collect_list("r").alias("__math")), page, "left")
    er = F.col("er")

    def holders(c: Column) -> Column:
        """Of the items around an entry's center those with the nearest box."""

        def far(i: Column) -> Column:
            dx, dy = G.center_x(i["rect"]) - c["x"], G.center_y(i["rect"]) - c["y"]
            return F.struct((dx * dx + dy * dy).alias("d"), i["id"].alias("id"), i["rect"].alias("rect"))

        inside = F.filter("__items", lambda i: G.contains_point(i["rect"], c["x"], c["y"]))
        contested = lambda m: let(F.array_min(F.transform(m, far))["rect"], lambda best: F.filter(m, lambda i: i["rect"] == best))
        return let(inside, lambda m: F.when(F.size(m) <= 1, m).otherwise(contested(m)))

    mine = let(F.struct(G.center_x(er).alias("x"), G.center_y(er).alias("y")), holders)
    own = entries.join(pages, page).select(*page, "kind", "e_id", "er", "e_text", "__math", F.explode(mine).alias("o"))
    rect = F.col("o.rect")
    w, h, ew, eh = rect["x1"] - rect["x0"], rect["y1"] - rect["y0"], er["x1"] - er["x0"], er["y1"] - er["y0"]
    error = lambda a, b: F.abs(b - a) / F.greatest(a, F.lit(1.0))
    like = G.contains_point(er, rect["x0"] + w / 2, rect["y0"] + h / 2) & (error(w, ew) <= SAFE_SIZE) & (error(h, eh) <= SAFE_SIZE) & (G.iou(rect, er) >= SAFE_IOU)
    meets = lambda r: F.coalesce(F.exists("__math", lambda m: G.overlap_area(r, m) > LEAST_AREA), F.lit(False))
    own = own.where((F.col("kind") != "direct") | like).withColumn("r", padded(er, WORD_PAD)).withColumn("hit", meets(F.col("r"))).withColumn("found", F.when(F.col("kind") != "direct", words_of(F.col("e_text"))))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    one = own.groupBy(*page, F.col("o.id").alias("id")).agg(
        F.first("o").alias("o"), F.first("__math").alias("__math"), F.array_sort(F.collect_list(of("direct", F.struct("e_id", "r", "hit")))).alias("direct"), F.array_sort(F.collect_list(of("word", F.struct("e_id", "r", "hit")))).alias("word"),
        F.array_sort(F.collect_list(of("block", F.struct("e_id", "r", "hit", "found")))).alias("blocks"), F.flatten(F.collect_list(of("word", F.col("found")))).alias("found"),
    )
    one = one.withColumn("source", words_of(F.col("o.text"))).withColumn("said", F.trim(F.coalesce("o.text", F.lit(""))) != "")
    fits = F.filter("blocks", lambda b: ~b["hit"] & F.col("said") & (F.size(b["found"]) > 0) & enough_words(F.col("source"), F.size(b["found"]), F.size(F.array_intersect(b["found"], "source"))))
    one = one.withColumn("block", F.transform(fits, lambda b: F.struct(b["e_id"].alias("e_id"), b["r"].alias("r"), b["hit"].alias("hit"))))
    passes = F.col("said") & (F.size("found") > 0) & enough_words(F.col("source"), F.size("found"), F.size(F.array_intersect("found", "source")))
    route = F.when(F.size("direct") == 1, "direct").when(F.size("block") > 0, "block").when(passes, F.when(F.size("source") > 0, "word").otherwise("item"))
    whole = padded(F.col("o.rect"), ITEM_PAD)
    kept = lambda c: F.filter(c, lambda x: ~x["hit"])
    item = F.array(F.struct(F.lit(0).cast("long").alias("e_id"), whole.alias("r"), meets(whole).alias("hit")))
    one = one.withColumn("route", route).where("route IS NOT NULL")
    parts = F.when(F.col("route") == "direct", F.col("direct")).when(F.col("route") == "block", F.col("block")).when(F.col("route") == "word", F.col("word")).otherwise(item)
    out = one.select(*page, "id", "route", F.inline(kept(parts))).drop("hit")
    return dedup_rects(out, [*page, "id"], "e_id").select(*page, "id", "route", "r")
