"""Reading-order analytics: continuation chains, context windows, anchors, runs, boundary roles.

A document is one window partition; every operator orders by (page_idx, block_idx).  Frames only grow forwards (looking ahead is
done over the reversed order), so each pass is linear in a document's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: Geometry of a pair of blocks.
COLUMN_STEP, COLUMN_GAP, COLUMN_SHIFT, ROW_GAP = 8, 96, 28, 40
WINDOW_NEIGHBOURS, WINDOW_CHARS = 2, 360


def _order(doc: str, ascending: bool = True):
    w = Window.partitionBy(doc)
    return w.orderBy("page_idx", "block_idx") if ascending else w.orderBy(F.desc("page_idx"), F.desc("block_idx"))


def pair_scores(p: Column, n: Column) -> tuple[Column, Column]:
    """(join score, break score) of a block and the next one; structs (page_idx, text, eligible, x0, y0, x1, y1), text normalised."""
    a, b = p["text"], n["text"]
    same = p["page_idx"] == n["page_idx"]
    cross = (n["x0"] > p["x1"] + COLUMN_STEP) & (n["x0"] - p["x1"] <= COLUMN_GAP)
    near = (F.abs(n["x0"] - p["x0"]) <= COLUMN_SHIFT) & (n["y0"] - p["y1"] <= ROW_GAP)
    geometry = F.when(n["x0"] > p["x1"] + COLUMN_STEP, cross).otherwise(near)
    starts, ends_at_stop = T.starts_like_continuation(b), a.rlike("[.!?:;]$")
    veto = (n["page_idx"] < p["page_idx"]) | (n["page_idx"] - p["page_idx"] > 1) | ~p["eligible"] | ~n["eligible"] | (same & (~geometry | (~cross & ~a.endswith("-"))))
    points = lambda cond, k: F.when(cond, k).otherwise(0)
    join = (
        points(starts, 3) + points(ends_at_stop & starts, 3) + points(T.ends_like_continuation(a), 3) + points(a.endswith("-"), 4) + points(a.endswith(","), 1)
        + points(T.last_token_is_suspicious(a), 1) + points(~same & ~ends_at_stop, 2) + points(same & cross, 2)
    )
    breaks = (
        F.when(a.rlike("[.!?]$"), 4).when(ends_at_stop, 2).otherwise(0) - points(starts, 3) + points(T.starts_like_heading_or_list(b), 3)
        + points(b.rlike("^[A-Z]") & ~starts, 1) + points(same & ~geometry, 2)
    )
    return F.when(veto, -999).otherwise(join), F.greatest(F.lit(0), breaks)


def decision(join: Column, breaks: Column) -> Column:
    return (
        F.when(join < 0, "break").when((join >= 4) & (join >= breaks + 2), "join").when((breaks >= 4) & (breaks >= join + 1), "break").otherwise("candidate")
    )


def review_verdict(join: Column, breaks: Column) -> Column:
    """What needs no review: a clear join (7 and 4 ahead), a clear break (6 and 3 ahead)."""
    return F.when((join >= 7) & (join >= breaks + 4), "auto_join").when((breaks >= 6) & (breaks >= join + 3), "drop").otherwise("review")


def continuation(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Adds next_pos, join_score, break_score, pair, continuation_group, continuation_decision, prev_id, next_id.

    ``blocks``: doc, item_id, page_idx, block_idx, text, eligible, provider_joined, x0, y0, x1, y1.  States the greedy single pass over a
    document as windows: the next block of each is the next eligible one not joined by the provider, at most one
    page on; chains are maximal runs of joining eligible blocks; the pass stops at the first block outside all chains
    with no next one; what lies inside a chain's span marks no candidate.
    """
    w, back = _order(doc), _order(doc, ascending=False)
    own = F.struct("page_idx", "block_idx", "item_id", F.col("t").alias("text"), "eligible", "x0", "y0", "x1", "y1", "pos")
    rows = blocks.withColumn("t", T.normalize_text(F.col("text"))).withColumn("pos", F.row_number().over(w)).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(doc)))
    free = F.col("eligible") & ~F.col("provider_joined")
    rows = rows.withColumn("self", own).withColumn("ahead", F.last(F.when(free, F.col("self")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("next", F.when(F.col("ahead.page_idx") - F.col("page_idx") <= 1, F.col("ahead")))
    join, breaks = pair_scores(F.col("self"), F.col("next"))
    rows = rows.withColumn("join_score", F.when(F.col("next").isNotNull(), join)).withColumn("break_score", F.when(F.col("next").isNotNull(), breaks))
    rows = rows.withColumn("pair", F.when(F.col("next").isNotNull() & ~F.col("provider_joined"), decision(F.col("join_score"), F.col("break_score"))))
    # chains: the edges that join, over eligible blocks in order
    joins = F.coalesce(F.col("pair") == "join", F.lit(False)) & free
    starts = rows.withColumn("joins", joins)
    joined_before = F.last(F.when(free, F.col("joins")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.withColumn("joined_before", F.coalesce(joined_before, F.lit(False)) & free)
    head = F.col("joins") & ~F.col("joined_before")
    tail = ~F.col("joins") & F.col("joined_before")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    starts = starts.withColumn("head", head).withColumn("tail", tail).withColumn("opened", F.sum(head.cast("int")).over(upto)).withColumn("closed", F.sum(tail.cast("int")).over(upto))
    inside = (F.col("opened") > F.col("closed")) | F.col("tail")
    stop = ~F.col("provider_joined") & F.col("next").isNull() & (F.col("pos") < F.col("size")) & ~inside
    marked = starts.withColumn("inside", inside).withColumn("stop", F.min(F.when(stop, F.col("pos"))).over(Window.partitionBy(doc)))
    before = F.coalesce(F.col("pos") < F.col("stop"), F.lit(True))
    # a chain lives where its head does
    member = free & (F.col("joins") | F.col("joined_before"))
    marked = marked.withColumn("head_at", F.last(F.when(F.col("head"), F.struct("pos", "page_idx", "opened")), ignorenulls=True).over(upto))
    alive = member & F.coalesce(F.col("head_at.pos") < F.col("stop"), F.lit(True))
    marked = marked.withColumn("alive", alive).withColumn("marks", (F.col("pair") == "candidate") & before & ~F.col("inside"))
    back_mark = F.last(F.when(free | F.col("marks"), F.struct("item_id", "marks", F.col("next.pos").alias("to"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("behind", back_mark)
    is_next = F.coalesce(F.col("behind.marks") & (F.col("behind.to") == F.col("pos")), F.lit(False))
    group = F.concat(F.lit("cg-"), F.lpad((F.col("head_at.page_idx") + 1).cast("string"), 3, "0"), F.lit("-"), F.lpad(F.col("head_at.opened").cast("string"), 3, "0"))
    return marked.select(
        doc, "item_id", "page_idx", "block_idx", F.col("next.item_id").alias("following_id"), "join_score", "break_score", "pair",
        F.when(F.col("alive"), group).otherwise("").alias("continuation_group"),
        F.when(F.col("provider_joined"), "provider_joined").when(F.col("alive"), "joined").when(F.col("marks") | is_next, "candidate_break").otherwise("").alias("continuation_decision"),
        F.when(is_next, F.col("behind.item_id")).alias("candidate_prev_id"),
        F.when(F.col("marks"), F.col("next.item_id")).alias("candidate_next_id"),
    )


def summarize_decisions(decided: DataFrame, *keys: str) -> DataFrame:
    n = lambda *v: F.sum(F.col("continuation_decision").isin(*v).cast("long"))
    return decided.groupBy(*keys).agg(
        n("provider_joined", "joined", "review_joined").alias("joined_items"), n("provider_joined").alias("provider_joined_items"), n("joined").alias("rule_joined_items"),
        n("review_joined").alias("review_joined_items"), n("candidate_break").alias("candidate_break_items"),
    )


def context_windows(blocks: DataFrame, doc: str = "doc_id", neighbours: int = WINDOW_NEIGHBOURS, limit: int = WINDOW_CHARS) -> DataFrame:
    """(doc, item_id, before, after): the texts of up to two textual, non-blank neighbours, across pages, cut at 360 characters."""
    w = _order(doc)
    rows = blocks.withColumn("t", T.normalize_text(F.col("text"))).where("is_textual AND t <> ''")
    cut = lambda c: F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.left(c, F.lit(limit - 1))), F.lit("...")))
    joined = lambda frame: cut(F.concat_ws(" / ", F.collect_list("t").over(frame)))
    return rows.select(doc, "item_id", joined(w.rowsBetween(-neighbours, -1)).alias("before"), joined(w.rowsBetween(1, neighbours)).alias("after"))


def previous_anchor(blocks: DataFrame, kinds: tuple[str, ...] = ("image", "table", "code", "formula"), doc: str = "doc_id", kind: str = "kind") -> DataFrame:
    """Adds anchor_id, anchor_kind: the last anchor block before each block."""
    found = F.last(F.when(F.col(kind).isin(*kinds), F.struct("item_id", kind)), ignorenulls=True).over(_order(doc).rowsBetween(Window.unboundedPreceding, -1))
    return blocks.withColumn("__a", found).withColumn("anchor_id", F.col("__a.item_id")).withColumn("anchor_kind", F.col(f"__a.{kind}")).drop("__a")


def runs(blocks: DataFrame, flag: Column, least: int, doc: str = "doc_id") -> DataFrame:
    """Adds run_id and run_size of maximal runs of flagged blocks on a page; null for blocks in runs shorter than ``least``."""
    w = Window.partitionBy(doc, "page_idx").orderBy("block_idx")
    rows = blocks.withColumn("__f", F.coalesce(flag, F.lit(False))).withColumn("__p", F.lag("__f", 1, False).over(w))
    rows = rows.withColumn("__r", F.sum((F.col("__f") & ~F.col("__p")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.when(F.col("__f"), 1)).over(Window.partitionBy(doc, "page_idx", "__r"))
    rows = rows.withColumn("__n", size)
    keep = F.col("__f") & (F.col("__n") >= least)
    return rows.withColumn("run_id", F.when(keep, F.col("__r"))).withColumn("run_size", F.when(keep, F.col("__n"))).drop("__f", "__p", "__r", "__n")


def boundary_role(rank: Column, size: Column) -> Column:
    """single, head, middle or tail of a 0-based rank."""
    return F.when(size <= 1, "single").when(rank == 0, "head").when(rank == size - 1, "tail").otherwise("middle")


def provider_groups(blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, group_id, scope, members, usable): groups that the layout provider joined, and whether their order can be trusted.

    Within a page: two or more members with distinct orders of 0 or more.  Across pages: as well, exactly two adjacent pages, one step
    from the first to the second.  ``blocks``: doc, page_idx, block_idx, eligible, source, scope, group_id, reading_order.
    """
    rows = blocks.where("eligible AND source = 'provider' AND trim(group_id) <> ''")
    w = Window.partitionBy(doc, "scope", "group_id").orderBy("reading_order", "page_idx", "block_idx")
    step = F.col("page_idx") - F.lag("page_idx").over(w)
    agg = rows.withColumn("step", step).groupBy(doc, "scope", "group_id").agg(
        F.count(F.lit(1)).alias("members"), F.countDistinct("reading_order").alias("orders"), F.min("reading_order").alias("least"), F.countDistinct("page_idx").alias("pages"),
        (F.max("page_idx") - F.min("page_idx")).alias("spread"), F.sum((F.col("step") == 1).cast("int")).alias("ups"), F.sum((~F.col("step").isin(0, 1)).cast("int")).alias("others"),
    )
    ordered = (F.col("members") >= 2) & (F.col("orders") == F.col("members")) & (F.col("least") >= 0)
    across = (F.col("pages") == 2) & (F.col("spread") == 1) & (F.col("ups") == 1) & (F.coalesce("others", F.lit(0)) == 0)
    return agg.select(doc, "group_id", "scope", "members", (ordered & F.when(F.col("scope") == "cross_page", across).otherwise(F.col("pages") == 1)).alias("usable"))
