"""Page layout statistics: column detection, zones, baselines, collisions, profiles, rectangle joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators.reading_order import boundary_role

#: Fixed values.
COLUMN_ITEMS, GAP_RATIO, FULL_WIDTH, FULL_MEDIAN = 3, 0.18, 0.78, 1.45


def page_layout(blocks: DataFrame, *page: str) -> DataFrame:
    """(page..., layout_mode, split_x, median_width, width, n_flow): two columns where the largest gap between block centers is wide.

    ``blocks``: page..., block_idx, flow (may be laid out), x0, x1.  Of equally wide gaps the first counts; at least three
    blocks must lie on either side.
    """
    center = (F.col("x0") + F.col("x1")) / 2
    w = Window.partitionBy(*page).orderBy("c", "block_idx")
    flow = blocks.where("flow").withColumn("c", center)
    gaps = flow.withColumn("gap", F.lead("c").over(w) - F.col("c")).withColumn("k", F.row_number().over(w)).withColumn("mid", (F.lead("c").over(w) + F.col("c")) / 2)
    best = F.max(F.struct("gap", (-F.col("k")).alias("k"), "mid")).alias("best")
    stats = gaps.groupBy(*page).agg(
        best, F.count(F.lit(1)).alias("n_flow"), (F.max("x1") - F.min("x0")).alias("w"), F.percentile(F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")), 0.5).alias("median_width"), F.array_sort(F.collect_list("c")).alias("cs"),
    )
    left = F.size(F.filter("cs", lambda c: c < F.col("best.mid")))
    double = (F.col("n_flow") >= 2 * COLUMN_ITEMS) & (F.col("w") > 0) & (F.col("best.gap") >= F.col("w") * GAP_RATIO) & (left >= COLUMN_ITEMS) & (F.col("n_flow") - left >= COLUMN_ITEMS)
    double = F.coalesce(double, F.lit(False))
    all_pages = blocks.groupBy(*page).agg(F.greatest(F.lit(0.0), F.max("x1") - F.min("x0")).alias("width"))
    found = stats.select(*page, "n_flow", "median_width", F.when(double, "double").otherwise("single").alias("layout_mode"), F.when(double, F.col("best.mid")).otherwise(0.0).alias("split_x"))
    return all_pages.join(found, list(page), "left").select(
        *page, F.coalesce("layout_mode", F.lit("single")).alias("layout_mode"), F.coalesce("split_x", F.lit(0.0)).alias("split_x"), F.coalesce("median_width", F.lit(0.0)).alias("median_width"), "width",
        F.coalesce("n_flow", F.lit(0)).cast("long").alias("n_flow"),
    )


def zones(blocks: DataFrame, *page: str) -> DataFrame:
    """Adds layout_mode, layout_split_x, layout_zone, layout_zone_rank, layout_zone_size, layout_boundary_role."""
    full = F.when(F.col("width") > 0, F.greatest(F.col("median_width") * FULL_MEDIAN, F.col("width") * FULL_WIDTH)).otherwise(0.0)
    rows = blocks.join(page_layout(blocks, *page), list(page)).withColumn("full", full)
    wide = (F.col("full") > 0) & (F.greatest(F.lit(0.0), F.col("x1") - F.col("x0")) >= F.col("full"))
    column = F.when((F.col("x0") + F.col("x1")) / 2 < F.col("split_x"), "left_column").otherwise("right_column")
    zone = F.when(~F.col("flow"), "non_flow").when(F.col("layout_mode") != "double", "single_column").when(wide, "full_width").otherwise(column)
    rows = rows.withColumn("layout_zone", zone)
    w = Window.partitionBy(*page, "layout_zone")
    rank, size = F.row_number().over(w.orderBy("y0", "x0", "block_idx")) - 1, F.count(F.lit(1)).over(w)
    flow = F.col("layout_zone") != "non_flow"
    return (
        rows.withColumn("layout_split_x", F.round("split_x", 2))
        .withColumn("layout_zone_rank", F.when(flow, rank).otherwise(-1))
        .withColumn("layout_zone_size", F.when(flow, size).otherwise(0))
        .withColumn("layout_boundary_role", F.when(flow, boundary_role(rank, size)).otherwise(""))
        .drop("full", "split_x", "median_width", "width", "n_flow")
    )


def positive_percentiles(rows: DataFrame, keys: list[str], value: str, *shares: float) -> DataFrame:
    """Linear percentiles of the positive values; null where there are none."""
    v = F.when(F.col(value) > 0, F.col(value))
    return rows.groupBy(*keys).agg(*[F.percentile(v, s).alias(f"p{round(s * 100)}") for s in shares], F.count(v).alias("n_positive"))


def floor_quantile(rows: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """The value at index floor((n - 1) * share) of the sorted values."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("__k", F.row_number().over(w.orderBy(value))).withColumn("__n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("__k") == F.floor((F.col("__n") - 1) * share) + 1).select(*keys, F.col(value).alias("quantile"))


def without_extremes(rows: DataFrame, keys: list[str], value: str, share: float = 0.6, least: int = 3) -> DataFrame:
    """Rows whose value is not under ``share`` of the group's median, unless fewer than ``least`` would be left."""
    med = rows.groupBy(*keys).agg(F.percentile(value, 0.5).alias("__m"))
    marked = rows.join(med, keys).withColumn("__ok", F.col(value) >= F.col("__m") * share)
    kept = F.count(F.when(F.col("__ok"), 1)).over(Window.partitionBy(*keys))
    return marked.withColumn("__c", kept).where(F.col("__ok") | (F.col("__c") < least)).drop("__m", "__ok", "__c")


def collisions(blocks: DataFrame, *page: str, min_overlap: float = 0.6, max_gap: float = 3.0) -> DataFrame:
    """Pairs of a block and the next one by (y, x) that overlap horizontally and lie close."""
    w = Window.partitionBy(*page).orderBy("y0", "x0", "block_idx")
    box = G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    rows = blocks.withColumn("r", box).withColumn("n", F.lead("r").over(w)).withColumn("next_id", F.lead("item_id").over(w)).where("n IS NOT NULL")
    rows = rows.withColumn("overlap", G.x_overlap_ratio(F.col("r"), F.col("n"))).withColumn("gap", F.col("n.y0") - F.col("r.y1"))
    return rows.where((F.col("overlap") >= min_overlap) & (F.col("gap") <= max_gap)).select(*page, "item_id", "next_id", "overlap", "gap")


def ocr_profile(blocks: DataFrame, *page: str, page_area: Column) -> DataFrame:
    """(page..., block_count, valid_boxes, area, area_ratio)."""
    a = G.area(G.rect(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    agg = blocks.groupBy(*page).agg(F.count(F.lit(1)).alias("block_count"), F.count(F.when(a > 0, 1)).alias("valid_boxes"), F.sum(a).alias("area"))
    return agg.withColumn("area_ratio", F.round(F.col("area") / page_area, 4))


def _cells(rows: DataFrame, prefix: str, cell: float) -> DataFrame:
    x = F.sequence(F.floor(F.col(f"{prefix}.x0") / cell), F.floor(F.col(f"{prefix}.x1") / cell))
    return rows.withColumn("cx", F.explode(x)).withColumn("cy", F.explode(F.sequence(F.floor(F.col(f"{prefix}.y0") / cell), F.floor(F.col(f"{prefix}.y1") / cell))))


def rect_overlaps(left: DataFrame, right: DataFrame, page: list[str], cell: float = 100.0) -> DataFrame:
    """Overlapping rectangles (page..., a_id, b_id, inter, iou) of two tables (page..., id, r) by a join on grid cells.

    A pair that shares several cells is met in the cell of its overlap's upper left corner only, so none repeats.
    """
    a = _cells(left.select(*page, F.col("id").alias("a_id"), F.col("r").alias("ra")), "ra", cell)
    b = _cells(right.select(*page, F.col("id").alias("b_id"), F.col("r").alias("rb")), "rb", cell)
    met = a.join(b, [*page, "cx", "cy"]).withColumn("inter", G.overlap_area(F.col("ra"), F.col("rb")))
    first = (F.col("cx") == F.floor(F.greatest("ra.x0", "rb.x0") / cell)) & (F.col("cy") == F.floor(F.greatest("ra.y0", "rb.y0") / cell))
    return met.where((F.col("inter") > 0) & first).select(*page, "a_id", "b_id", "inter", F.round(G.iou(F.col("ra"), F.col("rb")), 6).alias("iou"))


def owners(words: DataFrame, regions: DataFrame, page: list[str], cell: float = 100.0) -> DataFrame:
    """For each word whose center lies in regions the one with the nearest center (of equal distances the smaller id)."""
    w = words.select(*page, F.col("id").alias("word_id"), G.center_x(F.col("r")).alias("x"), G.center_y(F.col("r")).alias("y"))
    w = w.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    g = _cells(regions.select(*page, F.col("id").alias("owner_id"), F.col("r").alias("rg")), "rg", cell)
    met = w.join(g, [*page, "cx", "cy"]).where(G.contains_point(F.col("rg"), F.col("x"), F.col("y")))
    dx, dy = G.center_x(F.col("rg")) - F.col("x"), G.center_y(F.col("rg")) - F.col("y")
    return met.groupBy(*page, "word_id").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), F.col("owner_id").alias("o"))).alias("m")).select(*page, "word_id", F.col("m.o").alias("owner_id"))


def dedup_rects(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rectangles equal to a tenth of a point the first."""
    tenth = [F.round(F.col(f"r.{c}") * 10).cast("long").alias(f"k{c}") for c in ("x0", "y0", "x1", "y1")]
    marked = rows.select("*", *tenth)
    w = Window.partitionBy(*keys, "kx0", "ky0", "kx1", "ky1").orderBy(order)
    return marked.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "kx0", "ky0", "kx1", "ky1")


def rescale(blocks: DataFrame, sizes: DataFrame, page: list[str], slack: float = 0.01) -> DataFrame:
    """Boxes scaled from their page's size to that in ``sizes`` (page..., pdf_width, pdf_height); within 1 % on both axes as they are."""
    sx, sy = F.col("pdf_width") / F.col("page_width"), F.col("pdf_height") / F.col("page_height")
    same = (F.abs(sx - 1) <= slack) & (F.abs(sy - 1) <= slack)
    by = lambda c, s: F.when(same, F.col(c)).otherwise(F.col(c) * s).alias(c)
    others = [c for c in blocks.columns if c not in ("x0", "y0", "x1", "y1", "page_width", "page_height")]
    return blocks.join(sizes, page).select(*others, by("x0", sx), by("y0", sy), by("x1", sx), by("y1", sy))
