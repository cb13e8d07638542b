"""Queries of layout and geometry operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.operators import layout as L
from quire.plans.tables import ITEMS_SQL, box, items, s_has

PAGE = ["doc_id", "page_idx"]


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumn("block_idx", F.col("line_no")).withColumn("flow", F.trim("text") != "").drop("line_no")


def page_layout_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_layout(_blocks(spark, sf_dir), *PAGE)


def zone_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = L.zones(_blocks(spark, sf_dir), *PAGE)
    return out.select("item_id", "layout_mode", "layout_zone", F.col("layout_zone_rank").cast("long").alias("layout_zone_rank"), F.col("layout_zone_size").cast("long").alias("layout_zone_size"), "layout_boundary_role")


def page_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).withColumn("height", F.col("y1") - F.col("y0") - F.when(F.length("text") < 20, 12).otherwise(0))
    out = L.positive_percentiles(rows, PAGE, "height", 0.35, 0.5)
    return out.withColumns({c: F.round(c, 6) for c in ("p35", "p50")})


def body_font_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _blocks(spark, sf_dir).withColumn("font", F.round(F.length("text") % 50 / 4 + 3, 2))
    return L.floor_quantile(L.without_extremes(sized, ["doc_id"], "font"), ["doc_id"], "font", 0.25)


def collision_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).withColumn("y1", F.col("y1") + F.when(F.length("text") > 200, 15.0).otherwise(0.0))
    return L.collisions(rows, *PAGE).withColumn("overlap", F.round("overlap", 6))


def ocr_block_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ocr_profile(_blocks(spark, sf_dir), *PAGE, page_area=F.lit(612.0 * 792.0))


def capacity_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, font, lead = box(), F.lit(Decimal("10.0")), F.lit(0.4)
    rows = items(spark, sf_dir).withColumn("demand", G.text_demand_units(F.col("text")))
    return rows.select(
        "item_id", F.round(G.box_capacity_units(r, font, lead), 4).alias("capacity"), F.round("demand", 4).alias("demand"),
        G.required_lines(r, F.col("demand"), font).cast("long").alias("n_lines"), F.round(G.required_lines(r, F.col("demand"), font) * G.line_step(font, lead), 4).alias("height"),
    )


def _regions(rows: DataFrame) -> DataFrame:
    """Boxes of pairs of neighbouring lines, shifted: they overlap the lines and each other."""
    r = G.rect(F.col("x0") + 30, F.col("y0") - 10, F.col("x1") + 90, F.col("y1") + 30)
    return rows.where("line_no % 2 = 0").select(*PAGE, F.col("item_id").alias("id"), r.alias("r"))


def rect_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    return L.rect_overlaps(rows.select(*PAGE, F.col("item_id").alias("id"), box().alias("r")), _regions(rows), PAGE)


def word_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    return L.owners(rows.select(*PAGE, F.col("item_id").alias("id"), box().alias("r")), _regions(rows), PAGE)


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(*PAGE).orderBy("line_no")
    rows = items(spark, sf_dir).withColumn("r", box()).withColumn("n", F.lead("r").over(w)).where("n IS NOT NULL")
    near = G.rect(F.col("n.x0"), F.col("r.y0") + F.when(F.length("text") % 3 == 0, 2.0).otherwise(20.0), F.col("n.x1"), F.col("r.y1") + 3.0)
    return rows.withColumn("m", near).select("item_id", F.coalesce(G.should_merge(F.col("r"), F.col("m")), F.lit(False)).alias("merges"), G.area(F.col("r")).alias("area"), G.overlap_area(F.col("r"), F.col("m")).alias("inter"))


def rects_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    twice = rows.select("doc_id", "item_id", box().alias("r")).unionByName(rows.select("doc_id", (F.col("item_id") + 500000).alias("item_id"), box().alias("r")))
    return L.dedup_rects(twice, ["doc_id"], "item_id").select("doc_id", "item_id")


def pages_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).withColumn("page_width", F.lit(612.0)).withColumn("page_height", F.lit(792.0))
    sizes = rows.select(*PAGE).distinct().withColumn("pdf_width", F.when(F.col("page_idx") % 2 == 0, 612.0).otherwise(595.0)).withColumn("pdf_height", F.when(F.col("page_idx") % 2 == 0, 792.0).otherwise(842.0))
    out = L.rescale(rows, sizes, PAGE)
    return out.select("item_id", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


QUERIES = {
    f.__name__: f
    for f in (page_layout_mode, zone_ranks, page_baselines, body_font_target, collision_pairs, ocr_block_profile, capacity_units, rect_iou_pairs, word_ownership, merge_candidates, rects_deduped, pages_rescaled)
}

_LAYOUT = f"""WITH {ITEMS_SQL}, flow AS (SELECT *, (x0 + x1) / 2 AS c FROM items WHERE trim(text) <> ''),
    gaps AS (SELECT *, lead(c) OVER w - c AS gap, (lead(c) OVER w + c) / 2 AS mid, row_number() OVER w AS k FROM flow WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY c, line_no)),
    best AS (SELECT doc_id, page_idx, gap, mid FROM gaps WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY gap DESC, k) = 1),
    stats AS (SELECT f.doc_id, f.page_idx, count(*) AS n_flow, max(x1) - min(x0) AS w, quantile_cont(x1 - x0, 0.5) AS median_width, count(*) FILTER (c < b.mid) AS n_left, any_value(b.gap) AS gap, any_value(b.mid) AS mid
              FROM flow f LEFT JOIN best b USING (doc_id, page_idx) GROUP BY ALL),
    found AS (SELECT *, coalesce(n_flow >= 6 AND w > 0 AND gap >= w * 0.18 AND n_left >= 3 AND n_flow - n_left >= 3, false) AS is_double FROM stats),
    pages AS (SELECT doc_id, page_idx, max(x1) - min(x0) AS width FROM items GROUP BY ALL),
    layouts AS (SELECT p.doc_id, p.page_idx, CASE WHEN is_double THEN 'double' ELSE 'single' END AS layout_mode, CASE WHEN is_double THEN mid ELSE 0.0 END AS split_x, coalesce(median_width, 0.0)::DOUBLE AS median_width, width, coalesce(n_flow, 0) AS n_flow
                FROM pages p LEFT JOIN found f USING (doc_id, page_idx))"""
_REGIONS = f"""WITH {ITEMS_SQL}, regions AS (SELECT doc_id, page_idx, item_id, x0 + 30 AS x0, y0 - 10 AS y0, x1 + 90 AS x1, y1 + 30 AS y1 FROM items WHERE line_no % 2 = 0)"""
_demand = """list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*'), lambda w: greatest(1.0, length(w) * 0.55)))"""
_gapped = """list_sum(list_transform(regexp_extract_all(text, '\\s+'), lambda w: greatest(0.2, length(w) * 0.25)))"""
_other = """length(regexp_replace(regexp_replace(text, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)*', '', 'g'), '[\\s一-鿿]', '', 'g')) * 0.45"""

SQL = {
    "page_layout_mode": f"{_LAYOUT} SELECT * FROM layouts",
    "zone_ranks": f"""{_LAYOUT}, z AS (
            SELECT i.*, l.layout_mode, CASE WHEN trim(text) = '' THEN 'non_flow' WHEN layout_mode <> 'double' THEN 'single_column'
                WHEN greatest(median_width * 1.45, width * 0.78) > 0 AND width > 0 AND x1 - x0 >= greatest(median_width * 1.45, width * 0.78) THEN 'full_width'
                WHEN (x0 + x1) / 2 < split_x THEN 'left_column' ELSE 'right_column' END AS layout_zone
            FROM items i JOIN layouts l USING (doc_id, page_idx)
        ), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx, layout_zone ORDER BY y0, x0, line_no) - 1 AS k, count(*) OVER (PARTITION BY doc_id, page_idx, layout_zone) AS n FROM z)
        SELECT item_id, layout_mode, layout_zone, CASE WHEN layout_zone = 'non_flow' THEN -1 ELSE k END AS layout_zone_rank, CASE WHEN layout_zone = 'non_flow' THEN 0 ELSE n END AS layout_zone_size,
               CASE WHEN layout_zone = 'non_flow' THEN '' WHEN n = 1 THEN 'single' WHEN k = 0 THEN 'head' WHEN k = n - 1 THEN 'tail' ELSE 'middle' END AS layout_boundary_role FROM r""",
    "page_baselines": f"""WITH {ITEMS_SQL}, h AS (SELECT doc_id, page_idx, (y1 - y0 - CASE WHEN length(text) < 20 THEN 12 ELSE 0 END)::DOUBLE AS h FROM items)
        SELECT doc_id, page_idx, round(quantile_cont(h, 0.35) FILTER (h > 0), 6) AS p35, round(quantile_cont(h, 0.5) FILTER (h > 0), 6) AS p50, count(*) FILTER (h > 0) AS n_positive FROM h GROUP BY ALL""",
    "body_font_target": f"""WITH {ITEMS_SQL}, s AS (SELECT doc_id, round((length(text) % 50) / 4 + 3, 2) AS font FROM items), m AS (SELECT doc_id, quantile_cont(font, 0.5) AS m FROM s GROUP BY 1),
        o AS (SELECT s.*, font >= m * 0.6 AS ok FROM s JOIN m USING (doc_id)), c AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY doc_id) AS c FROM o), k AS (SELECT doc_id, font FROM c WHERE ok OR c < 3),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY font) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM k)
        SELECT doc_id, font AS quantile FROM r WHERE r = floor((n - 1) * 0.25) + 1""",
    "collision_pairs": f"""WITH {ITEMS_SQL}, s AS (SELECT * REPLACE (y1 + CASE WHEN length(text) > 200 THEN 15.0 ELSE 0.0 END AS y1) FROM items),
        n AS (SELECT *, lead(item_id) OVER w AS next_id, lead(x0) OVER w AS nx0, lead(x1) OVER w AS nx1, lead(y0) OVER w AS ny0 FROM s WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY y0, x0, line_no)),
        o AS (SELECT *, greatest(0.0, least(x1, nx1) - greatest(x0, nx0)) / greatest(1.0, least(x1 - x0, nx1 - nx0)) AS overlap, ny0 - y1 AS gap FROM n WHERE next_id IS NOT NULL)
        SELECT doc_id, page_idx, item_id, next_id, round(overlap, 6) AS overlap, gap FROM o WHERE overlap >= 0.6 AND gap <= 3.0""",
    "ocr_block_profile": f"WITH {ITEMS_SQL} SELECT doc_id, page_idx, count(*) AS block_count, count(*) FILTER ((x1 - x0) * (y1 - y0) > 0) AS valid_boxes, sum((x1 - x0) * (y1 - y0)) AS area, round(sum((x1 - x0) * (y1 - y0)) / (612.0 * 792.0), 4) AS area_ratio FROM items GROUP BY ALL",
    "capacity_units": f"""WITH {ITEMS_SQL}, d AS (SELECT *, coalesce({_demand}, 0) + coalesce({_gapped}, 0) + len(regexp_extract_all(text, '[一-鿿]')) + {_other} AS demand_, greatest(4.0, greatest(8.0, x1 - x0) / 9.2) AS per FROM items),
        l AS (SELECT *, demand_::DOUBLE AS demand, CASE WHEN demand_ <= 0 THEN 1 ELSE greatest(1, ceil(demand_ / greatest(per * 0.98, 1.0))) END AS n FROM d)
        SELECT item_id, round(greatest(1, floor(greatest(8.0, y1 - y0) / 14.0)) * per * 0.98, 4) AS capacity, round(demand, 4) AS demand, n::BIGINT AS n_lines, round(n * 14.0, 4) AS height FROM l""",
    "rect_iou_pairs": f"""{_REGIONS}, p AS (SELECT a.doc_id, a.page_idx, a.item_id AS a_id, b.item_id AS b_id, greatest(0.0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter,
            (a.x1 - a.x0) * (a.y1 - a.y0) AS sa, (b.x1 - b.x0) * (b.y1 - b.y0) AS sb FROM items a JOIN regions b USING (doc_id, page_idx))
        SELECT doc_id, page_idx, a_id, b_id, inter, round(inter / (sa + sb - inter), 6) AS iou FROM p WHERE inter > 0""",
    "word_ownership": f"""{_REGIONS}, m AS (SELECT a.doc_id, a.page_idx, a.item_id AS word_id, b.item_id AS owner_id, ((b.x0 + b.x1) / 2 - (a.x0 + a.x1) / 2) ** 2 + ((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2) ** 2 AS d
            FROM items a JOIN regions b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND (a.x0 + a.x1) / 2 BETWEEN b.x0 AND b.x1 AND (a.y0 + a.y1) / 2 BETWEEN b.y0 AND b.y1)
        SELECT doc_id, page_idx, word_id, owner_id FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, page_idx, word_id ORDER BY d, owner_id) = 1""",
    "merge_candidates": f"""WITH {ITEMS_SQL}, n AS (SELECT *, lead(x0) OVER w AS nx0, lead(x1) OVER w AS nx1, y0 + CASE WHEN length(text) % 3 = 0 THEN 2.0 ELSE 20.0 END AS my0, y1 + 3.0 AS my1 FROM items WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY line_no)),
        a AS (SELECT *, (x1 - x0) * (y1 - y0) AS area, greatest(0.0, nx1 - nx0) * greatest(0.0, my1 - my0) AS marea, greatest(0.0, least(x1, nx1) - greatest(x0, nx0)) * greatest(0.0, least(y1, my1) - greatest(y0, my0)) AS inter,
            (greatest(x1, nx1) - least(x0, nx0)) * (greatest(y1, my1) - least(y0, my0)) AS uni, abs(y0 - my0) <= 6 AND abs(y1 - my1) <= 6 AS same_row, greatest(0.0, greatest(x0, nx0) - least(x1, nx1)) AS hgap FROM n WHERE nx0 IS NOT NULL)
        SELECT item_id, area + marea > 0 AND uni <= 2.4 * (area + marea) AND CASE WHEN inter > 0 THEN same_row OR inter / greatest(1.0, least(area, marea)) >= 0.8 ELSE same_row AND hgap <= 3 END AS merges, area, inter FROM a""",
    "rects_deduped": f"""WITH {ITEMS_SQL}, t AS (SELECT doc_id, item_id, x0, y0, x1, y1 FROM items UNION ALL SELECT doc_id, item_id + 500000, x0, y0, x1, y1 FROM items)
        SELECT doc_id, item_id FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, round(x0 * 10), round(y0 * 10), round(x1 * 10), round(y1 * 10) ORDER BY item_id) = 1""",
    "pages_rescaled": f"""WITH {ITEMS_SQL}, k AS (SELECT *, CASE WHEN page_idx % 2 = 0 THEN 1.0 ELSE 595.0 / 612.0 END AS sx, CASE WHEN page_idx % 2 = 0 THEN 1.0 ELSE 842.0 / 792.0 END AS sy FROM items)
        SELECT item_id, round(x0 * sx, 4) AS x0, round(y0 * sy, 4) AS y0, round(x1 * sx, 4) AS x1, round(y1 * sy, 4) AS y1 FROM k""",
}
