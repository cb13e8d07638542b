"""Queries of two-column repair and of smoothing neighbouring bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import repair as R
from quire.operators import typeset as S
from quire.plans.tables import LINES_SQL, lines, q

PAGE = ["doc_id", "page_idx"]
WIDTH = 612.0

#: Lines as blocks of body size: 16 to a page, eight in each column.
_BLOCKS_SQL = f"""{LINES_SQL}, blocks AS (
    SELECT *, x0 + 250.0 - (line_no % 3) * 20.0 AS x1, y0 + 80.0 - (line_no % 4) * 5.0 AS y1 FROM (
        SELECT doc_id, line_no, text, line_no // 16 AS page_idx, doc_id * 1000000 + line_no AS item_id,
               (50.0 + 270.0 * ((line_no % 16) // 8) + (line_no % 5) * 4.0)::DOUBLE AS x0, (40.0 + 90.0 * (line_no % 8))::DOUBLE AS y0 FROM lines))"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("line_no")
    x0, y0 = F.floor(n % 16 / 8) * 270.0 + 50.0 + n % 5 * 4.0, n % 8 * 90.0 + 40.0
    rows = lines(spark, sf_dir).withColumn("page_idx", F.floor(n / 16)).withColumn("item_id", F.col("doc_id") * 1000000 + n)
    return rows.withColumn("r", G.rect(x0, y0, x0 + 250.0 - n % 3 * 20.0, y0 + 80.0 - n % 4 * 5.0))


def columns_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On some pages the right column's first block, or the fifth of the left one, was read into a block of the other column."""
    rows = _blocks(spark, sf_dir).withColumn("order", (F.col("line_no") % 16).cast("int"))
    w = Window.partitionBy(*PAGE).orderBy("order")
    page = F.col("doc_id") + F.col("page_idx")
    top, beside = F.pmod(page, F.lit(3)) == 0, F.pmod(page, F.lit(4)) == 1
    joined = F.when(top & (F.col("order") == 7), F.concat_ws(" ", "text", F.lead("text").over(w))).when(beside & (F.col("order") == 12), F.concat_ws(" ", "text", F.lag("text", 8).over(w)))
    lost = (top & (F.col("order") == 8)) | (beside & (F.col("order") == 4) & F.lead("order", 8).over(w).isNotNull())
    rows = rows.withColumn("text", F.when(lost, "").otherwise(F.coalesce(joined, "text")))
    first = F.when(F.col("line_no") == 0, "doc_title").when((F.col("line_no") == 1) & (F.col("doc_id") % 5 == 0), "abstract").when((F.length("text") < 25) & ~lost, "paragraph_title").otherwise("text")
    middle = (F.col("r.x0") + F.col("r.x1")) / 2
    rows = rows.withColumn("label", first).withColumn("column", F.when(middle <= WIDTH / 2, "left").otherwise("right"))
    return R.repair_columns(rows, PAGE).select("item_id", "repaired", "attempted", "applied", "role", "strategy", "peer_order", "split_index", "original_length")


def column_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).select(*PAGE, F.col("item_id").alias("id"), "r", (F.length("text") >= 40).alias("able"))
    return R.next_in_column(rows, PAGE).select(F.col("id").alias("item_id"), F.col("__k").cast("long").alias("place"), F.col("next").cast("long").alias("next_place"))


def bodies_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.col("line_no"), F.length("text")
    rows = _blocks(spark, sf_dir).select(
        *PAGE, F.col("item_id").alias("id"), "r", (size >= 40).alias("body"), (size % 31 != 3).alias("markdown"), T.english_word_count(F.col("text")).alias("source_words"), T.zh_char_count(F.col("text")).alias("zh_chars"),
        F.lit(230.0).alias("page_width_med"), (n % 7 * 0.25 + 9.0).alias("font"), (n % 5 * 0.06 + 0.44).alias("leading"), G.text_demand_units(F.col("text")).alias("units"), F.when(F.col("text").contains("$"), 0.95).otherwise(1.0).alias("discount"),
        (size % 11 == 0).alias("dense"), (size % 13 == 0).alias("fit"), (size % 29 == 0).alias("heavy"), (n % 3 + 12.0).alias("pitch"), F.ceil(size / 60).cast("int").alias("lines"), F.lit(None).cast("double").alias("space"), F.lit(None).cast("double").alias("leading_cap"),
    )
    return R.smooth_bodies(rows, PAGE).select(F.col("id").alias("item_id"), "smooth_font", "smooth_leading")


def leading_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size, r = F.col("line_no"), F.length("text"), F.col("r")
    font, units = n % 7 * 0.25 + 9.0, size * 0.5
    rows = _blocks(spark, sf_dir).select(
        "item_id", font.alias("font"), F.when(n % 6 > 0, n % 5 * 0.03 + 0.44).alias("leading"), G.required_lines(r, units, font).cast("double").alias("needed"), (r["y1"] - r["y0"]).alias("height"), F.when(n % 9 == 0, 0.95).otherwise(1.0).alias("discount"),
        F.when(n % 8 > 0, n % 13).alias("source_lines"), (n % 8 > 0).alias("has_lines"), (n % 4 * 4.0).alias("pitch"), F.when(n % 3 == 0, 0.6).alias("grown"),
    )
    return S.solved_leading(rows).select("item_id", "solution.leading_em", "solution.target_density", "solution.leading_cap_em")


def glued_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.col("line_no"), F.length("text")
    rows = _blocks(spark, sf_dir).select(
        *PAGE, F.col("item_id").alias("id"), "r", F.col("text").alias("source"), F.when(n % 19 == 7, " ").otherwise(F.col("text")).alias("rendered"), (n % 11 == 3).alias("grouped"), (n % 13 == 4).alias("direct_math"), F.col("text").contains("$").alias("with_formulas"),
        (n % 7 * 0.25 + 9.0).alias("font"), (n % 5 * 0.03 + 0.44).alias("leading"), (size * 0.5).alias("units"), F.lit(1.0).alias("discount"),
    )
    return S.glued_blocks(rows, PAGE)


QUERIES = {f.__name__: f for f in (columns_repaired, column_neighbours, bodies_smoothed, leading_solved, glued_texts)}


def _steps() -> str:
    """Six steps of the solver, each a table over the one before."""
    density = lambda ld: f"needed * greatest(font * 1.02, font * ({ld} + 1.0)) * discount / height"
    out = []
    for k in range(6):
        out.append(f"""t{k} AS (SELECT *, CASE WHEN NOT done AND high - low > 0.005 THEN low + (high - low) * CASE WHEN abs(lr - hr) <= 1e-9 THEN 0.5 ELSE greatest(0.12, least(0.88, lr / (lr - hr))) END END AS trial FROM s{k}),
        d{k} AS (SELECT *, {density("trial")} AS d, target - {density("trial")} AS rest FROM t{k}),
        s{k + 1} AS (SELECT * REPLACE (CASE WHEN trial IS NULL OR abs(rest) <= 0.002 THEN low WHEN d <= 0.985 AND rest >= 0 THEN trial ELSE low END AS low, CASE WHEN trial IS NOT NULL AND abs(rest) > 0.002 AND NOT (d <= 0.985 AND rest >= 0) THEN trial ELSE high END AS high,
            CASE WHEN trial IS NOT NULL AND abs(rest) > 0.002 AND d <= 0.985 AND rest >= 0 THEN rest ELSE lr END AS lr, CASE WHEN trial IS NOT NULL AND abs(rest) > 0.002 AND NOT (d <= 0.985 AND rest >= 0) THEN rest ELSE hr END AS hr,
            CASE WHEN trial IS NOT NULL AND d <= 0.985 AND rest >= 0 THEN trial ELSE best END AS best, trial IS NULL OR abs(rest) <= 0.002 AS done) FROM (SELECT * EXCLUDE (trial, d, rest), trial, d, rest FROM d{k})),
        s{k + 1}x AS (SELECT 1)""".replace(f"s{k + 1} AS", f"u{k} AS").replace(f"s{k + 1}x AS (SELECT 1)", f"s{k + 1} AS (SELECT * EXCLUDE (trial, d, rest) FROM u{k})"))
    return ",\n".join(out)


def _up(value: str, rate: float) -> str:
    return f"(1.0 - exp(greatest(0.0, {value}) * -{rate}))"


_LEADING = f"""WITH {_BLOCKS_SQL}, b AS (
    SELECT item_id, (9.0 + (line_no % 7) * 0.25)::DOUBLE AS font, CASE WHEN line_no % 6 > 0 THEN 0.44 + (line_no % 5) * 0.03 ELSE 0.0 END::DOUBLE AS own, (length(text) * 0.5)::DOUBLE AS units, greatest(8.0, x1 - x0) AS width, greatest(8.0, y1 - y0) AS height,
           CASE WHEN line_no % 9 = 0 THEN 0.95 ELSE 1.0 END::DOUBLE AS discount, CASE WHEN line_no % 8 > 0 THEN line_no % 13 ELSE 0 END AS sl, line_no % 8 > 0 AS has, (line_no % 4) * 4.0 AS pitch, CASE WHEN line_no % 3 = 0 THEN 0.6 ELSE 0.0 END::DOUBLE AS grown FROM blocks
), n AS (
    SELECT * REPLACE (font::DOUBLE AS font, height::DOUBLE AS height), CASE WHEN units <= 0 THEN 1.0 ELSE greatest(1.0, ceil(units / greatest(greatest(4.0, width / greatest(font * 0.92, 1.0)) * 0.98, 1.0))) END::DOUBLE AS needed,
           CASE WHEN pitch > 0 THEN greatest(0.0, least(1.02, pitch / font - 1.0)) ELSE 0.0 END::DOUBLE AS src, has AND sl > 0 AND sl <= 5 AS few FROM b
), c AS (
    SELECT *, CASE WHEN few THEN 0.70 WHEN needed <= 1 THEN 0.68 ELSE greatest(0.56, least(1.02, 0.68 + greatest({_up("needed - 9 + 1.0", 0.38)} * (CASE WHEN sl <= 0 THEN 0.74 ELSE 0.76 END::DOUBLE - 0.68), {_up("sl / greatest(1, needed) - 1.0", 0.7)} * (1.02::DOUBLE - 0.68),
           {_up("src", 1.1)} * (1.02::DOUBLE - 0.68)))) END::DOUBLE AS cap, CASE WHEN own = 0 THEN 0.44 ELSE own END::DOUBLE AS low0, {_up("needed - 1.0", 0.42)} AS weight,
           CASE WHEN needed <= 2 THEN 0.72 WHEN NOT has THEN 0.68 WHEN few THEN 0.78 ELSE 0.80 END::DOUBLE AS target FROM n
), e AS (
    SELECT *, greatest(low0, cap) AS high0, greatest(CASE WHEN grown > 0 THEN 0.04 ELSE 0.0 END::DOUBLE, weight * 0.10 + {_up("needed - 2.0", 2.1)} * 0.08 + greatest(CASE WHEN has THEN {_up("sl - 6.0", 0.45)} ELSE 0.0 END, {_up("src - 0.56", 3.2)}) * 0.28 - {_up("grown", 1.8)} * 0.20) AS budget FROM c
), f AS (SELECT *, CASE WHEN grown <= 0 THEN low0 ELSE greatest(low0, least(high0, low0 + {_up("grown", 1.8)} * 0.12 * weight)) END AS paired FROM e
), g AS (SELECT *, greatest(paired, least(high0, low0 + budget)) AS top, needed * greatest(font * 1.02, font * (own + 1.0)) * discount / height AS d0, needed * greatest(font * 1.02, font * (paired + 1.0)) * discount / height AS dp FROM f
), s0 AS (SELECT *, paired AS low, top AS high, target - dp AS lr, target - needed * greatest(font * 1.02, font * (top + 1.0)) * discount / height AS hr, paired AS best, false AS done FROM g
), {_steps()}
SELECT item_id, CASE WHEN ok THEN round(greatest(own, best), 2) END AS leading_em, CASE WHEN ok THEN round(target, 3) END AS target_density, CASE WHEN ok THEN round(cap, 2) END AS leading_cap_em FROM (SELECT *, d0 <= 0.985 AND d0 < 0.60 AND dp < target AS ok FROM s6)"""

_GLUED = f"""WITH {_BLOCKS_SQL}, n AS (
    SELECT *, lead(item_id) OVER w AS next_id, lead(x0) OVER w AS nx0, lead(x1) OVER w AS nx1, lead(y0) OVER w AS ny0, length(regexp_replace(text, '[\\s\\pZ]', '', 'g')) AS chars, (9.0 + (line_no % 7) * 0.25)::DOUBLE AS font, (0.44 + (line_no % 5) * 0.03)::DOUBLE AS ld, (length(text) * 0.5)::DOUBLE AS units
    FROM blocks WHERE trim(CASE WHEN line_no % 19 = 7 THEN ' ' ELSE text END) <> '' WINDOW w AS (PARTITION BY doc_id, page_idx ORDER BY y0, x0, item_id)
), m AS (
    SELECT *, chars / greatest(1.0, y1 - y0) AS ratio, greatest(0.0, least(x1, nx1) - greatest(x0, nx0)) / greatest(1.0, least(x1 - x0, nx1 - nx0)) AS overlap, ny0 - y1 AS gap, ny0 - y0 - 0.9 AS allowed,
           (CASE WHEN units <= 0 THEN 1 ELSE greatest(1, ceil(units / greatest(greatest(4.0, greatest(8.0, x1 - x0) / greatest(font * 0.92, 1.0)) * 0.98, 1.0))) END) * greatest(font * 1.02, font * (ld + 1.0)) AS tall
    FROM n WHERE next_id IS NOT NULL AND NOT (line_no % 11 = 3 OR line_no % 13 = 4 OR contains(text, '$')) AND chars >= 1000)
SELECT doc_id, page_idx, item_id AS id, next_id, chars AS source_chars, ratio AS char_height_ratio, overlap AS width_overlap_ratio, gap AS source_gap, tall AS estimated_height, allowed AS allowed_height, tall / allowed AS overflow_ratio
FROM m WHERE ratio >= 15 AND overlap >= 0.6 AND gap BETWEEN 0 AND 28 AND allowed > 0 AND tall > allowed * 1.25"""

SQL = {
    "leading_solved": _LEADING,
    "glued_texts": _GLUED,
    "column_neighbours": f"""WITH {_BLOCKS_SQL}, able AS (
        SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY y0, x0, item_id) - 1 AS place, greatest(8, x1 - x0) AS w, greatest(8, y1 - y0) AS h FROM blocks WHERE length(text) >= 40
    ), pairs AS (
        SELECT a.item_id, arg_min(b.place, (greatest(-4.0, b.y0 - a.y1), abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2), b.place)) AS next_place
        FROM able a JOIN able b ON a.doc_id = b.doc_id AND a.page_idx = b.page_idx AND b.place > a.place
        WHERE b.y0 >= a.y0 AND least(a.w, b.w) / greatest(a.w, b.w) >= 0.72 AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) / least(a.w, b.w) >= 0.64
          AND b.y0 - a.y1 >= -4 AND b.y0 - a.y1 <= greatest(42, least(a.h, b.h) * 0.45)
          AND (abs(a.x0 - b.x0) <= greatest(18, greatest(a.w, b.w) * 0.06) OR abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) <= greatest(22, greatest(a.w, b.w) * 0.08)) GROUP BY a.item_id
    ) SELECT b.item_id, a.place, p.next_place FROM blocks b LEFT JOIN able a ON a.item_id = b.item_id LEFT JOIN pairs p ON p.item_id = b.item_id"""
}
