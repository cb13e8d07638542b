"""Queries of functions with order-dependent steps, and of the external-model hook."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import spans as S
from quire.functions import text as T
from quire.operators.models import translate
from quire.plans.corpus import GLOSSARY
from quire.plans.tables import ITEMS_SQL, items, q, s_norm, table

TERMS = [(s, t, level, mode) for _, s, t, level, mode, _ in GLOSSARY if t]


def protect_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("item_id", S.protect_udf(TERMS)("text").alias("p"))
    return rows.select("item_id", "p.protected", F.size("p.tokens").alias("n_tokens"), F.array_join(F.transform("p.tokens", lambda t: t["token_tag"]), ",").alias("tags"))


#: Characters without which a line holds no formula.
FORMULA_SIGNS = r"[$_^\\]"


def _restored(rows: DataFrame) -> DataFrame:
    keep = [t for t in TERMS if t[2] == "preserve"]
    return rows.select("item_id", S.protect_udf(keep)("text").alias("p")).select("item_id", S.restore_udf("p.protected", "p.tokens").alias("restored"))


def restore_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preserved terms restore to the text itself, in lines without formulas; restore_formulas has the others."""
    return _restored(items(spark, sf_dir).where(~F.col("text").rlike(FORMULA_SIGNS)))


def restore_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that may hold a formula: formulas come back as inline math, so the text may not be what it was."""
    return _restored(items(spark, sf_dir).where(F.col("text").rlike(FORMULA_SIGNS)))


def segments_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines as segments: short ones, and those with a sign of a formula, count as inline equations."""
    kind = lambda t: F.when((F.length(t) <= 24) | t.rlike(r"[_^\\{}]"), "inline_equation").otherwise("text")
    parts = F.transform(F.split("text", "\n"), lambda t: F.struct(kind(t).alias("kind"), t.alias("content")))
    docs = table(spark, sf_dir, "documents").select("doc_id", S.protect_segments_udf(TERMS)(parts).alias("p"))
    return docs.select("doc_id", F.sha2("p.protected", 256).alias("sha"), F.size("p.tokens").alias("n_tokens"), F.array_join(F.transform("p.tokens", lambda t: t["token_tag"]), ",").alias("tags"))


def formulas_reprotected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines protected, restored, and protected again by their own formula maps."""
    rows = items(spark, sf_dir).select("item_id", S.protect_udf(TERMS)("text").alias("p")).select("item_id", "p.protected", "p.tokens")
    formulas = F.transform(F.filter("tokens", lambda t: t["token_type"] == "formula"), lambda t: F.struct(t["token_tag"].alias("tag"), t["restore_text"].alias("formula")))
    rows = rows.withColumn("formulas", formulas).withColumn("again", F.when(F.size("formulas") > 0, S.reprotect_udf(S.restore_udf("protected", "tokens"), "formulas")))
    return rows.select("item_id", F.size("formulas").alias("n_formulas"), F.coalesce("again", "protected").alias("reprotected"))


def segment_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a document's lines as segments."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), lambda t: F.length(T.normalize_text(t))).alias("sizes"))
    w = docs.select("doc_id", F.posexplode(S.windows_udf("sizes")).alias("segment", "window"))
    return w.groupBy("doc_id", "window").agg(F.min("segment").alias("first"), F.max("segment").alias("last"))


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is cut for three members weighing 1, 2 and 3."""
    parts = S.split_group_udf("text", F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    rows = items(spark, sf_dir).select("item_id", parts.alias("p"))
    return rows.select("item_id", *[F.length(F.col("p")[k]).alias(f"n{k}") for k in range(3)])


def sentence_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("item_id", S.pack_udf("text", F.lit(120)).alias("p"))
    return rows.select("item_id", F.size("p").alias("n"), F.array_max(F.transform("p", F.length)).alias("longest"))


def copy_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that repeat their source: every other line with a few letters changed."""
    out = F.when(F.col("line_no") % 2 == 0, F.translate("text", "ae", "xy")).otherwise(F.reverse("text"))
    return items(spark, sf_dir).groupBy(S.is_copy_udf("text", out).alias("is_copy")).agg(F.count(F.lit(1)).alias("n"))


def merge_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page merged to a fixed point; a page's boxes are one row."""
    rows = items(spark, sf_dir).withColumn("r", F.array("x0", "y0", "x1", F.col("y1") + F.when(F.length("text") > 60, 40.0).otherwise(0.0)))
    pages = rows.groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return pages.select("doc_id", "page_idx", F.size("rs").alias("before"), F.size(S.merge_rects_udf("rs")).alias("after"))


def font_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    demand = G.text_demand_units(F.col("text"))
    return items(spark, sf_dir).select("item_id", S.fit_font_udf(demand, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("font_pt"))


def model_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hook with its deterministic stand-in."""
    return translate(items(spark, sf_dir).select("item_id", "text"), "text").select("item_id", "translated", "final_status")


def segment_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with two placeholders set into it, planned and put together again."""
    text = F.concat(F.left("text", F.lit(30)), F.lit(" <f1-abc/> and <t1-def/> "), F.expr("substring(text, 31)"))
    rows = items(spark, sf_dir).withColumn("t", text)
    return rows.select("item_id", S.effective_segments_udf("t").alias("segments"), S.rebuilt_udf("t").alias("rebuilt"))


def group_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five lines make a group; each has one placeholder."""
    rows = items(spark, sf_dir).where(~F.col("text").rlike("<[ft][0-9]")).groupBy("doc_id", F.floor(F.col("line_no") / 5).alias("g")).agg(F.array_sort(F.collect_list(F.struct("line_no", F.concat(F.col("text"), F.lit(" <f1-abc/>")).alias("t")))).alias("m"))
    return rows.select("doc_id", "g", S.group_unit_udf(F.transform("m", lambda x: x["t"])).alias("source"))


def vertical_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every box reaches down to 1.5 points above the next one."""
    rows = items(spark, sf_dir).withColumn("r", F.array("x0", "y0", F.lit(300.0) + F.when(F.col("line_no") % 6 == 0, 300.0).otherwise(0.0), F.col("y0") + 34.5))
    pages = rows.where("x0 < 100").groupBy("doc_id", "page_idx").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return pages.select("doc_id", "page_idx", F.size("rs").alias("before"), F.size(S.merge_vertical_udf("rs")).alias("after"))


QUERIES = {f.__name__: f for f in (segment_plans, group_units, vertical_merges, protect_inline, restore_tokens, restore_formulas, segments_protected, formulas_reprotected, segment_windows, group_split, sentence_packs, copy_dominance, merge_rects, font_fit, model_hook)}
SQL = {
    "group_units": f"""WITH {ITEMS_SQL}, n AS (SELECT *, line_no // 5 AS g, row_number() OVER (PARTITION BY doc_id, line_no // 5 ORDER BY line_no) AS k FROM items WHERE NOT regexp_matches(text, '<[ft][0-9]'))
        SELECT doc_id, g, trim(string_agg(trim(text || ' <f' || k || '-abc/>', chr(9) || chr(10) || chr(13) || ' '), ' ' ORDER BY line_no)) AS source FROM n GROUP BY ALL""",
    "vertical_merges": f"""WITH {ITEMS_SQL}, r AS (SELECT *, count(*) OVER w AS k FROM items WHERE x0 < 100 WINDOW w AS (PARTITION BY doc_id, page_idx)) SELECT doc_id, page_idx, any_value(k)::INTEGER AS before, 1 AS after FROM r GROUP BY ALL""",
    "restore_tokens": f"WITH {ITEMS_SQL} SELECT item_id, text AS restored FROM items WHERE NOT regexp_matches(text, '[$_^\\\\]')",
}
