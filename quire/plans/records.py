"""Queries that bring results back to records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import records as R
from quire.plans.tables import LINES_SQL, lines, q, s_count
from quire.plans.text_rules import _weird, s_prose

_TOKEN = "array<struct<token_tag:string,token_type:string,restore_text:string>>"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as records: every third has a formula token; of five lines three form a group, whose second member is not to be translated on some pages; a group unit without continuation group every 40 lines."""
    n = F.col("line_no")
    rows = lines(spark, sf_dir).withColumn("item_id", F.concat_ws("-", F.col("doc_id").cast("string"), n.cast("string")))
    source = F.when(n % 3 == 0, F.concat("text", F.lit(" <f1-abc/>"))).otherwise(F.col("text"))
    tokens = F.when(n % 3 == 0, F.array(F.struct(F.lit("<f1-abc/>").alias("token_tag"), F.lit("formula").alias("token_type"), F.lit(" $x_1$ ").alias("restore_text")))).otherwise(F.array().cast(_TOKEN))
    group = F.when((n % 5 < 3) & (n % 40 < 30), F.concat(F.lit("g"), F.floor(n / 5).cast("string")))
    held = F.when(n % 40 >= 36, F.concat(F.lit("__cg__:u"), F.floor(n / 40).cast("string")))
    return rows.select(
        "doc_id", "item_id", F.col("line_no").alias("pos"), source.alias("source"), tokens.alias("tokens"), (~((n % 5 == 1) & (n % 2 == 0))).alias("should_translate"), F.lit("old").alias("label"), F.lit("pending").alias("final_status"), group.alias("continuation_group"),
        held.alias("unit_id"), F.when(n % 23 == 4, "Listing 1: ").alias("tail_prefix"), F.lit("was").alias("protected_translated_text"), F.lit("was").alias("translated_text"), F.lit("was").alias("unit_translated_text"),
    )


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two answers for every other line, the second of which counts: shells, kept, failed, repeated tokens, copies; answers for groups and for items that nobody knows."""
    n, t = F.col("line_no"), F.col("text")
    rows = lines(spark, sf_dir).where(n % 2 == 0)
    source = F.when(n % 3 == 0, F.concat(t, F.lit(" <f1-abc/>"))).otherwise(t)
    own = F.concat_ws("-", F.col("doc_id").cast("string"), n.cast("string"))
    unit = F.when((n % 5 < 3) & (n % 40 < 30) & (n % 4 == 0), F.concat(F.lit("__cg__:g"), F.floor(n / 5).cast("string"))).when(n % 50 == 34, F.lit("nobody")).otherwise(own)
    said = F.concat(F.lit("译 "), F.left(t, F.lit(30)), F.when(n % 3 == 0, F.when(n % 9 == 0, " <f1-abc/>  <f1-abc/> .").otherwise(" <f1-abc/>")).otherwise(""))
    text = (
        F.when(n % 26 == 0, F.concat(F.lit("```json\n"), F.to_json(F.named_struct(F.lit("decision"), F.lit("translate"), F.lit("translated_text"), said)), F.lit("\n```")))
        .when(n % 26 == 2, F.to_json(F.named_struct(F.lit("translations"), F.array(F.named_struct(F.lit("item_id"), unit, F.lit("translated_text"), said))))).when(n % 26 == 4, source).otherwise(said)
    )
    both = rows.select("doc_id", unit.alias("unit_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), text.alias("t"), n.alias("n"), F.col("text"))
    decision = F.when(F.col("n") % 14 == 6, " Keep").when(F.col("n") % 14 == 8, "no-translate").when(F.col("n") % 14 == 10, None).otherwise("translate")
    return both.select("doc_id", "unit_id", (F.col("n") * 2 + F.col("k")).alias("seq"), decision.alias("decision"), F.when(F.col("k") == 0, "first try").otherwise(F.col("t")).alias("translated_text"), F.when(F.col("n") % 22 == 12, "failed").alias("final_status"))


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("item_id", r"-(\d+)$", 1).cast("long")
    units = _records(spark, sf_dir).select("doc_id", F.col("item_id").alias("unit_id"), "source", (n % 4 != 1).alias("bodylike"), F.col("continuation_group").isNotNull().alias("grouped"), (F.size("tokens") > 0).alias("with_formulas"))
    return R.canonical_results(_results(spark, sf_dir), units)


def results_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir)


def results_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of translated groups show the unit's text (how it is split is tested by itself)."""
    out = R.apply_results(_records(spark, sf_dir), _canonical(spark, sf_dir))
    return out.select("doc_id", "item_id", "unit_id", "unit_kind", "should_translate", "label", "final_status", "unit_translated_text", F.when(F.col("unit_kind") == "single", F.col("translated_text")).alias("own_text"))


QUERIES = {f.__name__: f for f in (results_canonical, results_applied)}


def _garbled(c: str) -> str:
    t = f"trim(regexp_replace({c}, {q(T.PLACEHOLDER)}, ' ', 'g'))"
    return f"({t} = '' OR contains({t}, '�') OR {s_count(t, _weird)} / greatest(1, {s_count(t, chr(92) + 'S')}) > 0.35)"


def _sourced(c: str) -> str:
    return f"CASE WHEN line_no % 3 = 0 THEN {c} || ' <f1-abc/>' ELSE {c} END"


#: Canonical results.  A shell is opened with its own JSON; the third answer of nine repeats its token.
_CANONICAL = f"""{LINES_SQL}, recs AS (
    SELECT *, doc_id || '-' || line_no AS item_id, {_sourced("text")} AS source, CASE WHEN line_no % 5 < 3 AND line_no % 40 < 30 THEN 'g' || line_no // 5 END AS continuation_group,
           CASE WHEN line_no % 40 >= 36 THEN '__cg__:u' || line_no // 40 END AS held FROM lines
), said AS (
    SELECT *, CASE WHEN line_no % 5 < 3 AND line_no % 40 < 30 AND line_no % 4 = 0 THEN '__cg__:g' || line_no // 5 WHEN line_no % 50 = 34 THEN 'nobody' ELSE item_id END AS unit_id,
           CASE WHEN line_no % 26 = 4 THEN source ELSE '译 ' || left(text, 30) || CASE WHEN line_no % 9 = 0 THEN ' <f1-abc/>  <f1-abc/> .' WHEN line_no % 3 = 0 THEN ' <f1-abc/>' ELSE '' END END AS t FROM recs WHERE line_no % 2 = 0
), answers AS (
    SELECT s.doc_id, s.unit_id, s.line_no * 2 + k AS seq, s.line_no AS n, r.item_id IS NOT NULL AS known, r.source AS rsource, r.line_no AS rn, r.continuation_group AS rgroup, trim(CASE WHEN k = 0 THEN 'first try' ELSE t END) AS t,
           CASE WHEN s.line_no % 14 IN (6, 8) THEN 'keep_origin' ELSE 'translate' END AS d, CASE WHEN s.line_no % 22 = 12 THEN 'failed' END AS status
    FROM said s CROSS JOIN (VALUES (0), (1)) v(k) LEFT JOIN recs r ON r.doc_id = s.doc_id AND r.item_id = s.unit_id
), mended AS (
    SELECT *, CASE WHEN known AND d = 'translate' AND ends_with(t, ' <f1-abc/>  <f1-abc/> .') AND rn % 3 = 0 THEN regexp_replace(left(t, length(t) - length(' <f1-abc/>  <f1-abc/> .')) || ' <f1-abc/>.', '[ \t]{{2,}}', ' ', 'g') ELSE t END AS m FROM answers
), canonical AS (
    SELECT *, CASE WHEN d = 'translate' AND known AND m <> '' AND m = trim(rsource) AND NOT (rn % 4 <> 1 AND {s_prose("rsource")} AND NOT {_garbled("rsource")}
        AND len(regexp_extract_all(regexp_replace(rsource, {q(T.PLACEHOLDER)}, ' ', 'g'), {q(T.EN_WORD)})) >= CASE WHEN rgroup IS NOT NULL THEN 6 WHEN rn % 3 = 0 THEN 5 ELSE 8 END) THEN 'keep_origin' ELSE d END AS decision FROM mended
)"""

SQL = {
    "results_canonical": f"""WITH {_CANONICAL} SELECT doc_id, unit_id, seq, decision, CASE WHEN decision = 'keep_origin' THEN '' ELSE m END AS translated_text,
        coalesce(status, CASE WHEN decision = 'keep_origin' THEN 'kept_origin' ELSE 'translated' END) AS final_status FROM canonical""",
    "results_applied": f"""WITH {_CANONICAL}, last AS (
        SELECT doc_id, unit_id, arg_max(decision, seq) AS d, arg_max(CASE WHEN decision = 'keep_origin' THEN '' ELSE m END, seq) AS t, arg_max(coalesce(status, CASE WHEN decision = 'keep_origin' THEN 'kept_origin' ELSE 'translated' END), seq) AS s
        FROM canonical GROUP BY doc_id, unit_id
    ), keyed AS (
        SELECT *, coalesce('c:' || continuation_group, 'u:' || held, 'i:' || item_id) AS key, count(*) OVER (PARTITION BY doc_id, coalesce('c:' || continuation_group, 'u:' || held, 'i:' || item_id)) AS members FROM recs
    ), units AS (
        SELECT *, CASE WHEN members < 2 OR (continuation_group IS NULL AND held IS NULL) THEN item_id WHEN continuation_group IS NOT NULL THEN '__cg__:' || continuation_group ELSE held END AS unit, NOT (line_no % 5 = 1 AND line_no % 2 = 0) AS should,
               first_value(line_no) OVER (PARTITION BY doc_id, key ORDER BY line_no) % 3 = 0 AS gtoken FROM keyed
    ), met AS (
        SELECT u.*, CASE WHEN g.s IS NULL THEN 'none' WHEN g.s = 'failed' THEN 'failed' WHEN g.d = 'keep_origin' THEN 'kept' ELSE 'text' END AS gk, g.t AS gt, g.s AS gs,
               CASE WHEN i.s IS NULL THEN 'none' WHEN i.s = 'failed' THEN 'failed' WHEN i.d = 'keep_origin' THEN 'kept' ELSE 'text' END AS ik, i.t AS it, i.s AS is_
        FROM units u LEFT JOIN last g ON g.doc_id = u.doc_id AND g.unit_id = u.unit AND u.members >= 2 LEFT JOIN last i ON i.doc_id = u.doc_id AND i.unit_id = u.item_id
    ), texts AS (
        SELECT *, CASE WHEN line_no % 23 = 4 AND ik = 'text' THEN rtrim('Listing 1: ') || CASE WHEN it = '' THEN '' WHEN left(it, 1) IN (',', '.', ';', ':', '!', '?', ')', ']', '}}') THEN it ELSE ' ' || it END ELSE it END AS it2 FROM (
            SELECT * REPLACE (CASE WHEN line_no % 3 = 0 THEN replace(it, '<f1-abc/>', '$x_1$') ELSE it END AS it, CASE WHEN gtoken THEN replace(gt, '<f1-abc/>', '$x_1$') ELSE gt END AS gt) FROM met)
    ), done AS (
        SELECT *, CASE WHEN ik = 'text' THEN it2 WHEN ik <> 'none' THEN '' WHEN gk IN ('failed', 'kept') THEN '' WHEN gk = 'text' AND NOT should THEN '' WHEN gk = 'text' THEN gt ELSE 'was' END AS whole, ik = 'text' AND held IS NOT NULL AS keeps FROM texts
    )
    SELECT doc_id, item_id, CASE WHEN keeps THEN held ELSE unit END AS unit_id, CASE WHEN keeps OR (members >= 2 AND (continuation_group IS NOT NULL OR held IS NOT NULL)) THEN 'group' ELSE 'single' END AS unit_kind,
           CASE WHEN ik = 'failed' THEN true WHEN ik = 'kept' THEN false WHEN gk = 'failed' THEN true WHEN gk = 'kept' THEN false ELSE should END AS should_translate,
           CASE WHEN ik = 'failed' THEN '' WHEN ik = 'kept' THEN 'skip_model_keep_origin' WHEN gk = 'failed' THEN '' WHEN gk = 'kept' THEN 'skip_model_keep_origin' ELSE 'old' END AS label,
           CASE WHEN ik = 'failed' THEN 'failed' WHEN ik = 'kept' THEN 'kept_origin' WHEN ik = 'text' THEN is_ WHEN gk = 'failed' THEN 'failed' WHEN gk = 'kept' THEN 'kept_origin' WHEN gk = 'text' AND should THEN gs ELSE 'pending' END AS final_status,
           whole AS unit_translated_text, CASE WHEN NOT (keeps OR (members >= 2 AND (continuation_group IS NOT NULL OR held IS NOT NULL))) THEN whole END AS own_text FROM done""",
}
