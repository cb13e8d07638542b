"""Queries of batches and their results, formula risk, forced and kept texts, stale jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import results as R
from quire.plans.tables import ITEMS_SQL, items, q, s_count, s_has, s_natural, s_norm, s_words, table
from quire.plans.text_rules import s_code


def term_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("item_id", R.clean_term_key(F.col("text")).alias("key"))


def escaped_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.escape_string(F.col("text")).alias("escaped"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, and citations made of line numbers."""
    n = F.col("line_no").cast("string")
    made = F.when(F.col("line_no") % 4 == 0, F.concat(F.lit("[ "), n, F.lit(", 3a - 4 ]"))).when(F.col("line_no") % 4 == 1, F.concat(F.lit("^{"), n, F.lit("}"))).when(F.col("line_no") % 4 == 2, F.concat(F.lit("["), n, F.lit("; 3]"))).otherwise(F.col("text"))
    return items(spark, sf_dir).select("item_id", R.is_citation(F.col("text")).alias("is_citation"), R.is_citation(made).alias("made_is_citation"))


def density_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.concat(F.lit("能量计算"), F.left("text", F.lit(20)), F.when(F.col("line_no") % 2 == 0, "模型").otherwise(""))
    return items(spark, sf_dir).select("item_id", F.round(R.density_ratio(F.col("text"), out), 6).alias("ratio"))


def _threes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines of a document make a text."""
    rows = items(spark, sf_dir).groupBy("doc_id", F.floor(F.col("line_no") / 3).alias("g")).agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("m"))
    return rows.select("doc_id", "g", F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("text"))


def preserve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _threes(spark, sf_dir).select("doc_id", "g", R.is_preserve_candidate(F.col("text")).alias("preserve"))


def forced_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return _threes(spark, sf_dir).select("doc_id", "g", R.force_mixed_literal(c, F.col("g") % 5 > 0).alias("forced"), R.is_no_translation_code(c).alias("is_code"))


def formula_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commas of the texts become placeholders."""
    rows = items(spark, sf_dir).withColumn("t", F.replace("text", F.lit(", "), F.lit(" <f1-abc/> ")))
    rows = rows.withColumn("r", R.formula_risk(F.col("t")))
    return rows.select("item_id", "r.score", "r.slots", "r.segments", "r.effective", R.formula_route(F.col("r"), F.col("line_no") % 9 == 0).alias("route"), R.heavy_split_reason(F.col("t"), F.col("r.slots")).alias("split"))


def batch_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.chunked(items(spark, sf_dir).where("layout_role <> 'title'"), ["doc_id"], ["line_no"], 10)
    return rows.groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))


def touched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth item came back, and every third group of twelve lines."""
    rows = items(spark, sf_dir).withColumn("unit_id", F.floor(F.col("line_no") / 12))
    ids = rows.where("line_no % 10 = 3").select("doc_id", F.col("item_id").alias("id"), F.lit(False).alias("is_group"))
    groups = rows.where("unit_id % 3 = 0").select("doc_id", F.col("unit_id").alias("id"), F.lit(True).alias("is_group")).distinct()
    return R.touched_pages(ids.unionByName(groups), rows.select("doc_id", "item_id", "unit_id", "page_idx"))


def boundary_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line and the next one but one."""
    k = F.col("line_no") % 20
    rows = items(spark, sf_dir).select("doc_id", "line_no", "page_idx", F.col("x0").alias("zone"), F.when(k == 0, "head").when(k == 19, "tail").otherwise("middle").alias("role"), (F.col("line_no") % 11 == 0).alias("repaired"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("b.line_no") == F.col("a.line_no") + 2))
    return pairs.where(R.is_boundary_pair("a", "b")).select(F.col("a.doc_id").alias("doc_id"), F.col("a.line_no").alias("line_no"))


def groups_finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("item_id", "doc_id", F.concat(F.lit("g"), F.floor(F.col("line_no") / 4).cast("string")).alias("continuation_group"))
    return R.without_singletons(rows, "doc_id", "continuation_group").select("item_id", "continuation_group")


def jobs_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders run in the process of their customer; processes of even number are alive."""
    jobs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("succeeded").alias("status"), F.lit("translating").alias("stage"), F.lit("").alias("error"),
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")).alias("pid"),
    )
    live = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("pid"))
    return R.recover_stale(jobs, live).select("job_id", "status", "stage", "error", "pid")


QUERIES = {f.__name__: f for f in (term_keys, escaped_strings, citations, density_ratios, preserve_candidates, forced_texts, formula_risks, batch_numbers, touched_pages, boundary_pairs, groups_finalized, jobs_recovered)}

_bare = lambda c: f"regexp_replace({c}, {q(T.PLACEHOLDER)}, ' ', 'g')"
_cite = lambda c: f"({s_has(s_norm(c), R.BRACKET_CITATION)} OR {s_has(s_norm(c), R.SUPERSCRIPT_CITATION)})"
_blanks = "chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_strip = lambda c: f"trim({c}, {_blanks})"
_THREES = f"{ITEMS_SQL}, threes AS (SELECT doc_id, line_no // 3 AS g, string_agg(text, chr(10) ORDER BY line_no) AS raw FROM items GROUP BY ALL)"
_slots = R.SLOT.pattern
_lower = lambda v: f"lower({s_norm(v)})"
_links = ", ".join(map(q, sorted(R.CONNECTORS)))
_mw = f"regexp_extract_all(z, {q(R._MICRO_WORD)})"
_all = f"len(list_filter({_mw}, lambda w: w NOT IN ({_links}))) = 0"
_micro = f"len(list_filter(s, lambda z: len({_mw}) = 0 OR (len({_mw}) <= 2 AND length(z) <= 20 AND {_all}) OR (len({_mw}) <= 3 AND length(z) <= 24 AND ({_mw}[1] IN ({_links}) OR {_mw}[-1] IN ({_links}))) OR (len({_mw}) <= 4 AND {_all})))"
_phrases = " OR ".join(f"contains(prose, {q(x)})" for x in ("abbreviated as", "defined as", "denoted as", "where ", "represented by", "expressed as", "written as", "calculated as", "corresponds to", "refers to", "stands for"))

SQL = {
    "term_keys": f"WITH {ITEMS_SQL} SELECT item_id, left(trim({s_norm('text')}, {q(R.TERM_EDGES)}), 80) AS key FROM items",
    "escaped_strings": r"""SELECT doc_id, replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n') AS escaped FROM documents""",
    "citations": f"""WITH {ITEMS_SQL}, m AS (SELECT *, CASE line_no % 4 WHEN 0 THEN '[ ' || line_no || ', 3a - 4 ]' WHEN 1 THEN '^{{' || line_no || '}}' WHEN 2 THEN '[' || line_no || '; 3]' ELSE text END AS made FROM items)
        SELECT item_id, {_cite("text")} AS is_citation, {_cite("made")} AS made_is_citation FROM m""",
    "density_ratios": f"""WITH {ITEMS_SQL}, o AS (SELECT item_id, {s_count(_bare("text"), R.WORD)} AS n, {s_count(_bare("'能量计算' || left(text, 20) || CASE WHEN line_no % 2 = 0 THEN '模型' ELSE '' END"), "[一-鿿]")} AS zh FROM items)
        SELECT item_id, CASE WHEN n > 0 THEN round(zh / n, 6) ELSE 0 END AS ratio FROM o""",
    "preserve_candidates": f"""WITH {_THREES}, p AS (SELECT *, {_strip("raw")} AS t, list_filter(list_transform(string_split({_strip("raw")}, chr(10)), lambda x: {_strip("x")}), lambda x: x <> '') AS ls FROM threes)
        SELECT doc_id, g, t <> '' AND ((len(ls) >= 2 AND len(list_filter(ls, lambda x: {s_has("x", R.SYMBOLIC_LINE)})) >= greatest(1, len(ls) // 2)) OR {s_has("t", R.ASSIGNMENT)} OR {s_has("t", R.FIELD_VALUE)}) AS preserve FROM p""",
    "forced_texts": f"""WITH {_THREES}, p AS (SELECT doc_id, g, raw, {s_norm("raw")} AS t FROM threes)
        SELECT doc_id, g, g % 5 > 0 AND length(t) >= 48 AND {s_count("t", T.EN_WORD)} >= 8 AND len(list_filter(regexp_extract_all(t, {q(T.EN_WORD)}), lambda w: length(w) >= 4)) >= 5 AND {s_natural("t")} >= 8
            AND len(regexp_extract_all(t, '[-=<>+*/()\\[\\]{{}}]')) / length(t) < 0.28 AND {s_count(s_words("t"), T.PROSE_CUE)} >= 2 AS forced,
            t <> '' AND (starts_with(t, '$ ') OR starts_with(t, '> ') OR starts_with(t, './') OR starts_with(t, '../') OR len(list_filter(string_split(raw, chr(10)), lambda x: {s_has(_strip("x"), "^[|$>-]")})) >= 2 OR {s_code("t")}) AS is_code FROM p""",
    "formula_risks": f"""WITH {ITEMS_SQL}, t AS (SELECT item_id, line_no, replace(text, ', ', ' <f1-abc/> ') AS t FROM items),
        p AS (SELECT *, lower({s_norm(_bare("t"))}) AS prose, {s_count("t", _slots)} AS n, string_split_regex(t, {q(_slots)}) AS pieces FROM t),
        s AS (SELECT *, list_transform(list_filter(pieces, lambda z: regexp_matches(z, '\\pL')), lambda z: {_lower("z")}) AS s, n / greatest(1, length(t)) AS d FROM p), m AS (SELECT *, {_micro} AS micro FROM s),
        r AS (SELECT *, CASE WHEN {_phrases} THEN 3 ELSE 0 END + (len(list_filter(s, lambda z: length(z) BETWEEN 1 AND 32)) > 0)::INT + (n >= 4)::INT * 2 + (n >= 8)::INT * 2 + (length(prose) >= 180)::INT + (d >= 0.015)::INT + (d >= 0.03)::INT
            - CASE WHEN micro >= greatest(2, len(s) - 1) THEN 2 WHEN micro > 0 THEN 1 ELSE 0 END + coalesce(regexp_matches(s[1], '^(?:the|a|an) ') AND length(s[1]) <= 24, false)::INT + (len(list_filter(s[2:], lambda z: regexp_matches(z, '^(?:which|where|that|is|are|can) '))) > 0)::INT
            + (len(s) >= 3)::INT + (n > 0)::INT + (n > 0 AND pieces[-1] <> '')::INT + (contains(t, ')') AND (contains(prose, 'abbreviated as') OR contains(prose, 'stands for') OR contains(prose, 'denoted as')))::INT AS score,
            CASE WHEN micro < len(s) THEN len(s) - micro ELSE len(s) END AS effective FROM m)
        SELECT item_id, score::INT AS score, n::INT AS slots, len(s)::INT AS segments, effective::INT AS effective,
            CASE WHEN line_no % 9 <> 0 AND n >= 4 AND n < 24 AND score >= 6 AND effective BETWEEN 1 AND 16 AND NOT (effective >= 5 AND length(prose) >= 180) THEN 'single' ELSE 'none' END AS route,
            CASE WHEN n >= 16 AND (length(t) >= 1200 OR n >= 24) AND (n >= 24 OR d >= 0.016) THEN 'heavy_formula_density' ELSE '' END AS split FROM r""",
    "batch_numbers": f"""WITH {ITEMS_SQL}, k AS (SELECT doc_id, line_no, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1) // 10 AS chunk FROM items WHERE layout_role <> 'title') SELECT doc_id, chunk, count(*) AS n, min(line_no) AS first FROM k GROUP BY ALL""",
    "touched_pages": f"WITH {ITEMS_SQL} SELECT DISTINCT doc_id, page_idx FROM items WHERE line_no % 10 = 3 OR (line_no // 12) % 3 = 0",
    "boundary_pairs": f"""WITH {ITEMS_SQL} SELECT a.doc_id, a.line_no FROM items a JOIN items b ON a.doc_id = b.doc_id AND b.line_no = a.line_no + 2
        WHERE a.line_no % 11 <> 0 AND b.line_no % 11 <> 0 AND (a.page_idx <> b.page_idx OR a.x0 <> b.x0 OR a.line_no % 20 IN (0, 19) OR b.line_no % 20 IN (0, 19))""",
    "groups_finalized": f"WITH {ITEMS_SQL} SELECT item_id, CASE WHEN count(*) OVER (PARTITION BY doc_id, line_no // 4) > 1 THEN 'g' || line_no // 4 ELSE '' END AS continuation_group FROM items",
    "jobs_recovered": f"""WITH j AS (SELECT *, o_orderstatus = 'O' AS running, CASE WHEN o_custkey % 3 > 0 THEN o_custkey END AS p FROM orders), s AS (SELECT j.*, running AND (p IS NULL OR p NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) AS stale FROM j)
        SELECT o_orderkey AS job_id, CASE WHEN stale THEN 'failed' WHEN running THEN 'running' ELSE 'succeeded' END AS status, CASE WHEN stale THEN 'failed' ELSE 'translating' END AS stage,
            CASE WHEN NOT stale THEN '' WHEN p IS NULL THEN {q(R.NO_PID)} ELSE {q(R.DEAD_PID[0])} || p || {q(R.DEAD_PID[1])} END AS error, CASE WHEN NOT stale THEN p END AS pid FROM s""",
}
