"""Queries of ingest, roles, validation and policies.  Raw payloads are made from the documents' lines, one dialect in four each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import documents as D
from quire.operators import policy as P
from quire.plans.tables import ITEMS_SQL, LINES_SQL, items, q, s_has, s_in, s_norm, table
from quire.plans.text_rules import _heading, s_code, s_metadata
from quire.sources import layouts as L
from quire.sources import logs

#: Sub types that lines take by turns in the generic dialect, and labels in the second.
SUBS = ["title", "body", "abstract", "body", "heading", "footnote", "reference_entry", "body"]
LABELS = ["doc_title", "text", "abstract", "figure_title", "table", "reference_content", "number", "nonsense"]
TYPES = ["title", "text", "interline_equation", "image", "list", "page_number", "other", "table_footnote"]
_at = lambda names, c: F.element_at(F.array(*[F.lit(n) for n in names]), (c % 8 + 1).cast("int"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, payload): every document as a JSON string, 40 lines a page; its id modulo 4 says in which dialect."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    n = F.ceil(F.size("lines") / 40).cast("int")
    pages = F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.transform(F.slice("lines", p * 40 + 1, F.lit(40)), lambda t, i: F.struct(t.alias("t"), (p * 40 + i).alias("n"))))
    box = lambda x: F.array(F.lit(10.0), (x["n"] % 40 * 20.0), F.lit(300.0), (x["n"] % 40 * 20.0 + 15))
    generic = F.to_json(F.struct(F.lit("generic_flat_ocr").alias("provider"), F.transform("p", lambda g: F.struct(F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit("pt").alias("unit"), F.transform(g, lambda x: F.struct(F.lit("text").alias("type"), _at(SUBS, x["n"]).alias("sub_type"), box(x).alias("bbox"), x["t"].alias("text"))).alias("blocks"))).alias("pages")))
    paddle = F.to_json(F.struct(F.struct(F.transform("p", lambda g: F.struct(F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))).alias("pages")).alias("dataInfo"), F.transform("p", lambda g: F.struct(F.struct(F.transform(g, lambda x: F.struct(_at(LABELS, x["n"]).alias("block_label"), x["t"].alias("block_content"), box(x).alias("block_bbox"))).alias("parsing_res_list")).alias("prunedResult"))).alias("layoutParsingResults")))
    span = lambda x: F.array(F.struct(F.array(F.struct(F.lit("text").alias("type"), x["t"].alias("content"))).alias("spans")))
    mineru = F.to_json(F.struct(F.transform("p", lambda g: F.struct(F.array(F.lit(595.0), F.lit(842.0)).alias("page_size"), F.transform(g, lambda x: F.struct(_at(TYPES, x["n"]).alias("type"), box(x).alias("bbox"), span(x).alias("lines"))).alias("para_blocks"))).alias("pdf_info")))
    content = F.to_json(F.transform("p", lambda g: F.transform(g, lambda x: F.struct(F.when(x["n"] == 0, "title").otherwise("paragraph").alias("type"), box(x).alias("bbox"), F.create_map(F.lit("text"), x["t"]).alias("content")))))
    kind = F.col("doc_id") % 4
    made = F.when(kind == 0, generic).when(kind == 1, paddle).when(kind == 2, mineru).otherwise(content)
    return docs.withColumn("p", pages).select(F.col("doc_id").cast("string").alias("document_id"), made.alias("payload"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.enrich(L.adapt(payloads(spark, sf_dir)))


def detected_dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([("x", "{}"), ("y", "[]"), ("z", '{"provider": "generic_flat_ocr"}')], "document_id string, payload string")
    both = payloads(spark, sf_dir).unionByName(own)
    return both.groupBy(F.coalesce(L.detect(F.col("payload")), F.lit("none")).alias("provider")).agg(F.count(F.lit(1)).alias("n"))


def blocks_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = L.adapt(payloads(spark, sf_dir))
    return b.select("document_id", "provider", F.col("page_index").cast("long").alias("page_index"), F.col("order").cast("long").alias("order"), "block_id", "kind", "sub_type", F.length("text").cast("long").alias("n_chars"), F.col("bbox")[1].alias("y0"))


def block_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["provider", "sub_type", "layout_role", "semantic_role", "structure_role", "policy.reason"]
    return _blocks(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("policy.translate").cast("long")).alias("to_translate"))


def role_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ["is_caption_like", "is_footnote_like", "is_reference_entry", "is_metadata", "is_title_like", "is_bodylike", "is_textual"]
    p = D.role_profile(_blocks(spark, sf_dir))
    return p.groupBy("provider").agg(*[F.sum(F.col(f).cast("long")).alias(f) for f in flags])


def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.validation_report(_blocks(spark, sf_dir))


def validation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth block is spoilt in one way, every eleventh in another."""
    n = F.col("order")
    spoilt = _blocks(spark, sf_dir).withColumn("bbox", F.when(n % 9 == 8, F.array(F.lit(9.0), F.lit(9.0), F.lit(1.0), F.lit(1.0))).otherwise(F.col("bbox"))).withColumn("layout_role", F.when(n % 11 == 10, "strange").otherwise(F.col("layout_role")))
    return D.violations(spoilt).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


def defaults_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("doc_id", F.when(F.length("text") % 3 > 0, F.length("text")).alias("reading_order"), F.when(F.length("text") > 50, "x").alias("unit"))
    return D.defaults_report(rows, {"reading_order": F.lit(0), "unit": F.lit("pt")}, "doc_id")


def text_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.text_items(_blocks(spark, sf_dir)).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("first_item"), F.sum(F.length("text")).alias("n_chars"))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("doc_id", F.col("page_idx").alias("page_index"), F.col("line_no").alias("order"), F.concat(F.lit("a"), (F.length("text") % 7).cast("string")).alias("asset_id"), F.when(F.length("text") % 2 == 0, F.left("text", F.lit(10))).otherwise(" ").alias("uri"))
    return D.assets(rows, "doc_id")


def records_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("doc_id", "line_no", F.col("text").alias("source_text"), F.reverse("text").alias("translated_text"))
    old, new = rows.where("line_no % 5 <> 0"), rows.where("line_no % 7 <> 0").withColumn("source_text", F.when(F.col("line_no") % 3 == 0, F.concat("source_text", F.lit("!"))).otherwise(F.col("source_text")))
    return D.sync_records(old, new, ["doc_id", "line_no"])


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.html_blocks(table(spark, sf_dir, "pages"))


def _policed(spark: SparkSession, sf_dir: str, *more: F.Column) -> DataFrame:
    """Lines with their labels.  ``more``: what else of a line is needed; texts stay behind."""
    rows = items(spark, sf_dir).withColumn("block_idx", F.col("line_no"))
    heading = T.is_reference_heading(F.col("text"))
    cut = D.reference_cutoff(rows, "doc_id", heading & (F.col("line_no") > 1))
    rows = P.content_labels(rows.withColumns({"is_title_like": F.col("layout_role") == "title", "kind": F.lit("text"), "is_bodylike": F.col("layout_role") != "title"}))
    rows = rows.select("doc_id", "page_idx", "block_idx", "is_title_like", "content_label", *more)
    return P.apply_policies(rows.join(cut, "doc_id", "left"))


def policies_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.policy_counts(_policed(spark, sf_dir), "doc_id")


def page_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a translated text only counts that there is one, so its first sign stands for it."""
    rows = _policed(spark, sf_dir, F.when(F.col("line_no") % 3 == 0, F.left(F.trim("text"), F.lit(1))).alias("translated_text")).withColumn("final_status", F.when(F.col("label").startswith("skip_"), "kept_origin"))
    return P.page_summaries(rows, "doc_id", "page_idx")


def fast_path_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(F.col("line_no") % 2 == 0, "non_flow").otherwise("left_column")
    policy = F.when(F.col("line_no") % 6 == 5, False).when(F.col("line_no") % 6 == 4, True)
    reason = P.keep_origin_reason(F.col("text"), policy, F.col("layout_role") == "title", zone)
    return items(spark, sf_dir).groupBy(F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def classification_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels of documents stand for a model's answers about their lines."""
    answers = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "no_trans").when(F.col("toxic") == 1, "skip_toxic").otherwise("translate").alias("answer"))
    rows = items(spark, sf_dir).join(answers, "doc_id", "left")
    label = P.model_label(F.col("answer"), F.when(F.col("line_no") % 4 == 3, "skip_title"), F.col("line_no") % 5 == 4, F.col("layout_role") != "title", T.is_code_literal(F.col("text")), F.length("text") < 80)
    return rows.groupBy(F.coalesce(label, F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_CSV = ["术语,译文,动作,备注,匹配", "Alpha,阿尔法,keep,n1,ci", "beta,贝塔,固定翻译,,regex", "ALPHA,第一,,last", ",,,", "gamma,伽马,other,n3,exact"]
_SPECS = ["1~3,7", "5~2, 8", "x,,9", "", "3,3,1"]


def glossary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.read_glossary(spark, _CSV)


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(k, s) for k, s in enumerate(_SPECS)], "id long, spec string")
    return own.select("id", F.array_join(F.transform(P.expand_ranges(F.col("spec")), lambda x: x.cast("string")), ",").alias("pages"))


_LOG = ['{"job_id": "j", "ts": "t1", "stage": "a", "event_type": "e1", "progress_current": 3}', "", "not json", '{"job_id": "other", "ts": "t2"}', '{"ts": "t3", "event": "named", "level": "warn", "provider_stage": "p"}', "[1]", '{"job_id": " j ", "message": "m"}']


def events_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(k, s) for k, s in enumerate(_LOG)], "line int, value string")
    return logs.parse_events(own, "j").select(F.col("seq").cast("long").alias("seq"), "ts", "level", "stage", "event", "event_type", "message", "substage", "progress_current")


QUERIES = {
    f.__name__: f
    for f in (
        detected_dialects, blocks_explode, block_roles, role_profiles, validation_report, validation_violations, defaults_report, text_items, assets, records_synced, html_blocks, policies_applied, page_summaries, fast_path_reasons,
        classification_labels, glossary_csv, page_ranges, events_jsonl,
    )
}

_case = lambda names, c: "CASE " + c + " % 8 " + " ".join(f"WHEN {k} THEN {q(n)}" for k, n in enumerate(names)) + " END"
_PROVIDER = "CASE doc_id % 4 WHEN 0 THEN 'generic_flat_ocr' WHEN 1 THEN 'paddle' WHEN 2 THEN 'mineru' ELSE 'mineru_content_list_v2' END"
_pk = lambda i: "CASE label " + " ".join(f"WHEN {q(n)} THEN {q(v[i])}" for n, v in L.PADDLE_LABELS.items() if n in LABELS) + f" ELSE {q(['unknown', ''][i])} END"
_mk = {"title": ("text", "title"), "text": ("text", "body"), "interline_equation": ("formula", "display_formula"), "image": ("image", "figure"), "list": ("text", "body"), "page_number": ("text", "page_number"), "other": ("text", "metadata"), "table_footnote": ("text", "footnote")}
_mkc = lambda i: "CASE WHEN mtype = 'other' AND trim(text) = '' THEN " + q(["unknown", ""][i]) + " ELSE CASE mtype " + " ".join(f"WHEN {q(n)} THEN {q(v[i])}" for n, v in _mk.items()) + " END END"
#: One row per block with what each dialect says of it, straight from the lines.
_BLOCKS = f"""{LINES_SQL}, raw AS (
    SELECT doc_id::VARCHAR AS document_id, doc_id % 4 AS d, {_PROVIDER} AS provider, line_no // 40 AS page_index, line_no % 40 AS "order", line_no AS n, text, {_case(SUBS, "line_no")} AS sub, {_case(LABELS, "line_no")} AS label, {_case(TYPES, "line_no")} AS mtype
    FROM lines WHERE doc_id >= 0
), kinds AS (
    SELECT *, CASE d WHEN 0 THEN 'text' WHEN 1 THEN {_pk(0)} WHEN 2 THEN {_mkc(0)} ELSE 'text' END AS kind,
           CASE d WHEN 0 THEN sub WHEN 1 THEN {_pk(1)} WHEN 2 THEN {_mkc(1)} WHEN 3 THEN CASE WHEN n = 0 THEN 'title' ELSE 'body' END END AS sub_type FROM raw
), gaps AS (
    SELECT *, d = 0 AND sub = 'body' AND coalesce(lag(sub) OVER w = 'title' AND lead(sub) OVER w IN ('abstract', 'heading'), false) AS gap FROM kinds WINDOW w AS (PARTITION BY document_id, page_index ORDER BY "order")
), lay AS (
    SELECT *, CASE WHEN kind <> 'text' THEN 'unknown' WHEN sub_type = 'title' THEN 'title' WHEN sub_type = 'heading' THEN 'heading' WHEN sub_type IN ('header', 'footer', 'page_number', 'footnote') THEN sub_type
                   WHEN sub_type IN ('caption', 'figure_caption') OR (d = 1 AND label = 'figure_title') THEN 'caption' ELSE 'paragraph' END AS layout_role FROM gaps
), sem AS (
    SELECT *, CASE WHEN gap THEN 'metadata' WHEN (d = 0 AND sub_type = 'abstract') OR (d = 1 AND label = 'abstract') THEN 'abstract' WHEN sub_type = 'reference_entry' THEN 'reference' WHEN sub_type IN ('metadata', 'formula_number') THEN 'metadata'
                   WHEN layout_role IN ('header', 'footer', 'page_number', 'footnote', 'caption') THEN 'metadata' WHEN kind = 'text' AND layout_role IN ('paragraph', 'list_item') THEN 'body' ELSE 'unknown' END AS semantic_role FROM lay
), st AS (
    SELECT *, CASE WHEN d = 0 AND sub_type IN ('title', 'heading', 'footnote') THEN sub_type WHEN d = 0 AND sub_type IN ('body', 'abstract') THEN 'body' WHEN semantic_role = 'reference' THEN 'reference_entry' WHEN semantic_role = 'abstract' THEN 'body' WHEN semantic_role = 'metadata' THEN 'metadata'
                   WHEN layout_role IN ('title', 'heading') THEN layout_role WHEN layout_role = 'paragraph' THEN 'body' ELSE '' END AS structure_role FROM sem
), blocks AS (
    SELECT *, CASE WHEN gap THEN 'provider_front_matter:title_abstract_gap' WHEN d = 0 AND sub_type IN ('abstract', 'body', 'heading') THEN 'provider_body_whitelist:' || sub_type WHEN d = 0 THEN 'provider_non_body:' || sub_type WHEN kind <> 'text' THEN 'non_text'
                   WHEN layout_role IN ('header', 'footer', 'page_number', 'footnote', 'caption') THEN 'layout_role=' || layout_role WHEN semantic_role IN ('reference', 'metadata', 'unknown') THEN 'semantic_role=' || semantic_role WHEN semantic_role = 'abstract' THEN 'semantic_role=abstract' ELSE 'main_text' END AS reason FROM st
), policed AS (SELECT *, reason LIKE 'provider_body_whitelist:%' OR reason IN ('semantic_role=abstract', 'main_text') AS translate FROM blocks)"""
_POLICED = f"""{ITEMS_SQL}, t AS (SELECT *, {s_norm("text")} AS t FROM items), h AS (SELECT *, {s_in(_heading, T.REFERENCE_HEADINGS)} AS heading FROM t), c AS (SELECT doc_id, min(line_no) AS cut FROM h WHERE heading AND line_no > 1 GROUP BY 1),
    policed AS (SELECT h.*, CASE WHEN layout_role = 'title' THEN 'skip_title' WHEN line_no >= cut THEN 'skip_reference_tail' WHEN page_idx <= 8 AND {s_metadata("t")} THEN 'skip_metadata_fragment'
        WHEN length(t) >= 16 AND len(regexp_extract_all(t, '[一-鿿]')) >= 10 AND len(regexp_extract_all(t, '[一-鿿]')) >= 2 * len(regexp_extract_all(t, '[A-Za-z]')) AND len(regexp_extract_all(t, '[一-鿿]')) >= 2 * len(regexp_extract_all(t, {q(T.EN_WORD)})) THEN 'skip_cjk_source_body'
        WHEN {s_code("t")} THEN 'code' ELSE '' END AS label FROM h LEFT JOIN c USING (doc_id))"""
_bare = f"trim(regexp_replace(regexp_replace(text, {q(T.PLACEHOLDER)}, ' ', 'g'), '\\s+', ' ', 'g'))"

SQL = {
    "detected_dialects": f"SELECT provider, count(*) AS n FROM (SELECT {_PROVIDER} AS provider FROM documents UNION ALL SELECT unnest(['none', 'mineru_content_list_v2', 'none'])) GROUP BY 1",
    "blocks_explode": f"""WITH {_BLOCKS} SELECT document_id, provider, page_index, "order", 'p' || lpad((page_index + 1)::VARCHAR, 3, '0') || '-b' || lpad("order"::VARCHAR, 4, '0') AS block_id, kind, sub_type, length(CASE WHEN d = 3 THEN {s_norm("text")} WHEN d = 2 AND trim(text) = '' THEN '' ELSE text END) AS n_chars, "order" * 20.0::DOUBLE AS y0 FROM blocks""",
    "block_roles": f"WITH {_BLOCKS} SELECT provider, sub_type, layout_role, semantic_role, structure_role, reason, count(*) AS n, sum(translate::INT)::BIGINT AS to_translate FROM policed GROUP BY ALL",
    "role_profiles": f"""WITH {_BLOCKS}, f AS (SELECT provider, layout_role = 'caption' AS is_caption_like, layout_role = 'footnote' OR structure_role = 'footnote' OR (d = 1 AND label = 'footnote') AS is_footnote_like, semantic_role = 'reference' OR structure_role = 'reference_entry' AS is_reference_entry,
            sub_type = 'metadata' OR semantic_role = 'metadata' AS is_metadata, layout_role IN ('title', 'heading') OR structure_role IN ('title', 'heading') AS is_title_like, semantic_role IN ('body', 'abstract') OR structure_role IN ('', 'body') OR layout_role = 'paragraph' AS is_bodylike,
            kind = 'text' OR layout_role IN ('title', 'heading', 'paragraph', 'caption') AS is_textual FROM blocks)
        SELECT provider, sum(is_caption_like::INT)::BIGINT AS is_caption_like, sum(is_footnote_like::INT)::BIGINT AS is_footnote_like, sum(is_reference_entry::INT)::BIGINT AS is_reference_entry, sum(is_metadata::INT)::BIGINT AS is_metadata, sum(is_title_like::INT)::BIGINT AS is_title_like, sum(is_bodylike::INT)::BIGINT AS is_bodylike, sum(is_textual::INT)::BIGINT AS is_textual FROM f GROUP BY 1""",
    "validation_report": f"WITH {_BLOCKS} SELECT document_id, count(DISTINCT page_index) AS page_count, count(*) AS block_count FROM blocks GROUP BY 1",
    "validation_violations": f"""WITH {_BLOCKS} SELECT message, count(*) AS n FROM (SELECT 'bbox: x1 < x0' AS message FROM blocks WHERE "order" % 9 = 8 UNION ALL SELECT 'bbox: y1 < y0' FROM blocks WHERE "order" % 9 = 8 UNION ALL SELECT 'layout_role: unexpected' FROM blocks WHERE "order" % 11 = 10) GROUP BY 1""",
    "defaults_report": f"WITH {LINES_SQL} SELECT doc_id, count(*) AS blocks_seen, count(*) FILTER (length(text) % 3 = 0) AS defaulted_reading_order, count(*) FILTER (length(text) <= 50) AS defaulted_unit FROM lines GROUP BY 1",
    "text_items": f"""WITH {_BLOCKS}, k AS (SELECT *, CASE WHEN d = 3 THEN {s_norm("text")} ELSE text END AS txt FROM policed WHERE trim(text) <> '' AND (translate OR kind = 'formula'))
        SELECT document_id, count(*) AS n_items, min('p' || lpad((page_index + 1)::VARCHAR, 3, '0') || '-b' || lpad("order"::VARCHAR, 3, '0')) AS first_item, sum(length(txt))::BIGINT AS n_chars FROM k GROUP BY 1""",
    "assets": f"""WITH {LINES_SQL}, a AS (SELECT doc_id, line_no, 'a' || (length(text) % 7) AS asset_id, trim(left(text, 10)) AS uri FROM lines WHERE length(text) % 2 = 0 AND trim(left(text, 10)) <> '') SELECT doc_id, asset_id, arg_min(uri, line_no) AS uri FROM a GROUP BY ALL""",
    "records_synced": f"""WITH {LINES_SQL}, o AS (SELECT * FROM lines WHERE line_no % 5 <> 0), n AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN text || '!' ELSE text END AS text FROM lines WHERE line_no % 7 <> 0)
        SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.line_no, n.line_no) AS line_no, coalesce(n.text, o.text) AS source_text, CASE WHEN n.text IS NULL OR o.text IS NOT DISTINCT FROM n.text THEN reverse(o.text) ELSE '' END AS translated_text,
               CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'kept' WHEN o.text = n.text THEN 'unchanged' ELSE 'changed' END AS sync FROM o FULL JOIN n ON o.doc_id = n.doc_id AND o.line_no = n.line_no""",
    "policies_applied": f"WITH {_POLICED} SELECT doc_id, label, count(*) AS n, count(*) FILTER (label = '') AS to_translate FROM policed GROUP BY ALL",
    "page_summaries": f"""WITH {_POLICED}, d AS (SELECT *, (line_no % 3 = 0 AND trim(text) <> '') OR starts_with(label, 'skip_') AS done FROM policed)
        SELECT doc_id, page_idx, count(*) AS total_items, count(*) FILTER (done) AS translated_items, count(*) FILTER (label = '' AND NOT done) AS pending_items, count(*) FILTER (label <> '') AS skipped_items FROM d GROUP BY ALL""",
    "fast_path_reasons": f"""WITH {ITEMS_SQL}, c AS (SELECT *, {_bare} AS c, {s_norm("text")} AS t FROM items), s AS (SELECT *, length(c) <= 4 AND {s_has("c", "^[" + chr(92) + "p{L}" + chr(92) + "p{N} ]+$")} AS short FROM c)
        SELECT CASE WHEN trim(text) = '' THEN 'empty_source_text' WHEN c = '' THEN 'placeholder_only' WHEN line_no % 6 = 5 THEN 'policy_skip' WHEN {s_metadata("t")} THEN 'hard_metadata_fragment' WHEN short AND layout_role = 'title' THEN 'short_non_body_label'
            WHEN short AND line_no % 6 <> 4 AND line_no % 2 = 0 THEN 'short_non_body_label' ELSE 'none' END AS reason, count(*) AS n FROM s GROUP BY 1""",
    "classification_labels": f"""WITH {ITEMS_SQL}, a AS (SELECT i.*, {s_norm("text")} AS t, CASE WHEN quality = 0 THEN 'no_trans' WHEN toxic = 1 THEN 'skip_toxic' WHEN quality IS NULL THEN NULL ELSE 'translate' END AS answer FROM items i LEFT JOIN labels USING (doc_id))
        SELECT CASE WHEN line_no % 4 = 3 OR answer IS NULL OR answer = 'translate' THEN 'none' WHEN answer = 'skip_toxic' THEN answer WHEN line_no % 5 = 4 OR (layout_role <> 'title' AND NOT {s_code("t")}) OR length(text) >= 80 THEN 'none' ELSE 'skip_model_keep_origin' END AS label, count(*) AS n FROM a GROUP BY 1""",
    "glossary_csv": "SELECT * FROM (VALUES (0, 'ALPHA', '第一', 'last', 'preferred', 'exact', ''), (1, 'beta', '贝塔', '', 'canonical', 'regex', ''), (2, 'gamma', '伽马', 'n3', 'preferred', 'exact', '')) v(pos, source, target, note, level, match_mode, context)",
    "page_ranges": "SELECT id::BIGINT AS id, pages FROM (VALUES (0, '1,2,3,7'), (1, '2,3,4,5,8'), (2, '9'), (3, ''), (4, '1,3')) v(id, pages)",
    "events_jsonl": "SELECT * REPLACE (seq::BIGINT AS seq, progress_current::BIGINT AS progress_current) FROM (VALUES (1, 't1', 'info', 'a', 'e1', 'e1', '', NULL, 3), (5, 't3', 'warn', NULL, 'named', 'named', '', 'p', NULL), (7, '', 'info', NULL, 'event', 'event', 'm', NULL, NULL)) v(seq, ts, level, stage, event, event_type, message, substage, progress_current)",
}
