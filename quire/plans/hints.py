"""Queries of hints, routes, exception classes and approved pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import hints as H
from quire.operators import outputs as O
from quire.plans.outputs import COMMANDS, _PAGES, _pages
from quire.plans.tables import ITEMS_SQL, LINES_SQL, items, lines, q, s_any_contains, s_count, s_has, s_natural, s_norm

BLOCKS = [
    "Default: 12", "Type : string", "Note: This option controls the way it works", "- Default: x - Type: y", "Input: <file>", "1. Rules are seen when the bump order is governed by more than one of the vertices in it", "[3] Smith et al.",
    "This is a long closing remark about many different things that somebody wrote down here some time ago.", "Smith, John wrote a book about many things that are of no interest to us at all here.", "References", "energy, where E is defined as the sum",
]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-2, k, t) for k, t in enumerate(BLOCKS)], "doc_id long, line_no long, text string")
    return lines(spark, sf_dir).unionByName(own)


def block_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return _texts(spark, sf_dir).select("doc_id", "line_no", H.is_structured_block(c).alias("structured"), F.array_join(H.field_labels(c), "|").alias("labels"), H.skips_reference_text(c).alias("skips"), H.risk_phrases(c).alias("risky"))


def soft_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as blocks of lines, and some commands."""
    own = spark.createDataFrame([(-k - 10, f"{t}\nthe rest of this block is a line of plain English prose") for k, t in enumerate(COMMANDS)], "doc_id long, text string")
    from quire.plans.tables import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(own)
    return docs.select("doc_id", F.array_join(H.soft_hints(F.split("text", "\n"), F.col("text"), F.col("doc_id") % 2 == 0), ",").alias("hints"))


def hints_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("item_id", F.when(F.col("line_no") % 3 == 0, "old ").alias("style_hint"))
    hints = items(spark, sf_dir).where("line_no % 2 = 0").select("item_id", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("first").alias("kind"), F.lit("a").alias("hint")), F.struct(F.lit(2).alias("seq"), F.lit("second").alias("kind"), F.lit("b").alias("hint")))).alias("h")).select("item_id", "h.*")
    return H.apply_hints(rows, hints)


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = O.page_kind(F.col("large"), F.col("visible"), F.col("hidden"), F.col("vector"))
    return _pages(spark, sf_dir).select("book", "page_idx", H.page_routes(kind).alias("r")).groupBy("r.redaction", "r.background", "r.compose", "r.reason").agg(F.count(F.lit(1)).alias("n"))


RAISED = [
    ("FileNotFoundError: x", None, "render"), ("FileNotFoundError: x", None, "ocr"), ("x", 400, "t"), ("HTTP", 403, "t"), ("Too Many Requests", None, "t"), ("JSONDecodeError: Expecting value", None, "t"), ("fitz.FitzError", None, "t"), ("ReadTimeout rate limit", 429, "t"), ("boom", None, "t"), (None, 500, "t"), ("failed to render", None, "t"),
]


def exception_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(k, *r) for k, r in enumerate(RAISED)], "id long, text string, status int, stage string")
    return own.select("id", H.exception_class(F.col("text"), F.col("status"), F.col("stage")).alias("error_type"))


def approved_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive lines of a document are approved pairs, but for every seventh."""
    rows = lines(spark, sf_dir).where("doc_id >= 0")
    n = rows.groupBy("doc_id").agg(F.max("line_no").alias("top"))
    pairs = rows.join(n, "doc_id").where("line_no < top AND line_no % 7 <> 6").select("doc_id", F.col("line_no").alias("seq"), F.col("line_no").alias("prev_id"), (F.col("line_no") + 1).alias("next_id"))
    return H.approved_chains(pairs, "doc_id")


QUERIES = {f.__name__: f for f in (block_hints, soft_hints, hints_applied, page_routes, exception_classes, approved_chains)}

_kind = "CASE WHEN large AND hidden AND NOT visible THEN 'pseudo_editable_scan' WHEN large AND NOT visible THEN 'scan_image' WHEN vector THEN 'vector_heavy' WHEN large THEN 'mixed_complex' ELSE 'editable_text' END"
_route = lambda k: "CASE kind " + " ".join(f"WHEN {q(n)} THEN {q(v[k])}" for n, v in H.ROUTES.items()) + " END"
_labels = f"list_filter(list_transform(regexp_extract_all(t, {q(H.FIELD_LABEL)}, 1), lambda x: trim(x)), lambda x: x <> '')"
_low = f"lower(trim(regexp_replace(regexp_replace(text, {q(T.PLACEHOLDER)}, ' ', 'g'), '\\s+', ' ', 'g')))"
_lit = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v)


def _classes() -> str:
    out = []
    for k, (name, codes, needles) in enumerate(H.EXCEPTIONS):
        conds = [f"status IN ({', '.join(map(str, codes))})"] * bool(codes) + [f"contains(low, {q(n)})" for n in needles]
        out.append(f"WHEN {' OR '.join(conds)} THEN {q(name)}")
        if k == 1:
            out.append("WHEN stage = 'render' AND (contains(low, 'filenotfounderror') OR contains(low, 'no such file or directory')) THEN 'render_failed'")
    return " ".join(out)


SQL = {
    "block_hints": f"""WITH {LINES_SQL}, a AS (SELECT *, {s_norm("text")} AS t, trim(text) AS r FROM (SELECT * FROM lines UNION ALL SELECT -2, k, v FROM (VALUES {', '.join(f'({k}, {q(t)})' for k, t in enumerate(BLOCKS))}) w(k, v)))
        SELECT doc_id, line_no, t <> '' AND length(t) <= 1200 AND (len({_labels}) >= 2 OR (len({_labels}) = 1 AND {s_has("trim(regexp_extract(t, '^[^:]*:(.*)$', 1))", H.LITERAL)})) AS structured, array_to_string({_labels}, '|') AS labels,
            NOT (r <> '' AND NOT ({s_has("r", H.REFERENCE)} OR {s_has("r", H.NUMBERED_REFERENCE)} OR regexp_matches(lower(r), '^(references|bibliography)') OR contains(r, ' et al.') OR {s_has("r", chr(92) + "b" + chr(92) + "d{4}" + chr(92) + "b")}) AND {s_count("r", T.EN_WORD)} >= 12
                AND CASE WHEN {s_has("r", H.NUMBERED_SUMMARY)} THEN {s_has("r", H.SUMMARY_CUES)} ELSE {s_has("r", "[.。!?;；:]$")} AND {s_natural("r")} >= 12 END) AS skips, {s_any_contains(_low, H.RISKS)} AS risky FROM a""",
    "hints_applied": f"WITH {ITEMS_SQL} SELECT item_id, CASE WHEN line_no % 2 = 0 THEN CASE WHEN line_no % 3 = 0 THEN 'old' || chr(10) || 'b' ELSE 'b' END WHEN line_no % 3 = 0 THEN 'old ' END AS style_hint, CASE WHEN line_no % 2 = 0 THEN 'second' END AS structure_kind FROM items",
    "page_routes": f"WITH {_PAGES}, k AS (SELECT {_kind} AS kind FROM p) SELECT {_route(0)} AS redaction, {_route(1)} AS background, {_route(2)} AS compose, {_route(3)} AS reason, count(*) AS n FROM k GROUP BY ALL",
    "exception_classes": f"WITH r AS (SELECT id::BIGINT AS id, lower(coalesce(text, '')) AS low, status, stage FROM (VALUES {', '.join('(' + ', '.join(map(_lit, (k, *r))) + ')' for k, r in enumerate(RAISED))}) v(id, text, status, stage)) SELECT id, CASE {_classes()} ELSE 'python_unhandled_exception' END AS error_type FROM r",
    "approved_chains": f"""WITH {LINES_SQL}, m AS (SELECT *, line_no // 7 AS run, max(line_no) OVER (PARTITION BY doc_id) AS top FROM lines WHERE doc_id >= 0), c AS (SELECT *, min(line_no) OVER (PARTITION BY doc_id, run) AS head, count(*) OVER (PARTITION BY doc_id, run) AS n FROM m),
        k AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY run) AS r FROM c WHERE n >= 2) SELECT doc_id, line_no AS item_id, 'cg-review-' || lpad((1000 + r)::VARCHAR, 4, '0') AS continuation_group, line_no - head AS position FROM k""",
}
