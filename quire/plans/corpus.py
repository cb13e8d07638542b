"""Queries of the text-corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import corpus as C
from quire.plans.tables import ITEMS_SQL, LINES_SQL, items, lines, q, s_count, s_has, s_norm
from quire.plans.text_rules import s_prose

GLOSSARY = [
    (0, "The", "Der", "preferred", "exact", ""), (1, "that", "dass", "preferred", "case_insensitive", ""), (2, "SCF", "SCF", "preserve", "exact", ""), (3, "energy", "Energie", "canonical", "case_insensitive", "method"),
    (4, "th[ae]n", "als", "preferred", "regex", ""), (5, "ON", "an", "canonical", "exact", ""), (6, "HTTP/2", "HTTP/2", "preserve", "exact", ""), (7, "ziel", "", "preferred", "exact", ""), (8, "zzz", "qqq", "preferred", "exact", ""),
]
OVERLAY = [(0, "  scf ", "SCF!", "canonical", "exact", ""), (1, "new", "neu", "preferred", "exact", ""), (2, "THE", "Die", "preferred", "exact", ""), (3, "New", "Neu", "preferred", "exact", "")]
_SCHEMA = "pos int, source string, target string, level string, match_mode string, context string"
_values = lambda rows, name: f"(VALUES {', '.join('(' + ', '.join(str(v) if isinstance(v, int) else q(v) for v in r) + ')' for r in rows)}) {name}(pos, source, target, level, match_mode, context)"


def _glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([g for g in GLOSSARY if g[2]], _SCHEMA)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumns({"grouped": F.col("line_no") % 13 == 12, "protected": F.size(T.placeholder_sequence(F.col("text"))) > 0})
    sig = C.signature(F.lit("text"), F.col("layout_role"), F.lit("body"), F.col("text"), F.col("grouped"), F.col("protected"))
    return rows.withColumn("sig", sig)


def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedupe(_items(spark, sf_dir), "sig", ["item_id"]).select("item_id", "rep_id", (F.col("rep_id") == F.col("item_id")).alias("is_unique"))


def dedupe_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = C.dedupe(_items(spark, sf_dir), "sig", ["item_id"])
    results = deduped.where("rep_id = item_id").select("item_id", F.left("text", F.lit(40)).alias("result"))
    return C.fan_out(deduped, results)


def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", "line_no", F.sha2(T.normalize_text(F.col("text")), 256).alias("key"))
    cache = rows.where("doc_id % 5 = 0").groupBy("key").agg(F.min("doc_id").alias("value"))
    return C.cache_split(rows, cache, "key").groupBy("doc_id").agg(F.count(F.when(F.col("hit"), 1)).alias("hits"), F.count(F.when(~F.col("hit"), 1)).alias("misses"))


def _queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _items(spark, sf_dir).where("trim(text) <> ''")
    low = C.is_low_risk(F.col("text"), F.col("layout_role") != "title", F.col("grouped"))
    return rows.withColumn("queue", C.queue_of(low, F.length("text") > 900))


def queue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queued(spark, sf_dir).groupBy("queue").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.batches(_queued(spark, sf_dir), "doc_id", ["line_no"], batch_size=4).select("item_id", "queue", "batch_id")


def pending_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of five lines that continue each other count as one unit if they have two members or more."""
    rows = items(spark, sf_dir).where("trim(text) <> ''").withColumn("g", F.when(F.col("line_no") % 10 < 5, F.floor(F.col("line_no") / 10)))
    n = rows.groupBy("doc_id", "g").agg(F.count(F.lit(1)).alias("members"), F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])).alias("source"))
    groups = n.where("g IS NOT NULL AND members >= 2").select("doc_id", F.concat(F.lit("group-"), F.col("g").cast("string")).alias("unit_id"), "members", F.sha2("source", 256).alias("source_sha"))
    lone = n.where("g IS NOT NULL AND members < 2").select("doc_id", "g")
    single = rows.join(lone.withColumn("lone", F.lit(True)), ["doc_id", "g"], "left").where("g IS NULL OR lone")
    return groups.unionByName(single.select("doc_id", F.concat(F.lit("item-"), F.col("line_no").cast("string")).alias("unit_id"), F.lit(1).cast("long").alias("members"), F.sha2("text", 256).alias("source_sha")))


def preserve_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.preserve_terms(lines(spark, sf_dir), "text", ["doc_id", "line_no"], existing=_glossary(spark))


def glossary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.match_glossary(items(spark, sf_dir), _glossary(spark), "text")


def glossary_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("text", F.reverse("text").alias("translated"))
    return C.glossary_usage(rows, _glossary(spark), "text", "translated")


def glossary_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = C.merge_glossaries(spark.createDataFrame(GLOSSARY, _SCHEMA), spark.createDataFrame(OVERLAY, _SCHEMA))
    return out.withColumn("pos", F.col("pos").cast("long"))


def glossary_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.overridden_count(spark.createDataFrame(GLOSSARY, _SCHEMA), spark.createDataFrame(OVERLAY, _SCHEMA))


_PAIRS = ["模型（Model One）很好，能量(energy)", "能量（又称energy）", "没有", "密度泛函理论 ( DFT )", "理论(or DFT theory.)"]


def term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-k - 1, t) for k, t in enumerate(_PAIRS)], "item_id long, text string")
    return C.term_pairs(items(spark, sf_dir).select("item_id", "text").unionByName(own), "text")


def _memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of lines as terms of their source."""
    from quire.plans.tables import table

    src = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = lines(spark, sf_dir).join(src, "doc_id").withColumn("key", F.regexp_extract("text", r"^[A-Za-z]+", 0)).where("length(key) >= 2")
    rows = rows.select("source", "key", F.col("doc_id").alias("d"), F.col("line_no").alias("l"), F.left("text", F.lit(12)).alias("value"), (F.col("doc_id") % 20).cast("string").alias("origin"))
    return C.fold_memory(rows.withColumnRenamed("source", "job").withColumnRenamed("origin", "source"), ["job", "key"], ["d", "l"])


def memory_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memory(spark, sf_dir).select("job", "key", "hits", "value", F.array_join("sources", ",").alias("sources"))


def memory_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.trim_memory(_memory(spark, sf_dir), ["job"], "key", 40)
    return C.prompt_terms(kept, ["job"], "key").select("job", "key", "hits", F.col("rank").cast("long").alias("rank"))


QUERIES = {
    f.__name__: f
    for f in (exact_dedupe, dedupe_fanout, cache_split, queue_split, batch_chunks, pending_units, preserve_terms, glossary_match, glossary_usage, glossary_merge, glossary_overridden, term_pairs, memory_fold, memory_topk)
}

_SIG = f"""{ITEMS_SQL}, sig AS (SELECT *, line_no % 13 = 12 AS grouped, CASE WHEN line_no % 13 <> 12 AND {s_count("text", T.PLACEHOLDER)} = 0 AND trim(text) <> '' THEN layout_role || chr(1) || trim(text) END AS sig FROM items),
    rep AS (SELECT *, CASE WHEN sig IS NULL THEN item_id ELSE min(item_id) OVER (PARTITION BY sig) END AS rep_id FROM sig)"""
_compact = f"trim(regexp_replace(regexp_replace(text, {q(T.PLACEHOLDER)}, ' ', 'g'), '\\s+', ' ', 'g'))"
_QUEUED = f"""{_SIG}, queued AS (SELECT *, CASE WHEN layout_role <> 'title' AND NOT grouped AND {s_prose("text")} AND length({_compact}) BETWEEN 16 AND 1200 AND {s_count("text", T.PLACEHOLDER)} <= 8 THEN 'batched_fast'
    WHEN length(text) > 900 THEN 'single_slow' ELSE 'single_fast' END AS queue FROM sig WHERE trim(text) <> '')"""
_G = f"g AS (SELECT * FROM {_values([g for g in GLOSSARY if g[2]], 'v')})"
_KEY = "lower(trim(source))"
#: RE2 knows no Unicode word edges: separators are doubled, so that a match can take one on either side.
_DOUBLED = "regexp_replace(text, '([^\\p{L}\\p{N}_])', '\\1\\1', 'g')"
_TERM = r"(?:^|[^\p{L}\p{N}_])([A-Z][a-z]+(?:--[A-Z][A-Za-z0-9]+)+|[A-Z]{2,}(?:(?:--|_|//)[A-Za-z0-9]+)+|[A-Za-z]+[0-9][A-Za-z0-9]*(?:(?:--|_|//)[A-Za-z0-9]+)*|[A-Z]{2,}[a-z]*)(?:$|[^\p{L}\p{N}_])"
_TERMS = f"""WITH {LINES_SQL}, {_G}, m AS (SELECT doc_id, line_no, unnest(range(len(r))) AS k_, unnest(r) AS raw FROM (SELECT doc_id, line_no, list_transform(regexp_extract_all({_DOUBLED}, {q(_TERM)}, 1), lambda x: replace(replace(x, '--', '-'), '//', '/')) AS r FROM lines)),
    t AS (SELECT *, trim(raw, {q(C.TRIM_CHARS)}) AS term FROM m),
    k AS (SELECT *, lower(term) AS key FROM t WHERE length(term) >= 2 AND upper(term) NOT IN ({', '.join(map(q, C.COMMON_WORDS))})
          AND CASE WHEN {s_has("term", "[-_/]")} OR {s_has("term", chr(92) + "d")} THEN {s_has("term", chr(92) + "p{L}")} ELSE upper(term) = term AND {s_has("term", chr(92) + "p{L}")} AND length(term) <= 12 END),
    c AS (SELECT key, count(*) AS hits, arg_min(term, (doc_id, line_no, k_)) AS term FROM k GROUP BY 1)
    SELECT term, hits FROM c WHERE key NOT IN (SELECT lower(source) FROM g) ORDER BY hits DESC, lower(term) LIMIT {C.MAX_TERMS}"""
_edge = lambda p, flags: f"regexp_matches(text, {flags} || '(^|[^A-Za-z0-9_])' || {p} || '($|[^A-Za-z0-9_])')"
_MEMORY = f"""{LINES_SQL}, o AS (SELECT d.source AS job, regexp_extract(l.text, '^[A-Za-z]+') AS key, l.doc_id AS d, l.line_no AS l, left(l.text, 12) AS value, (l.doc_id % 20)::VARCHAR AS source FROM lines l JOIN documents d USING (doc_id) WHERE length(regexp_extract(l.text, '^[A-Za-z]+')) >= 2),
    f AS (SELECT job, key, source, min((d, l)) AS o FROM o GROUP BY ALL), s AS (SELECT job, key, array_to_string(list(source ORDER BY o)[-8:], ',') AS sources FROM f GROUP BY ALL),
    a AS (SELECT job, key, count(*) AS hits, arg_max(value, (d, l)) AS value FROM o GROUP BY ALL)"""

SQL = {
    "exact_dedupe": f"WITH {_SIG} SELECT item_id, rep_id, rep_id = item_id AS is_unique FROM rep",
    "dedupe_fanout": f"WITH {_SIG} SELECT r.item_id, r.rep_id, left(f.text, 40) AS result FROM rep r JOIN items f ON f.item_id = r.rep_id",
    "cache_split": f"""WITH {LINES_SQL}, k AS (SELECT doc_id, {s_norm("text")} AS t FROM lines), c AS (SELECT DISTINCT t FROM k WHERE doc_id % 5 = 0)
        SELECT doc_id, count(c.t) AS hits, count(*) - count(c.t) AS misses FROM k LEFT JOIN c USING (t) GROUP BY 1""",
    "queue_split": f"WITH {_QUEUED} SELECT queue, count(*) AS n, sum(length(text))::BIGINT AS chars FROM queued GROUP BY 1",
    "batch_chunks": f"""WITH {_QUEUED}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, queue ORDER BY line_no) - 1 AS k FROM queued)
        SELECT item_id, queue, CASE WHEN queue = 'batched_fast' THEN 'b' || (k // 6) ELSE 's' || substr(queue, 8, 1) || k END AS batch_id FROM k""",
    "pending_units": f"""WITH {ITEMS_SQL}, r AS (SELECT doc_id, line_no, text, CASE WHEN line_no % 10 < 5 THEN line_no // 10 END AS g FROM items WHERE trim(text) <> ''),
        c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM r)
        SELECT doc_id, 'group-' || g AS unit_id, count(*) AS members, sha256(string_agg(text, ' ' ORDER BY line_no)) AS source_sha FROM c WHERE g IS NOT NULL AND n >= 2 GROUP BY doc_id, g
        UNION ALL SELECT doc_id, 'item-' || line_no, 1, sha256(text) FROM c WHERE g IS NULL OR n < 2""",
    "preserve_terms": _TERMS,
    "glossary_match": f"""WITH {ITEMS_SQL}, {_G}, h AS (SELECT item_id, source, target, level, context, CASE match_mode WHEN 'regex' THEN regexp_matches(text, source)
            WHEN 'case_insensitive' THEN {_edge("regexp_escape(source)", "'(?i)'")} ELSE {_edge("regexp_escape(source)", "''")} END AS hit, text FROM items, g)
        SELECT item_id, source, target, level FROM h WHERE hit AND (context = '' OR contains(lower(text), lower(context)))""",
    "glossary_usage": f"""WITH {LINES_SQL}, {_G}, k AS (SELECT {_KEY} AS key, level, bool_or(contains(lower(text), lower(source))) AS s, bool_or(contains(lower(reverse(text)), lower(target))) AS t FROM lines, g GROUP BY ALL)
        SELECT count(*) AS entry_count, count(*) FILTER (s) AS source_hit_entry_count, count(*) FILTER (t) AS target_hit_entry_count, count(*) FILTER (NOT s) AS unused_entry_count,
               count(*) FILTER (s AND NOT t) AS unapplied_source_hit_entry_count, count(*) FILTER (t AND level = 'preferred') AS preferred_hit_entry_count,
               round(count(*) FILTER (t AND level = 'preferred') / count(*) FILTER (level = 'preferred'), 4) AS preferred_adoption_rate FROM k""",
    "glossary_merge": f"""WITH b AS (SELECT 0 AS t, * FROM {_values(GLOSSARY, "v")} UNION ALL SELECT 1, * FROM {_values(OVERLAY, "o")}),
        w AS (SELECT *, min((t, pos)) OVER (PARTITION BY {_KEY}) AS f, max((t, pos)) OVER (PARTITION BY {_KEY}) AS l FROM b)
        SELECT row_number() OVER (ORDER BY f) - 1 AS pos, source, target, level, match_mode, context FROM w WHERE (t, pos) = l""",
    "glossary_overridden": f"SELECT count(*) AS overridden FROM {_values(OVERLAY, 'o')} WHERE {_KEY} IN (SELECT {_KEY} FROM {_values(GLOSSARY, 'v')})",
    "term_pairs": f"""WITH {ITEMS_SQL}, t AS (SELECT item_id, text FROM items UNION ALL SELECT -k, t FROM (VALUES {', '.join(f"({k + 1}, {q(t)})" for k, t in enumerate(_PAIRS))}) p(k, t)),
        m AS (SELECT item_id, unnest(list_concat(regexp_extract_all(text, {q(C.TERM_PAIRS[0])}), regexp_extract_all(text, {q(C.TERM_PAIRS[1])}))) AS m FROM t)
        SELECT DISTINCT item_id, trim(regexp_extract(m, '[（(](?:或称|又称|简称|or |also known as )?([A-Za-z][A-Za-z0-9 ._+/-]*)[）)]$', 1), ' .') AS key, regexp_extract(m, '^[^（(]+') AS value, 1.0::DOUBLE AS score FROM m""",
    "memory_fold": f"WITH {_MEMORY} SELECT job, key, hits, value, sources FROM a JOIN s USING (job, key)",
    "memory_topk": f"""WITH {_MEMORY}, k AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY job ORDER BY hits DESC, key DESC) <= 40),
        r AS (SELECT job, key, hits, row_number() OVER (PARTITION BY job ORDER BY hits DESC, key) AS rank FROM k) SELECT * FROM r WHERE rank <= 20""",
}
