"""Queries of output checks, runs, regions and layout signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import outputs as O
from quire.plans.diagnostics import runs
from quire.plans.tables import ITEMS_SQL, LINES_SQL, box, items, lines, q, s_count, s_has, s_natural, s_norm, table
from quire.plans.text_rules import s_prose, s_url

COMMANDS = [
    "gcc -O2 -o main.out main.c builds the program from all of its source files", "xtb input.xyz --opt tight runs the geometry optimisation of the given molecule", "run it now because the method shows that energy is conserved", "ls | wc -l counts how many files there are in the current folder",
    "a = 1 sets the first value", "Python -m pip install it", "tool2 12 13 prints both of the given numbers on the first line",
]


def command_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-2, k, t) for k, t in enumerate(COMMANDS)], "doc_id long, line_no long, text string")
    return lines(spark, sf_dir).unionByName(own).select("doc_id", "line_no", O.command_prefix(F.col("text")).alias("prefix"))


def _translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for outputs: by line number the source, nothing, an odd dollar sign, a shell, lost or new tokens, or CJK text."""
    n, t = F.col("line_no") % 8, F.col("text")
    src = F.concat(t, F.when(F.col("line_no") % 3 == 0, " <f1-abc/> <t1-def/>").otherwise(""))
    out = (
        F.when(n == 0, src).when(n == 1, "").when(n == 2, F.concat(t, F.lit("$"))).when(n == 3, '{"translated_text": "x"}').when(n == 4, F.concat(F.lit("译文 <f9-zzz/> "), t)).when(n == 5, F.concat(F.lit("译文 "), t)).when(n == 6, F.concat(F.lit("译文 <t1-def/> <f1-abc/>"), F.lit("")))
        .otherwise(F.concat(F.lit("这里是译文内容部分 "), F.left(t, F.lit(20))))
    )
    return items(spark, sf_dir).withColumn("source", src).withColumn("output", out)


def output_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _translated(spark, sf_dir).select("item_id", O.first_problem(F.col("source"), F.col("output")).alias("problem"))


def english_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _translated(spark, sf_dir)
    return rows.select("item_id", O.is_mainly_english(F.col("source"), F.col("output"), F.col("layout_role") != "title").alias("is_english"))


ANSWERS = ['```json\n{"translated_text": "a", "n": 1}\n```', "text before {“translated_text”：“b”} after", "translated_text: c", "no object", None, '{"translation": "d"}', "Translation： e\nmore"]


def answers_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(k, a) for k, a in enumerate(ANSWERS)], "id long, answer string")
    return own.select("id", O.json_text(F.col("answer")).alias("json"), O.string_field(F.col("answer"), "translated_text", "translation").alias("value"))


TERMS = [("DFT", "密度泛函"), ("DFT", "dft"), ("the", "这"), ("a", "甲"), ("model", "模型的能量"), ("very long key with words", "模型"), ("energy", "能量，模型"), ("energy", "energy level"), ("基组", "基组"), ("x1", "一二三四五六七八九")]


def terms_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(k, *t) for k, t in enumerate(TERMS)], "id long, key string, value string")
    return own.select("id", O.term_allowed(F.col("key"), F.col("value")).alias("allowed"))


def heavy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten lines make a group; characters stand for formula segments."""
    g = lines(spark, sf_dir).groupBy("doc_id", F.floor(F.col("line_no") / 4).alias("g")).agg(F.count(F.lit(1)).alias("members"), F.sum(F.length("text")).alias("chars"), F.sum(F.regexp_count("text", F.lit("[.,]"))).alias("segments"))
    return g.groupBy(F.coalesce(O.heavy_group(F.floor(F.col("segments") / 2), F.col("chars"), F.col("members"), F.col("g") % 3 == 0), F.lit("whole")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


FAILED = [
    ("failed", "x: Failed to resolve host", "", 1, "t"), ("failed", "", "log ReadTimeout 401", None, "t"), ("failed", "", "all 401 things", None, "t"), ("failed", "boom", "", -1, "t"), ("failed", "", "HTTP 429", 2, "t"), ("failed", "", "", 3, "rendering"), ("failed", None, None, 3, None),
    ("failed", "", "", None, "t"), ("succeeded", "", "401", 0, "t"), (None, "", "", 0, "t"), ("failed", "placeholder instability", "", None, "t"), ("failed", "", "downloading @preview/x", 1, "rendering"), ("failed", "", "source pdf not found", 1, ""),
]


def job_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(k, *f) for k, f in enumerate(FAILED)], "id long, status string, error string, log string, code int, stage string")
    real = runs(spark, sf_dir).select((F.col("event_id") + 1000).alias("id"), F.when(F.col("success"), "succeeded").otherwise("failed").alias("status"), F.col("error_class").alias("error"), F.lit("").alias("log"), F.col("status_code").alias("code"), F.col("stage"))
    both = own.unionByName(real)
    return both.groupBy(F.coalesce(O.job_failure(*[F.col(c) for c in ("status", "error", "log", "code", "stage")]), F.lit("none")).alias("failure")).agg(F.count(F.lit(1)).alias("n"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of raw HTML stand for pages of a scan: their lengths and ids decide what layers they have."""
    p, n = table(spark, sf_dir, "pages"), F.length("html")
    return p.select((F.col("page_id") / 10).cast("long").alias("book"), (F.col("page_id") % 10).alias("page_idx"), (n % 2 == 0).alias("large"), (n % 3 > 0).alias("visible"), (n % 5 > 1).alias("hidden"), (n % 7 == 0).alias("vector"))


def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = O.page_kind(F.col("large"), F.col("visible"), F.col("hidden"), F.col("vector"))
    names = [*O.REDACTION, ""]
    route = O.redaction_route(F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("page_idx") % len(names) + 1).cast("int")), F.col("vector"))
    return _pages(spark, sf_dir).groupBy(kind.alias("kind"), route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


def render_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.render_mode(_pages(spark, sf_dir).withColumn("editable", F.col("visible")).withColumn("pseudo_scan", F.col("large") & F.col("hidden") & ~F.col("visible")), "book")


def reader_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids have three digits or four here, four there, and every fifth source is missing."""
    rows = items(spark, sf_dir)
    page = F.concat(F.lit("p"), F.lpad((F.col("page_idx") + 1).cast("string"), 3, "0"), F.lit("-b"))
    number = F.col("line_no").cast("string")
    mine = rows.select("doc_id", F.concat(page, F.when(F.col("line_no") % 2 == 0, F.lpad(number, 3, "0")).otherwise(F.lpad(number, 4, "0"))).alias("item_id"), "page_idx", F.left("text", F.lit(5)).alias("text"))
    source = rows.where("line_no % 5 <> 4").select("doc_id", F.concat(page, F.lpad(number, 4, "0")).alias("id"), (F.col("page_idx") + 1).alias("page"), F.length("text").cast("string").alias("text"))
    return O.reader_regions(mine, source).select("doc_id", "item_id", "matched", "page", "source_text")


def artifact_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("pdf/"), F.col("o_orderkey").cast("string"))).alias("pdf"), F.concat(F.lit("md/"), "o_orderstatus").alias("markdown"), F.when(F.col("o_orderkey") % 3 == 0, " ").alias("zip"))
    return O.artifact_entries(jobs, {"pdf": "rendered", "markdown": "text", "zip": "bundle"})


def column_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("textish", F.col("layout_role") != "title").withColumn("page_width", F.lit(600.0))
    return O.column_mode(rows, ["doc_id", "page_idx"])


def provider_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).withColumn("g", F.when(F.col("line_no") % 4 > 0, F.concat(F.lit("g"), F.floor(F.col("line_no") / 12).cast("string"))))
    return O.provider_hints(rows, "doc_id", "g", ["line_no"]).select("item_id", "hint_role", "hint_scope", F.col("hint_order").cast("long").alias("hint_order"))


def guarded_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).select("doc_id", "page_idx", F.col("item_id").alias("id"), box().alias("r"))
    guards = rows.groupBy("doc_id", "page_idx").agg(F.min("id").alias("id")).withColumn("r", G.rect(F.lit(60.0), F.lit(45.0), F.lit(120.0), F.lit(100.0)))
    out = O.subtract(rows, guards, ["doc_id", "page_idx"])
    return out.groupBy("id").agg(F.count(F.lit(1)).alias("pieces"), F.round(F.sum(G.area(F.col("r"))), 4).alias("area"))


QUERIES = {
    f.__name__: f
    for f in (command_prefixes, output_checks, english_outputs, answers_parsed, terms_allowed, heavy_groups, job_failures, page_kinds, render_modes, reader_regions, artifact_entries, column_modes, provider_hints, guarded_pieces)
}

_tok = "string_split(t, ' ')"
_head = f"{_tok}[1]"
_ops = ", ".join(map(q, O.COMMAND_OPERATORS))
_value = f"(x IN ({_ops}) OR {s_has('x', O.ARGUMENT)} OR {s_has('x', O.FLAG)} OR {s_has('x', O.NUMBER)} OR {s_has('x', O.FILE)} OR {s_has('x', '[/' + chr(92) * 2 + '_=]')} OR b IN ({_ops}) OR {s_has('b', O.FLAG)})"
_some = lambda lst, p: f"(len(list_filter({lst}, lambda y: {s_has('y', p)})) > 0)::INT"
_PAGES = "p AS (SELECT page_id // 10 AS book, page_id % 10 AS page_idx, length(html) % 2 = 0 AS large, length(html) % 3 > 0 AS visible, length(html) % 5 > 1 AS hidden, length(html) % 7 = 0 AS vector FROM pages)"
_TRANSLATED = f"""{ITEMS_SQL}, s AS (SELECT *, text || CASE WHEN line_no % 3 = 0 THEN ' <f1-abc/> <t1-def/>' ELSE '' END AS source FROM items),
    o AS (SELECT *, CASE line_no % 8 WHEN 0 THEN source WHEN 1 THEN '' WHEN 2 THEN text || '$' WHEN 3 THEN '{{"translated_text": "x"}}' WHEN 4 THEN '译文 <f9-zzz/> ' || text WHEN 5 THEN '译文 ' || text WHEN 6 THEN '译文 <t1-def/> <f1-abc/>' ELSE '这里是译文内容部分 ' || left(text, 20) END AS output FROM s),
    k AS (SELECT *, regexp_extract_all(source, {q(T.PLACEHOLDER)}) AS ps, regexp_extract_all(output, {q(T.PLACEHOLDER)}) AS po FROM o)"""
_bare = lambda c: f"regexp_replace({c}, {q(T.PLACEHOLDER)}, ' ', 'g')"
_spans = f"len(list_filter(list_transform(regexp_extract_all({_bare('output')}, {q(O.RESIDUE)}), lambda z: trim(regexp_replace(z, '\\s+', ' ', 'g'))), lambda z: {s_count('z', T.EN_WORD)} >= 10 AND {s_prose('z')}))"
_plain = f"trim({_bare('source')})"
_segments = f"list_filter(list_transform(regexp_split_to_array(replace({_plain}, ' and ', ', '), ',|;|\\band\\b'), lambda s: trim(s, ' *†‡§,;')), lambda s: s <> '')"
_authors = f"(length({_plain}) <= 240 AND NOT contains({_plain}, '@') AND len({_segments}) >= 3 AND len(list_filter({_segments}, lambda s: len(regexp_extract_all(s, {q(T.AUTHOR_NAME)})) BETWEEN 2 AND 5)) >= greatest(3, len({_segments}) - 1))"
_lit = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
_hay = "concat_ws(chr(10), nullif(trim(coalesce(error, '')), ''), coalesce(log, ''))"
_fails = " ".join(f"WHEN {'code = -1' if n is None else '(' + ' OR '.join(f'contains(h, {q(x)})' for x in n) + ')'} THEN {q(name)}" for name, n in O.FAILURES)

SQL = {
    "command_prefixes": f"""WITH {LINES_SQL}, a AS (SELECT doc_id, line_no, {s_norm("text")} AS t FROM (SELECT * FROM lines UNION ALL SELECT -2, k, v FROM (VALUES {', '.join(f'({k}, {q(t)})' for k, t in enumerate(COMMANDS))}) w(k, v))),
        e AS (SELECT doc_id, line_no, t, {_tok} AS w, unnest(range(1, len({_tok}) + 1)) AS i FROM a), f AS (SELECT doc_id, line_no, t, min(i) FILTER (i > 1 AND NOT v) AS stop FROM (SELECT *, w[i] AS x, coalesce(w[i - 1], '') AS b, {_value.replace("x ", "w[i] ").replace("(x,", "(w[i],").replace("(b,", "(coalesce(w[i - 1], ''),").replace("b IN", "coalesce(w[i - 1], '') IN")} AS v FROM e) GROUP BY ALL),
        u AS (SELECT *, {_tok} AS w, coalesce(stop - 1, len({_tok})) AS used FROM f), p AS (SELECT *, w[1:used] AS p, w[2:used] AS tail, array_to_string(w[used + 1:], ' ') AS rest FROM u)
        SELECT doc_id, line_no, CASE WHEN len(w) >= 3 AND {s_has("w[1]", O.HEAD)} AND (lower(w[1]) = w[1] OR {s_has("w[1]", "[0-9.-]")}) AND used >= 3
            AND {_some("tail", O.FLAG)} * 2 + {_some("tail", O.FILE)} * 2 + {_some("tail", O.ARGUMENT)} * 2 + (len(list_filter(p, lambda y: y IN ({_ops}))) > 0)::INT * 2 + (len(list_filter(tail, lambda y: {s_has("y", O.NUMBER)})) >= 2)::INT + {_some("tail", "[/" + chr(92) * 2 + "=]")} + ({s_has("w[1]", "[0-9.-]")})::INT >= 2
            AND {s_natural("rest")} >= 6 THEN array_to_string(p, ' ') ELSE '' END AS prefix FROM p""",
    "output_checks": f"""WITH {_TRANSLATED} SELECT item_id, CASE WHEN trim(output) = '' THEN 'empty' WHEN ({s_count("output", chr(92) + "$")} - {s_count("output", chr(92) * 3 + "$")}) % 2 <> 0 THEN 'math' WHEN starts_with(output, '{{') AND contains(output, '"translated_text"') THEN 'shell'
        WHEN {s_norm("source")} = {s_norm("output")} AND {s_prose("source")} THEN 'untranslated' WHEN len(list_filter(po, lambda y: NOT list_contains(ps, y))) > 0 THEN 'unexpected_placeholder' WHEN list_sort(po) <> list_sort(ps) THEN 'placeholder_inventory' WHEN po <> ps THEN 'warn_order' END AS problem FROM k""",
    "english_outputs": f"""WITH {_TRANSLATED}, c AS (SELECT *, {s_count(_bare("output"), T.EN_WORD)} AS n, {s_count(_bare("output"), "[一-鿿]")} AS zh, {_spans} AS spans, {_authors} AS authors FROM k)
        SELECT item_id, layout_role <> 'title' AND trim(output) <> '' AND {s_prose("source")} AND NOT authors AND (spans > 0 OR (n >= 12 AND (zh = 0 OR n >= greatest(12, zh // 2)))) AS is_english FROM c""",
    "answers_parsed": """SELECT * REPLACE (id::BIGINT AS id) FROM (VALUES (0, '{"translated_text": "a", "n": 1}', 'a'), (1, '{"translated_text":"b"}', 'b'), (2, NULL, 'c'), (3, NULL, NULL), (4, NULL, NULL), (5, '{"translation": "d"}', 'd'), (6, NULL, 'e')) v(id, json, value)""",
    "terms_allowed": "SELECT * REPLACE (id::BIGINT AS id) FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, false), (5, false), (6, false), (7, false), (8, true), (9, false)) v(id, allowed)",
    "heavy_groups": f"""WITH {LINES_SQL}, g AS (SELECT doc_id, line_no // 4 AS g, count(*) AS members, sum(length(text)) AS chars, sum({s_count("text", "[.,]")}) // 2 AS seg FROM lines GROUP BY ALL)
        SELECT CASE WHEN seg > 12 THEN 'formula_heavy_group' WHEN seg > 8 THEN 'formula_windowed_group' WHEN chars > 1600 AND g % 3 <> 0 THEN 'long_continuation_group' WHEN members > 3 AND g % 3 <> 0 THEN 'large_continuation_group' ELSE 'whole' END AS reason, count(*) AS n FROM g GROUP BY 1""",
    "job_failures": f"""WITH j AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, f)) + ')' for f in FAILED)}) v(status, error, log, code, stage)
            UNION ALL SELECT CASE WHEN event_type <> 'error' THEN 'succeeded' ELSE 'failed' END, CASE k % 7 WHEN 0 THEN 'ReadTimeout' WHEN 1 THEN 'ValueError' ELSE '' END, '', CASE WHEN k % 3 = 0 THEN 500 + k % 5 END, event_type FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)),
        h AS (SELECT *, {_hay} AS h FROM j)
        SELECT CASE WHEN status IS DISTINCT FROM 'failed' THEN 'none' {_fails} WHEN contains(coalesce(stage, ''), 'render') THEN 'render_failed' WHEN code <> 0 THEN 'process_exit_failed' ELSE 'unknown' END AS failure, count(*) AS n FROM h GROUP BY 1""",
    "page_kinds": f"""WITH {_PAGES} SELECT CASE WHEN large AND hidden AND NOT visible THEN 'pseudo_editable_scan' WHEN large AND NOT visible THEN 'scan_image' WHEN vector THEN 'vector_heavy' WHEN large THEN 'mixed_complex' ELSE 'editable_text' END AS kind,
        CASE page_idx % 8 {' '.join(f"WHEN {k} THEN {q(v)}" for k, v in enumerate(O.REDACTION.values()))} ELSE CASE WHEN vector THEN 'visual_cover' ELSE 'auto' END END AS route, count(*) AS n FROM p GROUP BY ALL""",
    "render_modes": f"""WITH {_PAGES}, f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY book ORDER BY page_idx) <= 3)
        SELECT book, CASE WHEN count(*) FILTER (large AND hidden AND NOT visible) < count(*) AND count(*) FILTER (visible) >= ceil(count(*) / 2) THEN 'typst' ELSE 'typst_visual' END AS mode FROM f GROUP BY 1""",
    "reader_regions": f"""WITH {ITEMS_SQL}, n AS (SELECT *, 'p' || lpad((page_idx + 1)::VARCHAR, 3, '0') || '-b' AS pre FROM items)
        SELECT doc_id, pre || CASE WHEN line_no % 2 = 0 THEN lpad(line_no::VARCHAR, 3, '0') ELSE lpad(line_no::VARCHAR, 4, '0') END AS item_id, CASE WHEN line_no % 5 = 4 THEN 'own' WHEN line_no % 2 = 1 THEN 'id' ELSE 'canonical' END AS matched, page_idx + 1 AS page,
               CASE WHEN line_no % 5 = 4 THEN left(text, 5) ELSE length(text)::VARCHAR END AS source_text FROM n""",
    "artifact_entries": """SELECT o_orderkey AS job_id, 'pdf' AS artifact_key, 'rendered' AS artifact_group, 'pdf/' || o_orderkey AS relative_path FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'markdown', 'text', 'md/' || o_orderstatus FROM orders""",
    "column_modes": f"""WITH {ITEMS_SQL}, g AS (SELECT doc_id, page_idx, text, (x0 + x1) / 2 AS c, CASE WHEN x1 - x0 >= 600 * 0.62 THEN 'full' WHEN (x0 + x1) / 2 <= 300 THEN 'left' ELSE 'right' END AS guess, layout_role <> 'title' AND (x1 - x0) / 600 BETWEEN 0.18 AND 0.48 AS slot FROM items),
        a AS (SELECT doc_id, page_idx, count(*) FILTER (slot AND guess = 'left') AS ls, count(*) FILTER (slot AND guess = 'right') AS rs, count(*) FILTER (slot AND guess = 'left' AND trim(text) <> '') AS lc, count(*) FILTER (slot AND guess = 'right' AND trim(text) <> '') AS rc,
            count(*) FILTER (length(trim(text)) < 2 AND guess <> 'full') AS gaps, quantile_cont(c, 0.5) FILTER (slot AND guess = 'left' AND trim(text) <> '') AS lm, quantile_cont(c, 0.5) FILTER (slot AND guess = 'right' AND trim(text) <> '') AS rm FROM g GROUP BY ALL),
        d AS (SELECT *, (lc >= 2 AND rc >= 2) OR (ls >= 2 AND rs >= 2) OR (ls >= 1 AND rs >= 1 AND gaps > 0) AS dbl FROM a)
        SELECT doc_id, page_idx, CASE WHEN dbl THEN 'double' ELSE 'single' END AS mode, round(CASE WHEN dbl THEN coalesce((lm + rm) / 2, 300.0) ELSE 300.0 END, 3) AS split_x FROM d""",
    "provider_hints": f"""WITH {ITEMS_SQL}, g AS (SELECT *, CASE WHEN line_no % 4 > 0 THEN line_no // 12 END AS g FROM items), w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY line_no) - 1 AS k, count(*) OVER (PARTITION BY doc_id, g) AS n, max(page_idx) OVER (PARTITION BY doc_id, g) > min(page_idx) OVER (PARTITION BY doc_id, g) AS far FROM g)
        SELECT item_id, CASE WHEN g IS NULL THEN '' WHEN n = 1 THEN 'single' WHEN k = 0 THEN 'head' WHEN k = n - 1 THEN 'tail' ELSE 'middle' END AS hint_role, CASE WHEN g IS NULL THEN '' WHEN far THEN 'cross_page' ELSE 'intra_page' END AS hint_scope, CASE WHEN g IS NULL THEN -1 ELSE k END AS hint_order FROM w""",
    "guarded_pieces": f"""WITH {ITEMS_SQL}, i AS (SELECT item_id AS id, x0, y0, x1, y1, greatest(x0, 60.0) AS ix0, greatest(y0, 45.0) AS iy0, least(x1, 120.0) AS ix1, least(y1, 100.0) AS iy1 FROM items),
        h AS (SELECT *, greatest(0, ix1 - ix0) * greatest(0, iy1 - iy0) > 0.5 AS hit FROM i),
        p AS (SELECT id, unnest(CASE WHEN hit THEN [(ix0 - x0) * (y1 - y0), (x1 - ix1) * (y1 - y0), (ix1 - ix0) * (iy0 - y0), (ix1 - ix0) * (y1 - iy1)] ELSE [(x1 - x0) * (y1 - y0)] END)::DOUBLE AS a, hit FROM h)
        SELECT id, count(*) AS pieces, round(sum(a), 4) AS area FROM p WHERE a > 0.5 OR NOT hit GROUP BY 1""",
}
