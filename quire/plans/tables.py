"""Maps the plain test tables to the library's model: lines, items with boxes, runs, jobs; and says the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import geometry as G

#: Hand-made texts that make every rule fire at least once; they join the documents' lines as document -1.
FIXTURE = [
    "References", "References and Notes", "Works  Cited", "Reference list of nothing",
    "[12] Smith, J., Doe, A. Journal of Things, vol. 3, 1999, pp. 12-19.", "Miller, A. B., Stone, C. (2004) 33-41",
    "see 10.1000/182, 2011", "doi missing here", "volume of water, 1999 and more", "and continued from pp. 4", "https://example.org/a/b?c=1", "(www.example.com/path)", "<first.last@example.org>,",
    "mail first.last@example.org now", "Copyright 2020 Example Press. All rights reserved.", "This trademark and copyright text accepts no liability for anything at all.",
    "X1(I,J) = Y2(I,J) + Z3(I,J) * 2.0D+3 ; END_DO", "DO10I = 1,20 ; A(I) = B(I)/C(I) + D(I)", "MAIN_PROG FOO_BAR BAZ_QUX QUUX_1",
    "The results of the method show that energy is conserved in all of the models used", "short", "a.b-c/d", "§§§¶¶¶ŦŦ‰‰‰ ab", "broken � text", "这是一个关于模型能量计算的中文段落文本测试样例 abc", "中文 mixed with mostly English words in the same line here",
    "cost is $5 and $6", "only one $ sign here", r"escaped \$ and $x$", '{"translated_text": "x"}', "please provide the source text to translate", "请提供待翻译的原文。", "Please send it",
    "Ada Lovelace, Alan Turing, Grace Hopper and Edsger Dijkstra", "one, two, three", "we stop here because of the", "However it may end with a hyphen-", "It is what it is.", "1.2 Introduction to things", "- bullet item", "GFN2-xTB and Hartree-Fock with DFTB3 and SCF plus HTTP/2", "SCF", "<f1-abc/> then [[FORMULA_2]] and @@P3@@ end", "", "   ",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FIXTURE_SQL = "(VALUES " + ", ".join(f"({k}, {_quoted(t)})" for k, t in enumerate(FIXTURE)) + ") f(line_no, text)"

LINES_SQL = f"""lines AS (
    SELECT doc_id, line_no::BIGINT AS line_no, text FROM (
        SELECT doc_id, unnest(range(len(parts))) AS line_no, unnest(parts) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
    UNION ALL SELECT -1, line_no, text FROM {FIXTURE_SQL})"""

ITEMS_SQL = f"""{LINES_SQL}, items AS (
    SELECT *, x0 + least(250.0, 40.0 + 2.0 * length(text)) AS x1, y0 + 12.0 * (1 + least(2, length(text) // 120)) AS y1 FROM (
        SELECT doc_id, line_no, text, line_no // 40 AS page_idx, doc_id * 1000000 + line_no AS item_id,
               CASE WHEN line_no = 0 AND length(text) < 60 THEN 'title' ELSE 'paragraph' END AS layout_role,
               (50.0 + 270.0 * ((line_no % 40) // 20))::DOUBLE AS x0, (40.0 + 36.0 * (line_no % 20))::DOUBLE AS y0
        FROM lines))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of less than this for each core, in fewer splits than cores, is dealt out anew.
SMALL = 8 << 20


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores.  Only for small tables in few splits (a file of one row group can't be split); others stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return rows.repartition(cores) if int(str(size)) < SMALL * cores and rows.rdd.getNumPartitions() < cores else rows


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text): the lines of all documents and of the fixture."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    own = spark.createDataFrame([(-1, k, t) for k, t in enumerate(FIXTURE)], "doc_id long, line_no int, text string")
    return docs.unionByName(own).withColumn("line_no", F.col("line_no").cast("long"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks: 40 to a page in two columns, with made-up boxes."""
    n, size = F.col("line_no"), F.length("text")
    col, row = F.floor(n % 40 / 20), n % 20
    out = lines(spark, sf_dir).select(
        "doc_id", "line_no", "text", F.floor(n / 40).alias("page_idx"), (F.col("doc_id") * 1000000 + n).alias("item_id"),
        F.when((n == 0) & (size < 60), "title").otherwise("paragraph").alias("layout_role"),
        (col * 270.0 + 50.0).alias("x0"), (row * 36.0 + 40.0).alias("y0"),
    )
    return out.withColumn("x1", F.col("x0") + F.least(F.lit(250.0), F.length("text") * 2.0 + 40.0)).withColumn("y1", F.col("y0") + (F.least(F.lit(2), F.floor(F.length("text") / 120)) + 1) * 12.0)


def box(prefix: str = "") -> F.Column:
    return G.rect(*[F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")])


def wall_ms(ts: F.Column) -> F.Column:
    """Milliseconds of a time without zone, whatever the session's zone."""
    return F.unix_millis(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


# --- SQL snippets --------------------------------------------------------------


def q(pattern: str) -> str:
    return _quoted(pattern)


def s_norm(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


def s_words(c: str) -> str:
    """With every letter and digit outside ASCII as an underscore: DuckDB's word edge knows no others."""
    return rf"regexp_replace({c}, '[^\x00-\x7F\pP\pS\pZ\pM\pC]', '_', 'g')"


def s_has(c: str, pattern: str) -> str:
    if r"\b" in pattern:
        c = s_words(c)
    return f"regexp_matches({c}, {q(pattern)})"


def s_count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


WORD = r"[A-Za-z]+(?:[-'][A-Za-z]+)?"


def s_last_word(c: str) -> str:
    return f"coalesce(lower(regexp_extract_all({c}, {q(WORD)})[-1]), '')"


def s_natural(c: str) -> str:
    return f"len(list_filter(regexp_extract_all({c}, {q(WORD)}), lambda w: length(w) >= 3))"


def s_in(c: str, values) -> str:
    return f"{c} IN ({', '.join(map(q, values))})"


def s_any_contains(c: str, values) -> str:
    return "(" + " OR ".join(f"contains({c}, {q(v)})" for v in values) + ")"
