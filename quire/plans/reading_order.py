"""Queries of the reading-order operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import reading_order as R
from quire.plans.tables import ITEMS_SQL, items, q, s_has, s_in, s_last_word, s_norm, table
from quire.plans.text_rules import s_ends, s_starts


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    eligible = (F.col("layout_role") != "title") & T.has_balanced_math(F.col("text")) & (T.normalize_text(F.col("text")) != "")
    # every 37th line stands for one that the provider has joined
    return rows.select("doc_id", "item_id", "page_idx", F.col("line_no").alias("block_idx"), "text", eligible.alias("eligible"), (F.col("line_no") % 37 == 36).alias("provider_joined"), "x0", "y0", "x1", "y1", F.lit(True).alias("is_textual"), "layout_role")


def continuation_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.continuation(_blocks(spark, sf_dir)).drop("join_score", "break_score", "pair", "following_id")


def continuation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = R.continuation(_blocks(spark, sf_dir)).where("following_id IS NOT NULL AND pair IS NOT NULL")
    return decided.select("doc_id", "item_id", "following_id", "join_score", "break_score", "pair", R.review_verdict(F.col("join_score"), F.col("break_score")).alias("verdict"))


def continuation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summarize_decisions(R.continuation(_blocks(spark, sf_dir)), "doc_id")


def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.context_windows(_blocks(spark, sf_dir))


def anchor_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("text").contains("@"), "code").when(F.col("text").rlike(r"\d{4}"), "table").otherwise("text")
    return R.previous_anchor(_blocks(spark, sf_dir).withColumn("kind", kind)).select("doc_id", "item_id", "kind", "anchor_id", "anchor_kind")


def index_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.runs(_blocks(spark, sf_dir), F.length("text") < 40, 2).select("doc_id", "item_id", F.col("run_id").cast("long").alias("run_id"), F.col("run_size").cast("long").alias("run_size"))


def turn_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    size = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    return turns.select("conv_id", "turn", R.boundary_role(rank, size).alias("boundary_role"))


def provider_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _blocks(spark, sf_dir).withColumns({"source": F.lit("provider"), "group_id": F.concat(F.lit("g"), F.floor((F.col("block_idx") + 2) / 5).cast("string")), "reading_order": F.when(F.col("block_idx") % 11 == 10, -1).otherwise(F.col("block_idx"))})
    first = F.floor((F.floor((F.col("block_idx") + 2) / 5) * 5 - 2) / 40)
    last = F.floor((F.floor((F.col("block_idx") + 2) / 5) * 5 + 2) / 40)
    return R.provider_groups(rows.withColumn("scope", F.when(first == last, "intra_page").otherwise("cross_page")))


QUERIES = {f.__name__: f for f in (continuation_chains, continuation_pairs, continuation_summary, context_windows, anchor_carry, index_runs, turn_roles, provider_groups)}

_BLOCKS = f"""{ITEMS_SQL}, blocks AS (
    SELECT doc_id, item_id, page_idx, line_no AS block_idx, text, {s_norm("text")} AS t, line_no % 37 = 36 AS provider_joined, x0, y0, x1, y1,
           layout_role <> 'title' AND (len(regexp_extract_all(text, '\\$')) - len(regexp_extract_all(text, '\\\\\\$'))) % 2 = 0 AND {s_norm("text")} <> '' AS eligible
    FROM items)"""

_SCORED = f"""{_BLOCKS}, nexts AS (
    SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY doc_id) AS size,
           first_value(CASE WHEN eligible AND NOT provider_joined THEN item_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_idx, block_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nid
    FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx, block_idx)
), paired AS (
    SELECT p.*, n.item_id AS next_id, n.t AS nt, n.page_idx AS npage, n.pos AS npos, p.page_idx = n.page_idx AS same,
           n.x0 > p.x1 + 8 AS right_of, n.x0 > p.x1 + 8 AND n.x0 - p.x1 <= 96 AS crossed, abs(n.x0 - p.x0) <= 28 AND n.y0 - p.y1 <= 40 AS near
    FROM nexts p LEFT JOIN nexts n ON n.item_id = p.nid AND n.doc_id = p.doc_id AND n.page_idx - p.page_idx <= 1
), signals AS (
    SELECT *, {s_starts("nt")} AS starts, {s_has("t", "[.!?:;]$")} AS stops, CASE WHEN right_of THEN crossed ELSE near END AS fits FROM paired
), scored AS (
    SELECT *, CASE WHEN next_id IS NULL THEN NULL WHEN NOT eligible OR (same AND (NOT fits OR (NOT crossed AND NOT ends_with(t, '-')))) THEN -999
                   ELSE starts::INT * 3 + (stops AND starts)::INT * 3 + ({s_ends("t")})::INT * 3 + ends_with(t, '-')::INT * 4 + ends_with(t, ',')::INT
                        + ({s_in(s_last_word("t"), T.SUSPICIOUS_ENDS)})::INT + (NOT same AND NOT stops)::INT * 2 + (same AND crossed)::INT * 2 END AS join_score,
           CASE WHEN next_id IS NOT NULL THEN greatest(0, CASE WHEN {s_has("t", "[.!?]$")} THEN 4 WHEN stops THEN 2 ELSE 0 END - starts::INT * 3 + ({s_has("nt", T.HEADING_START)})::INT * 3
                        + ({s_has("nt", "^[A-Z]")} AND NOT starts)::INT + (same AND NOT fits)::INT * 2) END AS break_score
    FROM signals
), decided AS (
    SELECT *, CASE WHEN next_id IS NULL OR provider_joined THEN NULL WHEN join_score < 0 THEN 'break' WHEN join_score >= 4 AND join_score >= break_score + 2 THEN 'join'
                   WHEN break_score >= 4 AND break_score >= join_score + 1 THEN 'break' ELSE 'candidate' END AS pair FROM scored)"""

#: Chains by recursion over the joining edges, not by windows as in the operator.
_CHAINS = f"""WITH RECURSIVE {_SCORED}, edges AS (SELECT doc_id, item_id, next_id, pos, npos, page_idx FROM decided WHERE pair = 'join'),
heads AS (SELECT e.* FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.next_id = e.item_id)),
walk AS (
    SELECT doc_id, item_id AS head, page_idx AS head_page, pos AS head_pos, item_id AS member, pos AS member_pos FROM heads
    UNION ALL SELECT w.doc_id, w.head, w.head_page, w.head_pos, e.next_id, e.npos FROM walk w JOIN edges e ON e.item_id = w.member
), spans AS (SELECT doc_id, head, head_page, head_pos, max(member_pos) AS tail_pos FROM walk GROUP BY ALL),
stops AS (
    SELECT d.doc_id, min(d.pos) AS stop FROM decided d WHERE NOT d.provider_joined AND d.next_id IS NULL AND d.pos < d.size
      AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = d.doc_id AND d.pos BETWEEN s.head_pos AND s.tail_pos) GROUP BY 1
), kept AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY head_pos) AS k FROM spans s LEFT JOIN stops t USING (doc_id) WHERE t.stop IS NULL OR s.head_pos < t.stop
), named AS (
    SELECT w.member AS item_id, 'cg-' || lpad((k.head_page + 1)::VARCHAR, 3, '0') || '-' || lpad(k.k::VARCHAR, 3, '0') AS g FROM walk w JOIN kept k USING (doc_id, head)
), marks AS (
    SELECT d.item_id, d.next_id FROM decided d LEFT JOIN stops t USING (doc_id) WHERE d.pair = 'candidate' AND (t.stop IS NULL OR d.pos < t.stop)
      AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = d.doc_id AND d.pos BETWEEN s.head_pos AND s.tail_pos)
), result AS (
    SELECT d.doc_id, d.item_id, d.page_idx, d.block_idx, coalesce(n.g, '') AS continuation_group,
           CASE WHEN d.provider_joined THEN 'provider_joined' WHEN n.g IS NOT NULL THEN 'joined' WHEN m.next_id IS NOT NULL OR b.item_id IS NOT NULL THEN 'candidate_break' ELSE '' END AS continuation_decision,
           b.item_id AS candidate_prev_id, m.next_id AS candidate_next_id
    FROM decided d LEFT JOIN named n ON n.item_id = d.item_id LEFT JOIN marks m ON m.item_id = d.item_id LEFT JOIN marks b ON b.next_id = d.item_id)"""

_cut = lambda c: f"CASE WHEN length({c}) <= 360 THEN {c} ELSE rtrim(left({c}, 359)) || '...' END"

SQL = {
    "continuation_chains": f"{_CHAINS} SELECT * FROM result",
    "continuation_pairs": f"""WITH {_SCORED} SELECT doc_id, item_id, next_id AS following_id, join_score, break_score, pair,
        CASE WHEN join_score >= 7 AND join_score >= break_score + 4 THEN 'auto_join' WHEN break_score >= 6 AND break_score >= join_score + 3 THEN 'drop' ELSE 'review' END AS verdict
        FROM decided WHERE pair IS NOT NULL""",
    "continuation_summary": f"""{_CHAINS} SELECT doc_id, count(*) FILTER (continuation_decision IN ('provider_joined', 'joined', 'review_joined')) AS joined_items, count(*) FILTER (continuation_decision = 'provider_joined') AS provider_joined_items,
        count(*) FILTER (continuation_decision = 'joined') AS rule_joined_items, count(*) FILTER (continuation_decision = 'review_joined') AS review_joined_items, count(*) FILTER (continuation_decision = 'candidate_break') AS candidate_break_items
        FROM result GROUP BY 1""",
    "context_windows": f"""WITH {_BLOCKS}, c AS (
            SELECT doc_id, item_id, lag(t, 2) OVER w AS b2, lag(t) OVER w AS b1, lead(t) OVER w AS a1, lead(t, 2) OVER w AS a2 FROM blocks WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx, block_idx)
        ), j AS (SELECT doc_id, item_id, concat_ws(' / ', b2, b1) AS b, concat_ws(' / ', a1, a2) AS a FROM c)
        SELECT doc_id, item_id, {_cut("b")} AS before, {_cut("a")} AS after FROM j""",
    "anchor_carry": f"""WITH {_BLOCKS}, k AS (SELECT *, CASE WHEN contains(text, '@') THEN 'code' WHEN {s_has("text", r"\d{4}")} THEN 'table' ELSE 'text' END AS kind FROM blocks)
        SELECT doc_id, item_id, kind, last_value(CASE WHEN kind <> 'text' THEN item_id END IGNORE NULLS) OVER w AS anchor_id, last_value(CASE WHEN kind <> 'text' THEN kind END IGNORE NULLS) OVER w AS anchor_kind
        FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx, block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "index_runs": f"""WITH {_BLOCKS}, f AS (SELECT doc_id, item_id, page_idx, block_idx, length(text) < 40 AS f FROM blocks),
        g AS (SELECT *, f AND NOT coalesce(lag(f) OVER (PARTITION BY doc_id, page_idx ORDER BY block_idx), false) AS opens FROM f),
        r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id, page_idx ORDER BY block_idx) AS r FROM g),
        n AS (SELECT *, count(*) FILTER (f) OVER (PARTITION BY doc_id, page_idx, r) AS n FROM r)
        SELECT doc_id, item_id, CASE WHEN f AND n >= 2 THEN r END::BIGINT AS run_id, CASE WHEN f AND n >= 2 THEN n END::BIGINT AS run_size FROM n""",
    "turn_roles": """SELECT conv_id, turn, CASE WHEN n = 1 THEN 'single' WHEN k = 1 THEN 'head' WHEN k = n THEN 'tail' ELSE 'middle' END AS boundary_role
        FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""",
    "provider_groups": f"""WITH {_BLOCKS}, g AS (
            SELECT doc_id, page_idx, block_idx, (block_idx + 2) // 5 AS k, CASE WHEN block_idx % 11 = 10 THEN -1 ELSE block_idx END AS o FROM blocks WHERE eligible
        ), s AS (SELECT *, page_idx - lag(page_idx) OVER (PARTITION BY doc_id, k ORDER BY o, page_idx, block_idx) AS step, CASE WHEN floor((k * 5 - 2) / 40.0) = floor((k * 5 + 2) / 40.0) THEN 'intra_page' ELSE 'cross_page' END AS scope FROM g)
        SELECT doc_id, 'g' || k AS group_id, scope, count(*) AS members,
               count(*) >= 2 AND count(DISTINCT o) = count(*) AND min(o) >= 0 AND CASE WHEN scope = 'cross_page'
                    THEN count(DISTINCT page_idx) = 2 AND max(page_idx) - min(page_idx) = 1 AND count(*) FILTER (step = 1) = 1 AND count(*) FILTER (step NOT IN (0, 1)) = 0 ELSE count(DISTINCT page_idx) = 1 END AS usable
        FROM s GROUP BY doc_id, k, scope""",
}
