"""Queries of run diagnostics over the ``events`` table: a user is a run, an event a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import diagnostics as D
from quire.plans.tables import q, table, wall_ms

MESSAGES = [
    ("HTTP 429 Too Many", None), ("read timeout", None), ("Connection reset", 502), ("request refused for safety", None), ("placeholder inventory differs", None), ("bad json", None), ("ok", 429), ("oops", 500), ("retry-after: 3", None), ("segment 3 missing", 404), (None, None),
]
LABELS = ["book: batch 3", "Classification page 2", "continuation-review x", "mixed-split", "garbled-reconstruct 1", "domain-infer", "x typst-repair", "typst-repair 2", "else", "", None]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events")
    ms = F.floor(F.col("value") * 300).cast("long")
    return e.select(
        "event_id", "user_id", F.col("event_type").alias("stage"), wall_ms(F.col("ts")).alias("ts_ms"), k.alias("k"), ms.alias("latency_ms"), (F.col("event_type") != "error").alias("success"),
        F.when(k % 7 == 0, "ReadTimeout").when(k % 7 == 1, "ValueError").otherwise("").alias("error_class"), F.when(k % 3 == 0, 500 + k % 5).cast("int").alias("status_code"), (k % 4 + 1).alias("attempt"),
        F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "kept_origin").when(F.col("event_type") == "signup", "partially_translated").otherwise("translated").alias("item_status"),
        F.when(k % 5 == 0, "translated").otherwise("").alias("diagnosed"), (k % 2 == 0).alias("has_text"),
        F.array(F.lit("block_level"), F.when(k % 6 == 0, "fast_path_keep_origin").when(k % 6 == 1, "").otherwise("single_item")).alias("route_path"), F.array(F.when(k % 11 == 0, "code").otherwise("none")).alias("reasons"),
    )


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).withColumn("final_status", D.settled_status(F.col("item_status"), F.col("diagnosed"), F.col("has_text")))
    return rows.withColumn("blocking", D.is_blocking(F.col("final_status"), F.col("route_path"), F.col("reasons")))


def status_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.status_summary(_settled(spark, sf_dir), "user_id")


def route_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.route_summary(_settled(spark, sf_dir))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.latency_summary(runs(spark, sf_dir), ["user_id"])


def latency_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.latency_outliers(runs(spark, sf_dir), ["user_id"]).select("user_id", "event_id", "latency_ms", "threshold_ms")


def slow_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.slow_requests(runs(spark, sf_dir), ["stage"]).select("stage", "event_id", "latency_ms", F.col("rank").cast("long").alias("rank"))


def peak_inflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs(spark, sf_dir).withColumn("start_ms", F.col("ts_ms")).withColumn("end_ms", F.col("ts_ms") + F.col("latency_ms") * 2000)
    return D.peak_inflight(rows, ["stage"])


def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.request_counts(runs(spark, sf_dir), "stage")


def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.stage_durations(runs(spark, sf_dir), "user_id", ["ts_ms", "event_id"]).withColumn("run", F.col("run").cast("long"))


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(k, m, c) for k, (m, c) in enumerate(MESSAGES)], "id long, message string, status_code int")
    seen = table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    both = own.unionByName(seen.select((F.col("event_id") + 1000).alias("id"), F.concat("event_type", F.lit(" http")).alias("message"), F.when(F.col("k") % 9 == 0, 429).alias("status_code")))
    return both.groupBy(D.error_taxonomy(F.col("message"), F.col("status_code")).alias("taxonomy")).agg(F.count(F.lit(1)).alias("n"))


def stage_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*D.OCR_STAGES, *D.TRANSLATE_STAGES, *D.RENDER_STAGES, "finished", "done", "other", None]
    stages = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id long, stage string")
    labels = spark.createDataFrame([(k, n) for k, n in enumerate(LABELS)], "id long, label string")
    s = stages.select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("id"), D.user_stage(F.col("stage")).alias("first"), D.progress_unit(F.col("stage"), F.when(F.col("id") % 2 == 0, "stage_progress"), F.lit(None)).alias("second"))
    return s.unionByName(labels.select(F.concat(F.lit("l"), F.col("id").cast("string")).alias("id"), D.request_stage(F.col("label")).alias("first"), F.lit("").alias("second")))


def debug_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _settled(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("item_id"), (F.col("k") % 10 + 1).alias("page_number"), "final_status", F.array(F.col("error_class")).alias("error_types"), "route_path", F.col("stage").alias("source_preview"), F.lit("").alias("translated_preview"),
    )
    return D.debug_search(rows, page=3, status=" Failed ", error="VALUEERROR", route="single", text="Err").select("item_id", "final_status")


def adaptive_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.adaptive_limit(runs(spark, sf_dir), ["user_id"], ["ts_ms", "event_id"], workers=32)


QUERIES = {
    f.__name__: f
    for f in (status_summary, route_summary, latency_percentiles, latency_outliers, slow_requests, peak_inflight, request_counts, stage_durations, error_taxonomy, stage_labels, debug_search, adaptive_limit)
}

_RUNS = """runs AS (
    SELECT event_id, user_id, event_type AS stage, epoch_us(ts) // 1000 AS ts_ms, k, floor(value * 300)::BIGINT AS latency_ms, event_type <> 'error' AS success,
           CASE k % 7 WHEN 0 THEN 'ReadTimeout' WHEN 1 THEN 'ValueError' ELSE '' END AS error_class, CASE WHEN k % 3 = 0 THEN 500 + k % 5 END AS status_code, k % 4 + 1 AS attempt,
           CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'kept_origin' WHEN 'signup' THEN 'partially_translated' ELSE 'translated' END AS item_status,
           k % 2 = 0 AS has_text, CASE k % 6 WHEN 0 THEN 'fast_path_keep_origin' WHEN 1 THEN '' ELSE 'single_item' END AS route2
    FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)
), settled AS (
    SELECT *, CASE WHEN NOT has_text AND item_status <> 'translated' THEN item_status WHEN k % 5 = 0 THEN 'translated' ELSE item_status END AS final_status FROM runs
), blocked AS (SELECT *, final_status IN ('kept_origin', 'failed') AND route2 <> 'fast_path_keep_origin' AND k % 11 <> 0 AS blocking FROM settled)"""
_count = lambda name, cond: f"count(*) FILTER ({cond}) AS {name}"
_timeout = "error_class = 'ReadTimeout'"
_low = "lower(coalesce(message, ''))"
_any = lambda *v: "(" + " OR ".join(f"contains({_low}, '{x}')" for x in v) + ")"
_names = [*D.OCR_STAGES, *D.TRANSLATE_STAGES, *D.RENDER_STAGES, "finished", "done", "other", None]
_lit = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
_list = lambda v: ", ".join(map(q, v))

SQL = {
    "status_summary": f"WITH {_RUNS} SELECT user_id, {', '.join(_count(s, f'final_status = {q(s)}') for s in D.STATUSES)}, {_count('unresolved', 'blocking')} FROM blocked GROUP BY 1",
    "route_summary": f"""WITH {_RUNS}, r AS (SELECT 'block_level' AS route, final_status FROM settled UNION ALL SELECT route2, final_status FROM settled WHERE route2 <> '')
        SELECT route, count(*) AS n, round(count(*) FILTER (final_status IN ('translated', 'partially_translated')) / count(*), 4) AS success_rate FROM r GROUP BY 1""",
    "latency_percentiles": f"""WITH {_RUNS} SELECT user_id, count(*) AS n, min(latency_ms) AS min, round_even(quantile_cont(latency_ms, 0.5), 0)::BIGINT AS p50, round_even(quantile_cont(latency_ms, 0.9), 0)::BIGINT AS p90,
        round_even(quantile_cont(latency_ms, 0.95), 0)::BIGINT AS p95, max(latency_ms) AS max, round(avg(latency_ms), 2) AS mean FROM runs GROUP BY 1""",
    "latency_outliers": f"""WITH {_RUNS}, t AS (SELECT user_id, greatest(30000, floor(avg(latency_ms) FILTER (latency_ms > 0) + 2 * stddev_pop(latency_ms) FILTER (latency_ms > 0)))::BIGINT AS threshold_ms FROM runs GROUP BY 1)
        SELECT user_id, event_id, latency_ms, threshold_ms FROM runs JOIN t USING (user_id) WHERE latency_ms > threshold_ms""",
    "slow_requests": f"WITH {_RUNS}, r AS (SELECT stage, event_id, latency_ms, row_number() OVER (PARTITION BY stage ORDER BY latency_ms DESC, event_id) AS rank FROM runs) SELECT * FROM r WHERE rank <= 12",
    "peak_inflight": f"""WITH {_RUNS}, p AS (SELECT stage, ts_ms AS t, 1 AS d FROM runs UNION ALL SELECT stage, ts_ms + latency_ms * 2000, -1 FROM runs)
        SELECT stage, max(s)::BIGINT AS peak FROM (SELECT stage, sum(d) OVER (PARTITION BY stage ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS s FROM p) GROUP BY 1""",
    "request_counts": f"""WITH {_RUNS} SELECT stage, count(*) AS total_http_attempts, {_count("succeeded_attempts", "success")}, {_count("failed_attempts", "NOT success")}, {_count("retried_attempts", "attempt > 1")},
        {_count("timeout_attempts", f"NOT success AND {_timeout}")}, {_count("http_error_attempts", f"NOT success AND NOT {_timeout} AND status_code IS NOT NULL")}, {_count("request_exception_attempts", f"NOT success AND NOT {_timeout} AND status_code IS NULL")} FROM runs GROUP BY 1""",
    "stage_durations": f"""WITH {_RUNS}, m AS (SELECT *, coalesce(lag(stage) OVER w <> stage, true) AS opens FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY ts_ms, event_id)),
        r AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts_ms, event_id) AS run FROM m), s AS (SELECT user_id, run, stage, min(ts_ms) AS enter_ms FROM r GROUP BY ALL)
        SELECT user_id, run::BIGINT AS run, stage, enter_ms, lead(enter_ms) OVER w AS exit_ms, lead(enter_ms) OVER w - enter_ms AS duration_ms FROM s WINDOW w AS (PARTITION BY user_id ORDER BY run)""",
    "error_taxonomy": f"""WITH m AS (SELECT * FROM (VALUES {', '.join(f'({_lit(a)}, {_lit(b)})' for a, b in MESSAGES)}) v(message, status_code)
            UNION ALL SELECT event_type || ' http', CASE WHEN json_extract_string(props, '$.k')::INT % 9 = 0 THEN 429 END FROM events)
        SELECT CASE WHEN status_code = 429 THEN 'rate_limit' WHEN status_code >= 500 THEN 'transport' WHEN {_any("429", "rate limit", "retry-after")} THEN 'rate_limit' WHEN {_any("timeout", "connection", "http", "transport")} THEN 'transport'
               WHEN {_any("refusal", "refused", "safety")} THEN 'refusal' WHEN {_any("placeholder", "segment", "validation", "inventory")} THEN 'validation' ELSE 'protocol' END AS taxonomy, count(*) AS n FROM m GROUP BY 1""",
    "stage_labels": f"""WITH s AS (SELECT * FROM (VALUES {', '.join(f'({k}, {_lit(n)})' for k, n in enumerate(_names))}) v(id, stage)), l AS (SELECT id, lower(trim(coalesce(label, ''))) AS t FROM (VALUES {', '.join(f'({k}, {_lit(n)})' for k, n in enumerate(LABELS))}) v(id, label))
        SELECT 's' || id AS id, CASE WHEN stage IN ({_list(D.OCR_STAGES)}) THEN 'ocr' WHEN stage IN ({_list(D.TRANSLATE_STAGES)}) THEN 'translate' WHEN stage IN ({_list(D.RENDER_STAGES)}) THEN 'render' WHEN stage IN ('finished', 'done') THEN 'done' ELSE '' END AS first,
               CASE WHEN stage IN ('translating', 'translation_batches') THEN 'batch' WHEN stage IN ({_list(D.PAGE_STAGES)}) THEN 'page' WHEN stage IN ({_list(D.STEP_STAGES)}) OR id % 2 = 0 THEN 'step' ELSE 'none' END AS second FROM s
        UNION ALL SELECT 'l' || id, CASE WHEN t = '' THEN 'unspecified' {' '.join(f"WHEN starts_with(t, {q(p)}) THEN {q(n)}" for p, n in D.REQUEST_STAGES)} WHEN contains(t, ' typst-repair') OR starts_with(t, 'typst-repair') THEN 'typst_repair' ELSE 'other_llm' END, '' FROM l""",
    "debug_search": f"WITH {_RUNS} SELECT event_id::VARCHAR AS item_id, final_status FROM settled WHERE k % 10 + 1 = 3 AND final_status = 'failed' AND error_class = 'ValueError' AND (contains('block_level', 'single') OR contains(route2, 'single')) AND (contains(event_id::VARCHAR, 'err') OR contains(stage, 'err'))",
}
