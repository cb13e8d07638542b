"""Queries of the job store: customers and orders stand for jobs and artifacts, events for the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import store as S
from quire.plans.tables import table, wall_ms

STAGES = {"signup": "queued", "click": "ocr_processing", "view": "translating", "purchase": "rendering", "error": "failed"}


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("upload_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("workflow"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"), F.col("o_totalprice").alias("size"))


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max("l_returnflag").alias("provider"), F.count(F.lit(1)).alias("n_entries"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_columns(table(spark, sf_dir, "events"))


def _log_columns(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    stage = F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv])[F.col("event_type")]
    return e.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), wall_ms(F.col("ts")).alias("ts"), F.col("event_type").alias("event"), F.when(k % 5 == 0, "artifact_published").otherwise("stage_changed").alias("event_type"),
        F.when(k % 17 == 0, "").otherwise(stage).alias("stage"), F.concat(F.lit("d"), k.cast("string")).alias("stage_detail"), F.when(k % 3 == 0, k).alias("progress_current"), F.when(k % 3 == 0, 100).alias("progress_total"),
    )


def _newest() -> list[F.Column]:
    return [F.desc("updated_at"), F.col("job_id")]


def job_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.list_jobs(_jobs(spark, sf_dir), _artifacts(spark, sf_dir), "job_id", _newest(), limit=20, offset=40, where=F.col("status") == "F")


def job_list_provider_after_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.list_jobs(_jobs(spark, sf_dir), _artifacts(spark, sf_dir), "job_id", _newest(), limit=100, provider=("provider", "r"))


def job_detail_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("upload_id"), F.col("c_name").alias("upload_name"))
    return _jobs(spark, sf_dir).join(_artifacts(spark, sf_dir), "job_id", "left").join(uploads, "upload_id", "left").select("job_id", "status", "upload_name", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), "provider")


def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jobs(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def _changes(jobs: DataFrame) -> DataFrame:
    touched = jobs.where("job_id % 10 = 3").withColumns({"status": F.lit("X"), "updated_at": F.lit("2030-01-01")})
    again = jobs.where("job_id % 20 = 3").withColumns({"status": F.lit("Y"), "updated_at": F.lit("2030-01-02")})
    fresh = jobs.where("job_id % 50 = 0").withColumns({"job_id": -F.col("job_id") - 1, "updated_at": F.lit("2030-01-03")})
    return touched.unionByName(again).unionByName(fresh)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    return S.upsert(jobs, _changes(jobs), ["job_id"], "updated_at")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, arts = _jobs(spark, sf_dir), _artifacts(spark, sf_dir)
    kept, children = S.delete_cascade(jobs, {"artifacts": arts}, jobs.where("status = 'P'"), "job_id")
    return kept.groupBy(F.lit("jobs").alias("name")).agg(F.count(F.lit(1)).alias("n")).unionByName(children["artifacts"].groupBy(F.lit("artifacts").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("long").alias("entry"), "l_quantity")
    fresh = entries.where("job_id % 7 = 0 AND entry = 1").withColumn("l_quantity", F.lit(-1.0))
    return S.replace_children(entries, fresh, ["job_id"])


def event_append_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _log(spark, sf_dir).select("job_id", "seq", "ts", "event")
    log, fresh = e.where("seq % 3 <> 0 AND job_id % 4 <> 0"), e.where("seq % 3 = 0 OR job_id % 4 = 0").withColumnRenamed("seq", "event_id")
    return S.append_events(log, fresh, "job_id", ["ts", "event_id"]).select("job_id", "seq", "ts", "event")


def combined_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _log(spark, sf_dir).select("job_id", "seq", "ts", "event")
    logged = e.where("seq % 2 = 1").withColumn("line", F.col("seq") * 2).drop("seq")
    return S.combined_events(e.where("seq % 2 = 0"), logged, "job_id")


def live_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.live_stage(_log(spark, sf_dir), "job_id")


def derived_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.derive_changes(_log(spark, sf_dir), "job_id", ["ts", "seq"], ["stage", "progress_current"])


def paths_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return S.rewrite_paths(pages, "url", "http://%.com/%", "http://", "file:///").withColumn("url", S.redact(F.col("url"), ["example", "ref", "", "ref=x"]))


QUERIES = {
    f.__name__: f
    for f in (
        job_list_page, job_list_provider_after_limit, job_detail_join, job_status_counts, upsert_latest, cascade_delete, replace_children, event_append_seq, combined_events, live_stage, derived_events, paths_rewritten,
    )
}

_JOBS = """jobs AS (SELECT o_orderkey AS job_id, o_custkey AS upload_id, o_orderstatus AS status, o_orderpriority AS workflow, strftime(o_orderdate, '%Y-%m-%d') AS updated_at, o_totalprice AS size FROM orders),
    arts AS (SELECT l_orderkey AS job_id, max(l_returnflag) AS provider, count(*) AS n_entries FROM lineitem GROUP BY 1)"""
_LOG = f"""log AS (SELECT user_id AS job_id, event_id AS seq, epoch_us(ts) // 1000 AS ts, event_type AS event, CASE WHEN k % 5 = 0 THEN 'artifact_published' ELSE 'stage_changed' END AS event_type,
    CASE WHEN k % 17 = 0 THEN '' ELSE CASE event_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in STAGES.items())} END END AS stage, 'd' || k AS stage_detail, CASE WHEN k % 3 = 0 THEN k END AS progress_current, CASE WHEN k % 3 = 0 THEN 100 END AS progress_total
    FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events))"""

SQL = {
    "job_list_page": f"WITH {_JOBS}, p AS (SELECT * FROM jobs WHERE status = 'F' ORDER BY updated_at DESC, job_id LIMIT 20 OFFSET 40) SELECT p.*, provider, n_entries FROM p LEFT JOIN arts USING (job_id)",
    "job_list_provider_after_limit": f"WITH {_JOBS}, p AS (SELECT * FROM jobs ORDER BY updated_at DESC, job_id LIMIT 100) SELECT p.*, provider, n_entries FROM p LEFT JOIN arts USING (job_id) WHERE lower(provider) = 'r'",
    "job_detail_join": f"WITH {_JOBS} SELECT job_id, status, c_name AS upload_name, coalesce(n_entries, 0) AS n_entries, provider FROM jobs LEFT JOIN arts USING (job_id) LEFT JOIN customer ON c_custkey = upload_id",
    "job_status_counts": f"WITH {_JOBS} SELECT status, count(*) AS n FROM jobs GROUP BY 1",
    "upsert_latest": f"""WITH {_JOBS} SELECT job_id, upload_id, CASE WHEN job_id % 20 = 3 THEN 'Y' WHEN job_id % 10 = 3 THEN 'X' ELSE status END AS status, workflow,
        CASE WHEN job_id % 20 = 3 THEN '2030-01-02' WHEN job_id % 10 = 3 THEN '2030-01-01' ELSE updated_at END AS updated_at, size FROM jobs
        UNION ALL SELECT -job_id - 1, upload_id, status, workflow, '2030-01-03', size FROM jobs WHERE job_id % 50 = 0""",
    "cascade_delete": f"WITH {_JOBS} SELECT 'jobs' AS name, count(*) AS n FROM jobs WHERE status <> 'P' UNION ALL SELECT 'artifacts', count(*) FROM arts WHERE job_id NOT IN (SELECT job_id FROM jobs WHERE status = 'P')",
    "replace_children": """WITH e AS (SELECT l_orderkey AS job_id, l_linenumber::BIGINT AS entry, l_quantity FROM lineitem), f AS (SELECT job_id, entry, -1.0::DOUBLE AS l_quantity FROM e WHERE job_id % 7 = 0 AND entry = 1)
        SELECT * FROM e WHERE job_id NOT IN (SELECT job_id FROM f) UNION ALL SELECT * FROM f""",
    "event_append_seq": f"""WITH {_LOG}, o AS (SELECT * FROM log WHERE seq % 3 <> 0 AND job_id % 4 <> 0), t AS (SELECT job_id, max(seq) AS top FROM o GROUP BY 1)
        SELECT job_id, seq, ts, event FROM o UNION ALL SELECT job_id, coalesce(top, 0) + row_number() OVER (PARTITION BY job_id ORDER BY ts, seq), ts, event FROM log LEFT JOIN t USING (job_id) WHERE seq % 3 = 0 OR job_id % 4 = 0""",
    "combined_events": f"""WITH {_LOG}, t AS (SELECT job_id, max(seq) AS top FROM log WHERE seq % 2 = 0 GROUP BY 1),
        b AS (SELECT job_id, seq, ts, event FROM log WHERE seq % 2 = 0 UNION ALL SELECT job_id, coalesce(top, 0) + seq * 2 + 1, ts, event FROM log LEFT JOIN t USING (job_id) WHERE seq % 2 = 1)
        SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq, event) AS seq, ts, event FROM b""",
    "live_stage": f"""WITH {_LOG}, r AS (SELECT *, CASE WHEN stage = 'rendering' THEN 3 WHEN stage = 'translating' THEN 2 WHEN stage = 'ocr_processing' THEN 1 ELSE 0 END AS rank FROM log WHERE event_type <> 'artifact_published' AND stage <> ''),
        c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY rank DESC, ts DESC, seq DESC) = 1), p AS (SELECT * FROM log WHERE progress_current IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1)
        SELECT c.job_id, CASE WHEN c.progress_current IS NULL AND c.stage = 'failed' AND coalesce(p.stage, '') <> '' THEN p.stage ELSE c.stage END AS stage,
               CASE WHEN c.progress_current IS NULL AND c.stage = 'failed' AND coalesce(p.stage, '') <> '' THEN p.stage_detail ELSE c.stage_detail END AS stage_detail,
               coalesce(c.progress_current, p.progress_current) AS progress_current, coalesce(c.progress_total, p.progress_total) AS progress_total FROM c LEFT JOIN p USING (job_id)""",
    "derived_events": f"""WITH {_LOG}, l AS (SELECT job_id, ts, seq, stage, progress_current, row_number() OVER w AS n, lag(stage) OVER w AS s0, lag(progress_current) OVER w AS p0 FROM log WINDOW w AS (PARTITION BY job_id ORDER BY ts, seq))
        SELECT job_id, ts, seq, 'job_created' AS event, NULL AS field, NULL AS old, NULL AS new FROM l WHERE n = 1
        UNION ALL SELECT job_id, ts, seq, 'stage_changed', 'stage', s0, stage FROM l WHERE n > 1 AND stage IS DISTINCT FROM s0
        UNION ALL SELECT job_id, ts, seq, 'progress_current_changed', 'progress_current', p0::VARCHAR, progress_current::VARCHAR FROM l WHERE n > 1 AND progress_current IS DISTINCT FROM p0""",
    "paths_rewritten": """SELECT page_id, replace(replace(replace(CASE WHEN url LIKE 'http://%.com/%' THEN replace(url, 'http://', 'file:///') ELSE url END, 'example', '[REDACTED]'), 'ref=x', '[REDACTED]'), 'ref', '[REDACTED]') AS url FROM pages""",
}
