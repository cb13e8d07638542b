"""Streaming queries, drained over the ``events`` table and compared with batch SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans import records
from quire.plans.store import SQL as STORE_SQL
from quire.plans.store import _log_columns
from quire.plans.tables import table
from quire.streaming import live
from quire.streaming.flush import PageFlush


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or tempfile.mkdtemp(prefix="quire-stream-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.source(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)


def stream_live_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live.live_stages(_log_columns(_events(spark, sf_dir)), "job_id", _folder(spark))


def stream_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.windowed_counts(rows, "ts", "event_type", "6 hours", "60 days", _folder(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).select((F.col("user_id") % 10).cast("string").alias("job"), F.col("event_type").alias("term"), (F.col("event_id") % 5).cast("string").alias("source"), F.col("event_id").alias("at"))
    return live.term_memory(rows, _folder(spark))


def stream_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results arrive in four files, a batch each; pages of 40 lines are flushed every third batch."""
    folder = _folder(spark)
    rows = records._records(spark, sf_dir).withColumn("page_idx", F.floor(F.col("pos") / 40))
    rows.write.parquet(f"{folder}/records")
    records._canonical(spark, sf_dir).repartition(4, "seq").write.parquet(f"{folder}/arriving")
    arriving = spark.read.parquet(f"{folder}/arriving")
    flush = PageFlush(spark.read.parquet(f"{folder}/records"), f"{folder}/flush", interval=3)
    out = flush.run(spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/arriving"))
    return out.select("doc_id", "item_id", "unit_id", "final_status", "unit_translated_text")


QUERIES = {f.__name__: f for f in (stream_live_stage, stream_event_windows, stream_memory, stream_flush)}
_APPLIED = records.SQL["results_applied"]
SQL = {
    "stream_flush": _APPLIED[: _APPLIED.rindex("SELECT doc_id, item_id, CASE WHEN keeps")] + """, flagged AS (
            SELECT *, max(CASE WHEN ik <> 'none' OR gk <> 'none' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, line_no // 40) AS touched FROM done)
        SELECT doc_id, item_id, CASE WHEN keeps THEN held ELSE unit END AS unit_id,
           CASE WHEN ik = 'failed' THEN 'failed' WHEN ik = 'kept' THEN 'kept_origin' WHEN ik = 'text' THEN is_ WHEN gk = 'failed' THEN 'failed' WHEN gk = 'kept' THEN 'kept_origin' WHEN gk = 'text' AND should THEN gs ELSE 'pending' END AS final_status,
           whole AS unit_translated_text FROM flagged WHERE touched = 1""",
    "stream_live_stage": STORE_SQL["live_stage"],
    "stream_event_windows": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_memory": """WITH o AS (SELECT (user_id % 10)::VARCHAR AS job, event_type AS term, (event_id % 5)::VARCHAR AS source, event_id AS at_ FROM events), f AS (SELECT job, term, source, min(at_) AS f FROM o GROUP BY ALL)
        SELECT job, term, count(*) AS hits, any_value(s) AS sources FROM o JOIN (SELECT job, term, string_agg(source, ',' ORDER BY f) AS s FROM f GROUP BY ALL) USING (job, term) GROUP BY ALL""",
}
