"""Event logs (JSON lines), glossaries (CSV) and page sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = (
    "job_id string, ts string, level string, user_stage string, stage string, substage string, stage_detail string, provider string, provider_stage string, event string, event_type string, message string, "
    "progress_current long, progress_total long, progress_unit string, retry_count long, elapsed_ms long, payload map<string, string>"
)
# --- fixed values ------------------------------------------------------------
HEADERS = {
    "source": ("source", "src", "term", "original", "原词", "原文", "术语"), "target": ("target", "dst", "translation", "translated", "译文", "翻译", "目标译文"), "note": ("note", "notes", "comment", "comments", "备注", "说明"),
    "level": ("level", "glossary_level", "mode", "action", "类型", "模式", "动作"), "match_mode": ("match", "match_mode", "match-mode", "匹配", "匹配模式"), "context": ("context", "上下文", "语境"),
}
PRESERVE = ("preserve", "keep", "keep_origin", "keep-original", "do_not_translate", "do-not-translate", "not_translate", "not-translate", "no_translate", "no-translate", "不翻译", "保留", "原文保留")
CANONICAL = ("canonical", "fixed", "fixed_translation", "fixed-translation", "required", "强制翻译", "固定翻译", "专业译法", "标准译法")
CASELESS = ("case_insensitive", "case-insensitive", "ci", "ignore_case", "ignore-case", "大小写不敏感", "忽略大小写")
# -----------------------------------------------------------------------------


def parse_events(lines: DataFrame, job: str) -> DataFrame:
    """(line, value) of one job's log to events with seq = line + 1; blank and malformed lines and other jobs' are dropped and leave gaps."""
    rows = lines.where("trim(value) <> ''").withColumn("e", F.from_json(F.trim("value"), EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    valid = F.expr("try_parse_json(value)").isNotNull() & F.ltrim("value").startswith("{")
    own = F.trim(F.coalesce("e.job_id", F.lit(""))).isin("", job)
    name = F.coalesce(F.nullif(F.trim("e.event"), F.lit("")), F.nullif(F.trim("e.event_type"), F.lit("")), F.lit("event"))
    return rows.where(valid & own).select(
        F.lit(job).alias("job_id"), (F.col("line") + 1).alias("seq"), F.coalesce("e.ts", F.lit("")).alias("ts"), F.coalesce("e.level", F.lit("info")).alias("level"), "e.stage", "e.stage_detail", "e.provider", "e.provider_stage",
        F.coalesce("e.substage", "e.provider_stage").alias("substage"), name.alias("event"), F.coalesce("e.event_type", name).alias("event_type"), F.coalesce("e.message", F.lit("")).alias("message"), "e.progress_current", "e.progress_total", "e.retry_count", "e.elapsed_ms",
    )


def read_events(spark: SparkSession, path: str, job: str) -> DataFrame:
    """A JSON-lines log.  Line numbers count inside the one file of the job."""
    whole = spark.read.text(path, wholetext=True)
    return parse_events(whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value")), job)


def append_events(events: DataFrame, path: str) -> None:
    """Appends events to a log of JSON lines."""
    events.write.mode("append").json(path)


def _cell(c: Column) -> Column:
    """Trimmed, without a byte order mark."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "^﻿", ""))


def glossary_level(c: Column) -> Column:
    low = F.lower(_cell(c))
    return F.when(low.isin(*PRESERVE), "preserve").when(low.isin(*CANONICAL), "canonical").otherwise("preferred")


def match_mode(c: Column) -> Column:
    low = F.lower(_cell(c))
    return F.when(low == "regex", "regex").when(low.isin(*CASELESS), "case_insensitive").otherwise("exact")


def read_glossary(spark: SparkSession, lines: list[str], most: int = 200) -> DataFrame:
    """(pos, source, target, note, level, match_mode, context) of the lines of a CSV file; a header row is optional, rows may have any length.

    Without a header the first three cells are source, target and note.  The last entry of a source wins and stands where the
    first did; more than ``most`` entries are an error.
    """
    import csv

    rows = [r for r in csv.reader(lines) if r]
    if not rows:
        return spark.createDataFrame([], "pos long, source string, target string, note string, level string, match_mode string, context string")
    clean = [c.strip().lstrip("﻿").lower() for c in rows[0]]
    at = {name: next((i for i in reversed(range(len(clean))) if clean[i] in aliases), None) for name, aliases in HEADERS.items()}
    if at["source"] is None or at["target"] is None:
        at, body = {"source": 0, "target": 1, "note": 2, "level": None, "match_mode": None, "context": None}, rows
    else:
        body = rows[1:]
    cell = lambda r, name: r[at[name]] if at[name] is not None and at[name] < len(r) else ""
    df = spark.createDataFrame([(k, *[cell(r, n) for n in HEADERS]) for k, r in enumerate(body)], "pos long, " + ", ".join(f"{n} string" for n in HEADERS))
    df = df.select("pos", *[_cell(F.col(n)).alias(n) for n in ("source", "target", "note", "context")], glossary_level(F.col("level")).alias("level"), match_mode(F.col("match_mode")).alias("match_mode"))
    df = df.where("source <> '' OR target <> '' OR note <> ''")
    w = Window.partitionBy(F.translate("source", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    out = df.withColumn("__f", F.min("pos").over(w)).withColumn("__l", F.max("pos").over(w)).where("pos = __l").withColumn("pos", F.row_number().over(Window.orderBy("__f")) - 1).drop("__f", "__l")
    if out.count() > most:
        raise ValueError(f"a glossary has at most {most} entries")
    return out


def write_pages(records: DataFrame, path: str) -> None:
    """JSON, one folder per page."""
    records.write.partitionBy("page_idx").mode("overwrite").json(path)


def manifest(records: DataFrame) -> DataFrame:
    """(page_index, n_items): which pages there are."""
    return records.groupBy(F.col("page_idx").alias("page_index")).agg(F.count(F.lit(1)).alias("n_items"))


def check_manifest(rows: DataFrame) -> DataFrame:
    """The manifest; fails when it is read where a page occurs twice."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("page_index")) > 1
    return rows.withColumn("__ok", F.when(twice, F.raise_error(F.concat(F.lit("page "), F.col("page_index").cast("string"), F.lit(" occurs twice")))).otherwise(F.lit(True))).where("__ok").drop("__ok")


def select_pages(records: DataFrame, start: int, end: int) -> DataFrame:
    """Pages start to end inclusive; end < 0 means the last.  No page at all is an error."""
    out = records.where(F.col("page_idx") >= start)
    if end >= 0:
        out = out.where(F.col("page_idx") <= end)
    if out.isEmpty():
        raise ValueError("no pages in this range")
    return out
