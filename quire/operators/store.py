"""The job store as tables: upserts, cascades, listings, pagination, event log and live status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Page sizes, and the most events that a merged log takes from the table.
JOBS_PAGE, EVENTS_PAGE, MERGE_CAP = 20, 100, 10_000


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The table with each changed key's last version in place of its row; a key may change several times.

    Aggregates, so a key with many versions meets one row per task.
    """
    others = [c for c in table.columns if c not in keys]
    both = table.withColumn("__o", F.lit(0)).unionByName(changes.select(*table.columns).withColumn("__o", F.lit(1)))
    last = F.max_by(F.struct(*others), F.struct("__o", version))
    return both.groupBy(*keys).agg(last.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in others]).select(*table.columns)


def replace_children(children: DataFrame, fresh: DataFrame, parent: list[str]) -> DataFrame:
    """All rows of the parents in ``fresh`` are replaced by the fresh ones."""
    return children.join(fresh.select(*parent).distinct(), parent, "left_anti").unionByName(fresh.select(*children.columns))


def delete_cascade(parents: DataFrame, children: dict[str, DataFrame], gone: DataFrame, key: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents and their children without the keys in ``gone``."""
    without = lambda df: df.join(gone.select(key).distinct(), key, "left_anti")
    return without(parents), {name: without(df) for name, df in children.items()}


def append_events(log: DataFrame, fresh: DataFrame, job: str, order: list[str]) -> DataFrame:
    """The fresh events numbered on from each job's largest seq (from 1 for a new job), after the log's."""
    top = log.groupBy(job).agg(F.max("seq").alias("__top"))
    n = F.row_number().over(Window.partitionBy(job).orderBy(*order))
    numbered = fresh.withColumn("seq", n.cast("long")).join(top, job, "left").withColumn("seq", F.col("seq") + F.coalesce("__top", F.lit(0))).drop("__top")
    return log.unionByName(numbered.select(*log.columns))


def page_of(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit of the order: a top-k, never a full sort into one task."""
    return rows.orderBy(*order).limit(offset + limit).offset(offset)


def list_jobs(jobs: DataFrame, artifacts: DataFrame, key: str, order: list[Column], limit: int = JOBS_PAGE, offset: int = 0, where: Column | None = None, provider: tuple[str, str] | None = None) -> DataFrame:
    """Jobs with their artifacts; ``where`` holds before the page is cut, the provider filter (column, value; caseless) after it, so a page may be short."""
    rows = jobs if where is None else jobs.where(where)
    out = page_of(rows, order, limit, offset).join(artifacts, key, "left")
    return out if provider is None else out.where(F.lower(provider[0]).eqNullSafe(provider[1].lower()))


def combined_events(table: DataFrame, logged: DataFrame, job: str) -> DataFrame:
    """Table and log events of each job, by (ts, seq, event), numbered anew.

    ``table``: seq as stored, of which the first 10,000 count.  ``logged``: line (0-based, gaps where lines were dropped); their seq goes on
    from the table's largest.
    """
    own = table.withColumn("__k", F.row_number().over(Window.partitionBy(job).orderBy("seq"))).where(F.col("__k") <= MERGE_CAP).drop("__k")
    top = own.groupBy(job).agg(F.max("seq").alias("__top"))
    filed = logged.join(top, job, "left").withColumn("seq", F.coalesce("__top", F.lit(0)) + F.col("line") + 1).select(*own.columns)
    w = Window.partitionBy(job).orderBy("ts", "seq", "event")
    return own.unionByName(filed).withColumn("seq", F.row_number().over(w).cast("long"))


def stage_rank(stage: Column) -> Column:
    """render and finished 3, translate 2, ocr 1, all else 0."""
    s = F.trim(F.coalesce(stage, F.lit("")))
    return (
        F.when(s.isin("finished", "succeeded") | s.contains("render"), 3)
        .when(s.contains("translat") | s.isin("domain_inference", "continuation_review", "page_policies"), 2)
        .when(s.contains("ocr") | s.contains("mineru") | s.contains("paddle") | s.contains("normaliz"), 1)
        .otherwise(0)
    )


def live_stage(events: DataFrame, job: str) -> DataFrame:
    """(job, stage, stage_detail, progress_current, progress_total): the event with the largest (rank, ts, seq).

    Published artifacts and blank stages don't count; missing progress comes from the last event that has any, and so do stage
    and detail of a failed job without progress of its own.  Aggregates on the map side: no event log is sorted.
    """
    s = F.trim(F.coalesce("stage", F.lit("")))
    counts = (F.trim(F.coalesce("event_type", F.lit(""))) != "artifact_published") & (s != "")
    row = F.struct("stage", "stage_detail", "progress_current", "progress_total")
    chosen = F.max_by(row, F.when(counts, F.struct(stage_rank(F.col("stage")), "ts", "seq"))).alias("c")
    moving = F.col("progress_current").isNotNull() | F.col("progress_total").isNotNull()
    last = F.max_by(row, F.when(moving, F.struct("ts", "seq"))).alias("p")
    agg = events.groupBy(job).agg(chosen, last, F.max(counts).alias("any"), F.max(moving).alias("moved")).where("any")
    p = lambda f: F.when(F.col("moved"), F.col(f"p.{f}"))
    borrow = F.col("c.progress_current").isNull() & (F.trim("c.stage") == "failed") & (F.trim(F.coalesce(p("stage"), F.lit(""))) != "")
    return agg.select(
        job, F.when(borrow, p("stage")).otherwise(F.col("c.stage")).alias("stage"), F.when(borrow, p("stage_detail")).otherwise(F.col("c.stage_detail")).alias("stage_detail"),
        F.coalesce("c.progress_current", p("progress_current")).alias("progress_current"), F.coalesce("c.progress_total", p("progress_total")).alias("progress_total"),
    )


def derive_changes(snapshots: DataFrame, job: str, order: list[str], watched: list[str]) -> DataFrame:
    """(job, order..., event, field, old, new): job_created for a first snapshot, then one ``<field>_changed`` row per watched field that differs."""
    w = Window.partitionBy(job).orderBy(*order)
    rows = snapshots.withColumn("__n", F.row_number().over(w))
    pairs = [F.struct(F.lit(c).alias("field"), F.lag(F.col(c).cast("string")).over(w).alias("old"), F.col(c).cast("string").alias("new")) for c in watched]
    each = rows.withColumn("__c", F.array(*pairs)).select(job, *order, "__n", F.explode("__c").alias("c")).where("__n > 1 AND NOT c.old <=> c.new")
    changed = each.select(job, *order, F.concat("c.field", F.lit("_changed")).alias("event"), F.col("c.field").alias("field"), F.col("c.old").alias("old"), F.col("c.new").alias("new"))
    none = F.lit(None).cast("string")
    created = rows.where("__n = 1").select(job, *order, F.lit("job_created").alias("event"), none.alias("field"), none.alias("old"), none.alias("new"))
    return created.unionByName(changed)


def rewrite_paths(rows: DataFrame, column: str, pattern: str, old: str, new: str) -> DataFrame:
    """UPDATE ... SET column = replace(column, old, new) WHERE column LIKE pattern."""
    return rows.withColumn(column, F.when(F.col(column).like(pattern), F.replace(F.col(column), F.lit(old), F.lit(new))).otherwise(F.col(column)))


def redact(text: Column, secrets: list[str]) -> Column:
    """Every occurrence of a non-empty secret replaced, longest first."""
    for s in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    return text
