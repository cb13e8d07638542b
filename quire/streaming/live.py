"""Structured Streaming over event logs: live stage, windowed counts, term memory.

Checkpoints and results live in the folder given, which all executors share.  Each batch's output is a Parquet folder of its own, so a
rerun after a failure overwrites what the failed try left.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quire.operators.store import live_stage

#: Fixed value: sources of a term that are shown.
SOURCES = 8
#: Of sources without a place, which come last.
NO_PLACE = 2**63 - 1


def source(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """A stream of Parquet files: those of a folder, or one file."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def _drain(stream: DataFrame, mode: str, folder: str, keep: str) -> DataFrame:
    """Runs a stream over all that is there, and reads back its batches (all of them, or the last)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number:08d}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    out = stream.sparkSession.read.parquet(f"{folder}/out/*")
    if keep == "last":
        newest = out.agg(F.max("batch")).first()[0]
        out = out.where(F.col("batch") == newest)
    return out.drop("batch")


def live_stages(events: DataFrame, job: str, folder: str) -> DataFrame:
    """The live stage of each job after the last event: the batch aggregate, kept as streaming state of one row a job."""
    return _drain(live_stage(events, job), "complete", folder, "last")


def windowed_counts(events: DataFrame, time: str, key: str, width: str, late: str, folder: str) -> DataFrame:
    """(start, key, n, total) by tumbling windows of event time; state older than ``late`` is dropped, updates of a window replace it."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    rows = counted.select(F.col("window.start").alias("start"), key, "n", "total")
    return _latest(rows, ["start", key], folder)


def _latest(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/{number:08d}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    out = stream.sparkSession.read.parquet(f"{folder}/out/*")
    others = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in others])


def _remember(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Adds a batch's rows of a term, which come in any order and in parts, to its state: hits, and where each source came first."""
    hits, sources, places = state.get if state.exists else (0, [], [])
    first = dict(zip(sources, places, strict=True))
    for part in parts:
        hits += len(part)
        for s, at in part.groupby("source")["at"].min().items():
            if s:
                at = NO_PLACE if pd.isna(at) else int(at)
                first[s] = min(at, first.get(s, at))
    names = sorted(first, key=lambda s: (first[s], s))
    state.update((hits, names, [first[s] for s in names]))
    yield pd.DataFrame([[*key, hits, ",".join(names[-SOURCES:])]], columns=["job", "term", "hits", "sources"])


def term_memory(occurrences: DataFrame, folder: str) -> DataFrame:
    """(job, term, hits, sources) folded as occurrences (job, term, source, at) arrive, in whatever order: sources by their first place, the newest ``SOURCES`` shown.  The state of a term is one row, with one entry for each source."""
    made = occurrences.groupBy("job", "term").applyInPandasWithState(_remember, "job string, term string, hits long, sources string", "hits long, sources array<string>, places array<long>", "update", GroupStateTimeout.NoTimeout)
    return _latest(made, ["job", "term"], folder)
