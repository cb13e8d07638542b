"""Pages rewritten as results stream in: dirty pages are noted per batch and flushed every few batches.

Everything a batch does goes into folders named by its number, so a batch that is run again after a failure overwrites what it wrote and changes
nothing.  A flush writes whole pages from the records and all results so far; a page's state is its latest flush.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.records import GROUP_PREFIX, apply_results
from quire.operators.results import touched_pages


class PageFlush:
    """Applies a stream of results (doc_id, unit_id, seq, decision, translated_text, final_status) to ``records`` (see ``apply_results``, with page_idx), flushing each ``interval`` batches and at the end.

    ``records`` is read again in each flush: pass a table, not a long plan.  ``folder`` is one that all executors share.
    """

    def __init__(self, records: DataFrame, folder: str, interval: int = 4) -> None:
        self.records, self.folder, self.interval = records, folder.rstrip("/"), max(1, interval)

    def _at(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/{number:08d}"

    def batch(self, rows: DataFrame, number: int) -> None:
        """One micro-batch: its results and the pages they touch, then a flush if one is due."""
        rows.write.mode("overwrite").parquet(self._at("results", number))
        done = rows.sparkSession.read.parquet(self._at("results", number)).select("doc_id", F.col("unit_id").alias("id"), F.coalesce("unit_id", F.lit("")).startswith(GROUP_PREFIX).alias("is_group"))
        units = apply_results(self.records, self._none(rows)).select("doc_id", "item_id", "unit_id", "page_idx")
        touched_pages(done.distinct(), units).write.mode("overwrite").parquet(self._at("dirty", number))
        if (number + 1) % self.interval == 0:
            self.flush(number)

    def _none(self, rows: DataFrame) -> DataFrame:
        return rows.sparkSession.createDataFrame([], rows.schema)

    def flush(self, number: int) -> None:
        """Writes the pages that batches since the last flush, up to ``number``, have touched."""
        spark = self.records.sparkSession
        first = number // self.interval * self.interval
        dirty = spark.read.parquet(*[self._at("dirty", k) for k in range(first, number + 1)]).distinct()
        results = spark.read.parquet(*[self._at("results", k) for k in range(number + 1)])
        # units and neighbours reach over pages, so whole documents are looked at, dirty pages written
        touched = self.records.join(dirty.select("doc_id").distinct(), "doc_id", "left_semi")
        pages = apply_results(touched, results).join(dirty, ["doc_id", "page_idx"], "left_semi")
        pages.withColumn("flush", F.lit(number)).write.mode("overwrite").parquet(self._at("pages", number))

    def run(self, stream: DataFrame) -> DataFrame:
        """Drains ``stream``; returns the state of all pages that were touched."""
        last = [-1]

        def each(rows: DataFrame, number: int) -> None:
            self.batch(rows, number)
            last[0] = number

        stream.writeStream.option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).foreachBatch(each).start().awaitTermination()
        if last[0] >= 0 and (last[0] + 1) % self.interval:
            self.flush(last[0])
        return self.pages()

    def pages(self) -> DataFrame:
        """Items of each page as its latest flush left them; without any flush an empty table."""
        spark: SparkSession = self.records.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/pages")
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            return apply_results(self.records.limit(0), spark.createDataFrame([], "doc_id long, unit_id string, seq long, decision string, translated_text string, final_status string"))
        every = spark.read.parquet(f"{self.folder}/pages/*")
        latest = every.groupBy("doc_id", "page_idx").agg(F.max("flush").alias("flush"))
        return every.join(latest, ["doc_id", "page_idx", "flush"], "left_semi").drop("flush")
