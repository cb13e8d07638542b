"""Pages flushed from a stream of results: replays change nothing, the end equals one batch run."""

from collections import Counter

from pyspark.sql import functions as F

from quire.operators.records import apply_results
from quire.streaming.flush import PageFlush
from test_records import RECORD, RESULT, record


def state(df):
    return Counter((r["item_id"], r["page_idx"], r["unit_id"], r["final_status"], r["translated_text"]) for r in df.collect())


def test_flushes_equal_one_run_and_replays_change_nothing(spark, tmp_path):
    rows = [record(f"i{k}", k, f"source text {k}.", group=f"g{k // 4}" if k % 4 < 2 else None) for k in range(40)]
    records = spark.createDataFrame(rows, RECORD).withColumn("page_idx", F.floor(F.col("pos") / 5))
    batches = [
        [(1, "i2", 0, "translate", "first", None), (1, "__cg__:g1", 1, "translate", "alpha beta gamma", None)], [(1, "i2", 2, "translate", "second", None), (1, "nobody", 3, "translate", "x", None)],
        [(1, "i39", 4, "keep", "", None)], [(1, "i3", 5, "translate", "t", "failed"), (1, "i2", 1, "translate", "late", None)], [(1, "i6", 6, "translate", "six", None)],
    ]
    frames = [spark.createDataFrame(b, RESULT) for b in batches]
    flush = PageFlush(records, str(tmp_path / "a"), interval=2)
    assert flush.pages().count() == 0
    for k, b in enumerate(frames):
        flush.batch(b, k)
    flush.flush(4)
    every = spark.createDataFrame([r for b in batches for r in b], RESULT)
    touched = {0, 1, 7}
    whole = state(apply_results(records, every).where(F.col("page_idx").isin(*touched)))
    assert state(flush.pages()) == whole and whole[("i2", 0, "i2", "translated", "second")] == 1
    for k in (1, 3, 4):  # as after a failure
        flush.batch(frames[k], k)
    flush.flush(4)
    assert state(flush.pages()) == whole
    # the first flush, after two batches, had written no page of the later ones
    assert {r[0] for r in spark.read.parquet(str(tmp_path / "a/pages/00000001")).select("page_idx").distinct().collect()} == {0, 1}


def test_from_a_stream(spark, tmp_path):
    records = spark.createDataFrame([record(f"i{k}", k, "s") for k in range(20)], RECORD).withColumn("page_idx", F.floor(F.col("pos") / 5))
    for k in range(5):
        spark.createDataFrame([(1, f"i{k * 4}", k, "translate", f"t{k}", None)], RESULT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RESULT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = PageFlush(records, str(tmp_path / "b"), interval=3).run(stream)
    assert state(out) == state(apply_results(records, spark.read.parquet(str(tmp_path / "in"))))
