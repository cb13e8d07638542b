"""Staged tables: batches for Python workers are small inside, and the session keeps its setting."""

import pyarrow as pa
import pytest

from quire.llm import common
from quire.llm.common import stage

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def setting(spark):
    own = spark.conf.get(KEY)
    yield
    spark.conf.set(KEY, own)


@pytest.mark.parametrize("own, most", [("10000", 1000), ("70", 70), ("0", 1000)])
def test_batches_are_small_and_the_setting_stays(spark, setting, own, most):
    def sizes_of(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    spark.conf.set(KEY, own)
    sizes = [r["n"] for r in stage(spark.range(5000, numPartitions=1).mapInArrow(sizes_of, "n long"), "sizes").collect()]
    assert sum(sizes) == 5000 and max(sizes) == most
    assert spark.conf.get(KEY) == own


def test_the_setting_comes_back_after_a_failure(spark, setting):
    spark.conf.set(KEY, "12345")
    with pytest.raises(Exception, match="no_such_function|UNRESOLVED|DIVIDE"):
        stage(spark.sql("SELECT 1 / (id - id) AS x FROM range(3)"), "broken")
    assert spark.conf.get(KEY) == "12345"


def test_a_staged_table_is_not_written_again(spark):
    rows = stage(spark.range(3).toDF("id"), "rows")
    assert stage(rows, "rows") is rows


def test_a_worker_gives_back_what_it_no_longer_uses(monkeypatch):
    """Once, after the last batch: free memory of a worker that waits for its next task still counts as the executor's."""
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(True))
    batch = pa.record_batch([pa.array(range(2500))], names=["n"])
    sizes = []
    for x in common.sliced(iter([batch, batch])):
        assert not given
        sizes.append(x.num_rows)
    assert sizes == [1000, 1000, 500] * 2 and given == [True]
    monkeypatch.undo()
    common.give_back()
