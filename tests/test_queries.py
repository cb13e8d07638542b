"""Every registered query outside the optional subpackage against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import DATA, connect, differences
from quire.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = entry.queries()[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert len(theirs) > 0
    assert differences(ours, theirs) == ([], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize(
    "name", ["reference_headings", "reference_entries", "metadata_fragments", "code_literals", "english_prose", "cjk_dominance", "garbled_fragments", "math_balance", "protocol_shells", "author_lists", "continuation_signals"]
)
def test_rules_are_not_vacuous(spark, name):
    df = entry.queries()[name](spark, DATA).toPandas()
    for column in df.columns[df.dtypes == bool]:
        assert df[column].nunique() == 2, column


def test_entry(spark):
    assert entry.entry(spark).count() > 0
