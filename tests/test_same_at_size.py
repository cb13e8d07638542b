"""Rows that only larger tables have, where a query differed from its SQL."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from compare import connect, differences
from quire.streaming import live


@pytest.fixture
def same(spark, tmp_path):
    """Writes a table made of ``rows`` and compares a query over it with its SQL."""

    def check(name, table, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
        con = connect()
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        ours, theirs = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
        assert differences(ours, theirs) == ([], [])
        return ours

    return check


DOCUMENT = "doc_id long, text string"


def test_capacity_of_lines_that_fit_to_the_unit(same):
    # demands of exactly 23, 2 and 2 lines; the last one is a sum that goes astray in fractions
    texts = ["." * 1000 + "中" * 162 + "  ", "中中" + "." * 13 + "x" * 57, "中" + "." * 14 + "aaa bbbb cc " * 3 + "x" * 57]
    out = same("capacity_units", "documents", list(enumerate(texts)), DOCUMENT).set_index("item_id")
    assert out.loc[0, "demand"] == 612.5 and out.loc[0, "n_lines"] == 23
    assert out.loc[1000000, "demand"] == 39.2 and out.loc[1000000, "n_lines"] == 2


def test_percentiles_that_lie_half_way(same):
    # nine tenths of the way from one value of a user to the other lie at a whole number and a half
    rows = [(k, None, u, "view", (v + 0.5) / 300, '{"k": 1}') for k, (u, v) in enumerate((u, v) for u in range(20) for v in (407, 582 + 20 * u))]
    same("latency_percentiles", "events", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_sources_by_their_first_place_in_whatever_order_rows_arrive(spark, tmp_path):
    # a batch each, the later rows first
    schema = "job string, term string, source string, at long"
    for k, rows in enumerate([[("j", "t", "c", 9), ("j", "t", "a", 5)], [("j", "t", s, n) for n, s in enumerate(["b", "", "a", "b", "c"])]]):
        spark.createDataFrame(rows, schema).toPandas().to_parquet(tmp_path / f"{k}.parquet")
        os.utime(tmp_path / f"{k}.parquet", (1e9 + k * 100,) * 2)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path))
    assert [tuple(r) for r in live.term_memory(stream, str(tmp_path / "out")).collect()] == [("j", "t", 7, "b,a,c")]


def test_parts_of_one_batch_come_in_any_order():
    class State:
        exists = False

        def update(self, new):
            self.get, self.exists = new, True

    state = State()
    part = lambda *rows: pd.DataFrame(rows, columns=["source", "at"])
    out = [d.values.tolist() for d in live._remember(("j", "t"), iter([part(("c", 7), ("b", 9)), part(("b", 1), (None, 0), ("a", 3))]), state)]
    assert out == [[["j", "t", 5, "b,a,c"]]]
    list(live._remember(("j", "t"), iter([part(("z", None))]), state))
    assert state.get[1:] == (["b", "a", "c", "z"], [1, 3, 7, live.NO_PLACE])
    [late] = live._remember(("j", "t"), iter([part(*[(f"s{k}", 20 + k) for k in range(6)]), part(("c", 0))]), state)
    assert late.values.tolist() == [["j", "t", 13, "a,s0,s1,s2,s3,s4,s5,z"]]


@pytest.mark.parametrize("name", ["results_canonical", "results_applied", "stream_flush"])
def test_copy_that_only_its_placeholder_makes_code(same, name):
    # five of eleven tokens are code with the placeholder, four of ten without it: prose, so the copy isn't kept
    text = "Anthnt$$$ enthor,%%% the&&& to%%% of%%% thth*** eshe,### hest*** reesen$$$ annted."
    out = same(name, "documents", [(0, "\n".join(["a line"] * 30 + [text]))], DOCUMENT)
    status = out[out["unit_id"] == "0-30"]["final_status"]
    assert set(status) == {"translated"}
