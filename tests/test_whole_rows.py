"""Queries go over the whole of their rows, not over a part that is easy."""

import pytest

import __spark_entry__ as entry
from compare import DATA


@pytest.fixture
def tables(spark, tmp_path):
    def write(*texts):
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


def test_soft_hints_see_lines_after_the_third(spark, tables):
    prose = "these plain words of English prose come after all of the short opening lines"
    command = "gcc -o out.bin main.c -O2"
    folder = tables(f"a\nb\nc\n{prose}", f"a\nb\nc\n{command} {prose}", "a\nb\nc\nd")
    got = {r["doc_id"]: r["hints"].split(",") for r in entry.queries()["soft_hints"](spark, folder).where("doc_id >= 0").collect()}
    assert got == {0: ["body_text_block", "long_english_prose"], 1: ["long_english_prose", "mixed_literal_and_prose_block"], 2: ["body_text_block"]}


def test_every_line_is_restored_by_one_of_two_queries(spark, tables):
    folder = tables("plain SCF line\nthe energy $ x^2 $ and E_k of SCF\na \\alpha_{i} b", "cost is 5\nhalf a_1", "no sign")
    rows = [{r["item_id"]: r["restored"] for r in entry.queries()[n](spark, folder).where("item_id >= 0").collect()} for n in ("restore_tokens", "restore_formulas")]
    assert rows[0] == {0: "plain SCF line", 1000000: "cost is 5", 2000000: "no sign"}
    # a formula takes in the letters beside it, as many as are not prose, and knows no dollar signs
    assert rows[1] == {1: "the energy $ $x^2$ $ $and E_k of SCF$", 2: "$a \\alpha_{i} b$", 1000001: "$half a_1$"}


def test_segment_plans_keep_the_tail_of_a_long_line(spark, tables):
    text = "word " * 25000 + "the very end"
    row = entry.queries()["segment_plans"](spark, tables(text)).where("item_id = 0").collect()[0]
    assert row["rebuilt"].endswith("the very end") and row["rebuilt"].count("word") == 25000
