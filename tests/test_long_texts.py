"""No rule overflows the stack, or takes more than linear time, on a line of 300,000 characters."""

import inspect

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import corpus, hints, outputs

N = 300_000
LINES = {
    "words": "word " * (N // 5), "dots": "a." * (N // 2), "initials": "Smith, " + "A. " * (N // 3), "capitals": "AB-" * (N // 3), "brackets": "([{<" * (N // 4), "blanks": "a" + " " * N + "b", "newlines": "a" + "\n" * N + "b",
    "numbers": "1." + "1." * (N // 2), "quotes": "{\"a\": \"" + "\\\"x" * (N // 3), "one word": "x" * N, "money": "$x^2$ " * (N // 6), "commas": "Ann Lee, " * (N // 9), "CJK": "中文模型" * (N // 4), "mail": "a@" + "a." * (N // 2),
}
SKIP = {"edged", "normalize_reference_heading"}
RULES = {n: f for n, f in inspect.getmembers(T, inspect.isfunction) if not n.startswith("_") and f.__module__ == T.__name__ and n not in SKIP and list(inspect.signature(f).parameters)[0] == "c"}
MORE = {
    "structured": lambda c: hints.is_structured_block(c), "reference_text": lambda c: hints.field_labels(c), "soft_hints": lambda c: hints.soft_hints(F.split(c, "\n"), c, F.lit(True)), "json_text": lambda c: outputs.json_text(c), "command": lambda c: outputs.command_prefix(c),
    "string_field": lambda c: outputs.string_field(c, "translated_text"), "residue": lambda c: outputs.residue_spans(c), "first_problem": lambda c: outputs.first_problem(c, c),
}


@pytest.fixture(scope="module")
def long_lines(spark):
    return spark.createDataFrame(list(LINES.items()), "name string, text string").repartition(4).cache()


@pytest.mark.parametrize("name", sorted(RULES))
def test_rule(long_lines, name):
    assert len(long_lines.select(F.hash(RULES[name](F.col("text"))).alias("x")).collect()) == len(LINES)


@pytest.mark.parametrize("name", sorted(MORE))
def test_more(long_lines, name):
    assert len(long_lines.select(F.hash(MORE[name](F.col("text"))).alias("x")).collect()) == len(LINES)


def test_terms(long_lines):
    assert corpus.preserve_terms(long_lines.withColumn("k", F.lit(1)), "text", ["k"]).count() >= 0
    assert corpus.term_pairs(long_lines.withColumnRenamed("name", "item_id"), "text").count() == 0


def test_word_edges_know_letters_outside_ascii(spark):
    rows = [("é1999 x, y J. Chem", False), ("(1999), J. Chem", True), ("²1999, Nature", False), ("_1999, Nature", False), ("in 1999, Nature", True), ("in 1999, Naturé", False)]
    got = spark.createDataFrame(rows, "text string, want boolean").select("text", "want", T.is_reference_entry(F.col("text")).alias("got")).collect()
    assert [(r["text"], r["got"]) for r in got] == rows
