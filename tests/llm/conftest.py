import pytest

#: Columns that clash with names that the operators use.
CLASH = "keep_id long, kept string, n long, h1 long, band long, shard int, score string, ids string, a long, b long, group string, __x int"

LONG = " ".join(f"word{k % 997}" for k in range(60000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "s"), (2, "The quick brown fox jumps over the lazy dog and runs away.", "en", "s"), (3, None, None, None), (4, "", "en", "s"), (5, "", "fr", None),
    (6, " \t\n ", None, "s"), (7, LONG, "en", "s"), (8, LONG, "en", "s"), (9, "Ein kurzer Satz über die Straße und das Haus.", "de", "s"), (10, "12345 67890 !!!", "en", "s"), (11, "one two", "en", "s"), (12, "ONE two", None, "s"),
    (12, "ONE two", None, "s"), (None, "no id here at all", "en", "s"), (None, None, None, None), (13, "日本語のテキスト 😀 \x00 <|endoftext|> end", "xx", "s"), (14, "café café naïve", "fr", "s"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing column names."""
    data = [(i, t, lang, src, None if t is None else len(t), *[k if k % 2 else None for k in range(2)], *[None] * 10) for i, t, lang, src in ROWS]
    data = [(*r[:5], 1, "x", None, 2, None, 3, "s", "i", None, 4, "g", 5) for r in data]
    return spark.createDataFrame(data, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)
