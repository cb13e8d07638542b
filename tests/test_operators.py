"""Small hand-made rows for the behaviours that are easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import corpus, diagnostics, layout, models, policy, reading_order, store
from quire.sources import logs


def blocks(spark, rows):
    """(page, text, eligible, provider) rows of one document, in one column per page."""
    data = [(1, 100 + k, p, k, t, e, g, 50.0, 40.0 + 10 * k, 250.0, 48.0 + 10 * k) for k, (p, t, e, g) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, item_id long, page_idx long, block_idx long, text string, eligible boolean, provider_joined boolean, x0 double, y0 double, x1 double, y1 double")


def chain(spark, rows):
    out = reading_order.continuation(blocks(spark, rows)).orderBy("block_idx").collect()
    return [(r["continuation_group"], r["continuation_decision"]) for r in out]


def test_chain_skips_provider_rows_and_ineligible_ones(spark):
    got = chain(spark, [(0, "word-", True, False), (0, "xxx", True, True), (0, "formula", False, False), (0, "goes on-", True, False), (0, "and on", True, False)])
    assert got == [("cg-001-001", "joined"), ("", "provider_joined"), ("", ""), ("cg-001-001", "joined"), ("cg-001-001", "joined")]


def test_pass_stops_where_no_next_is_found(spark):
    # the block on page 3 has no next within a page, so nothing after it is looked at
    got = chain(spark, [(0, "Alone.", True, False), (3, "word-", True, False), (3, "goes on", True, False)])
    assert got == [("", ""), ("", ""), ("", "")]


def test_tail_of_a_chain_does_not_stop_the_pass(spark):
    got = chain(spark, [(0, "word-", True, False), (0, "goes on", True, False), (3, "more-", True, False), (3, "and more", True, False)])
    assert [g for g, _ in got] == ["cg-001-001", "cg-001-001", "cg-004-002", "cg-004-002"]


def test_start_word_quirk(spark):
    df = spark.createDataFrame([("Energy is conserved in the model that",), ("Energy that",), ("that",), ("Because of it",)], "t string")
    assert [r[0] for r in df.select(T.starts_like_continuation(F.col("t"))).collect()] == [False, True, True, False]


def test_null_signatures_never_merge(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "s"), (4, "s")], "item_id long, sig string")
    assert sorted((r["item_id"], r["rep_id"]) for r in corpus.dedupe(df, "sig", ["item_id"]).collect()) == [(1, 1), (2, 2), (3, 3), (4, 3)]


def test_provider_filter_follows_the_limit(spark):
    jobs = spark.createDataFrame([(k, f"2024-{k:02d}") for k in range(1, 6)], "job_id long, updated_at string")
    arts = spark.createDataFrame([(k, "Paddle" if k % 2 else "mineru") for k in range(1, 6)], "job_id long, provider string")
    page = store.list_jobs(jobs, arts, "job_id", [F.desc("updated_at")], limit=3, provider=("provider", "paddle"))
    assert sorted(r["job_id"] for r in page.collect()) == [3, 5]


def test_glossary_merge_keeps_base_positions(spark):
    schema = "pos int, source string, target string"
    base = spark.createDataFrame([(0, "A", "1"), (1, "B", "2")], schema)
    over = spark.createDataFrame([(0, "C", "3"), (1, " a", "4")], schema)
    got = [(r["pos"], r["source"], r["target"]) for r in corpus.merge_glossaries(base, over).orderBy("pos").collect()]
    assert got == [(0, " a", "4"), (1, "B", "2"), (2, "C", "3")]


def test_glossary_context_is_a_window(spark):
    g = spark.createDataFrame([("cat", "Katze", "preferred", "exact", "dog")], "source string, target string, level string, match_mode string, context string")
    rows = spark.createDataFrame([(1, "a dog and a cat"), (2, "dog" + " " * 200 + "cat"), (3, "cats and dog"), (4, "cat")], "item_id long, text string")
    assert [r["item_id"] for r in corpus.match_glossary(rows, g, "text").collect()] == [1]


def test_outliers_use_population_variance_and_a_floor(spark):
    rows = spark.createDataFrame([(1, k, 100) for k in range(50)] + [(1, 99, 40000), (1, 98, 0)], "run int, event_id long, latency_ms long")
    got = diagnostics.latency_outliers(rows, ["run"]).collect()
    assert [(r["event_id"], r["threshold_ms"]) for r in got] == [(99, 30000)]


def test_upsert_takes_the_last_version(spark):
    schema = "k long, v string, at string"
    old = spark.createDataFrame([(1, "a", "1"), (2, "b", "1")], schema)
    new = spark.createDataFrame([(2, "c", "3"), (2, "d", "2"), (3, "e", "0")], schema)
    assert sorted(map(tuple, store.upsert(old, new, ["k"], "at").collect())) == [(1, "a", "1"), (2, "c", "3"), (3, "e", "0")]


def test_live_stage_of_a_failed_job_borrows(spark):
    rows = [(1, "t1", 1, "queued", "d1", "x", 3, 9), (1, "t2", 2, "failed", "d2", "x", None, None), (2, "t1", 1, "", "d", "x", 1, 2), (3, "t1", 1, "rendering", "r", "artifact_published", None, None)]
    df = spark.createDataFrame(rows, "job long, ts string, seq long, stage string, stage_detail string, event_type string, progress_current int, progress_total int")
    assert [tuple(r) for r in store.live_stage(df, "job").collect()] == [(1, "queued", "d1", 3, 9)]


def test_two_columns_need_three_on_either_side(spark):
    row = lambda k, x: (1, 0, k, True, x, x + 100.0, float(k), float(k) + 5, 100 + k)
    schema = "doc_id long, page_idx long, block_idx long, flow boolean, x0 double, x1 double, y0 double, y1 double, item_id long"
    two = spark.createDataFrame([row(k, 0.0 if k < 3 else 400.0) for k in range(6)], schema)
    lopsided = spark.createDataFrame([row(k, 0.0 if k < 2 else 400.0) for k in range(6)], schema)
    assert layout.page_layout(two, "doc_id", "page_idx").first()["layout_mode"] == "double"
    assert layout.page_layout(lopsided, "doc_id", "page_idx").first()["layout_mode"] == "single"
    zones = layout.zones(two, "doc_id", "page_idx").orderBy("block_idx").collect()
    assert [z["layout_boundary_role"] for z in zones] == ["head", "middle", "tail"] * 2


def test_overlaps_are_met_once(spark):
    r = lambda df: df.select("p", "id", G.rect(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("r"))
    schema = "p int, id long, a double, b double, c double, d double"
    left = r(spark.createDataFrame([(0, 1, 0.0, 0.0, 500.0, 500.0)], schema))
    right = r(spark.createDataFrame([(0, 2, 100.0, 100.0, 450.0, 450.0), (0, 3, 600.0, 0.0, 700.0, 10.0)], schema))
    assert [(x["a_id"], x["b_id"], x["inter"]) for x in layout.rect_overlaps(left, right, ["p"]).collect()] == [(1, 2, 350.0 * 350)]


def test_page_ranges(spark):
    df = spark.createDataFrame([("5~2,9",), (None,)], "s string")
    assert [r[0] for r in df.select(policy.expand_ranges(F.col("s"))).collect()] == [[2, 3, 4, 5, 9], []]


def test_cutoff_needs_both_parts(spark):
    df = spark.createDataFrame([(1, 2, 1, 2), (1, 1, 1, 2), (2, 0, 1, 2), (2, 0, 1, None)], "p int, b int, cp int, cb int")
    assert [r[0] for r in df.select(policy.at_or_after(F.col("p"), F.col("b"), F.col("cp"), F.col("cb"))).collect()] == [True, False, True, False]


def test_model_hook_retries_batches_then_rows(spark):
    def flaky():
        calls = {"n": 0}

        def call(texts):
            calls["n"] += 1
            if any("bad" in t for t in texts):
                raise RuntimeError
            return [t.upper() for t in texts]

        return call

    models.register_provider("flaky", flaky)
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, " "), (4, None), (5, "b")], "id long, text string")
    got = {r["id"]: (r["translated"], r["final_status"]) for r in models.translate(rows.coalesce(1), "text", "flaky").collect()}
    assert got == {1: ("A", "translated"), 2: ("bad", "failed"), 3: ("", "kept_origin"), 4: ("", "kept_origin"), 5: ("B", "translated")}


def test_manifest_rejects_repeated_pages(spark):
    with pytest.raises(Exception, match="occurs twice"):
        logs.check_manifest(spark.createDataFrame([(1, "a"), (1, "b")], "page_index int, path string")).collect()


def test_event_and_page_files(spark, tmp_path):
    path = str(tmp_path / "log.jsonl")
    (tmp_path / "log.jsonl").write_text('{"ts": "t1", "stage": "a"}\n\nnope\n{"job_id": "z"}\n{"ts": "t2"}')
    assert [(r["seq"], r["ts"]) for r in logs.read_events(spark, path, "j").orderBy("seq").collect()] == [(1, "t1"), (5, "t2")]
    records = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "page_idx int, t string")
    logs.write_pages(records, str(tmp_path / "pages"))
    back = logs.select_pages(spark.read.json(str(tmp_path / "pages")), 1, -1)
    assert sorted(r["t"] for r in back.collect()) == ["b", "c"]
    with pytest.raises(ValueError, match="no pages"):
        logs.select_pages(back, 9, 12)
