import os
import random
import re
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_brute import brute_components

from compare import DATA, connect, differences
from quire.llm import exact_dedup, line_dedup, near_dedup, queries
from quire.llm.common import among, counter, mix

def check_near(spark, docs, width):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, width=width).collect()}
    assert got == brute_components(docs, width)


def test_op8_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op8_near_dedup(spark, DATA).collect()}
    want = brute_components(docs, 4)
    assert got == want
    assert any(i != c for i, (_, c) in got.items())


def test_near_copies_in_chains_and_around_the_threshold(spark):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(400)]
    docs, base = [], list(rng.choice(words, 60))
    for k in range(120):  # each copy changes one more word of its predecessor, so that only neighbours are alike
        base = list(base)
        base[int(rng.integers(60))] = f"new{k}"
        docs.append((1000 - k, " ".join(base)))
    hub = list(rng.choice(words, 100))
    for k in range(80):  # copies of one text that are not all alike
        copy = list(hub)
        for j in rng.choice(100, int(rng.integers(0, 8)), replace=False):
            copy[int(j)] = f"x{k}-{j}"
        docs.append((2000 + k, " ".join(copy)))
    check_near(spark, docs, 4)
    check_near(spark, docs, 5)


def test_near_edge_cases(spark, odd, none):
    rows = near_dedup.near_duplicates(odd, width=5).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None}
    assert got[1][1] == got[2][1] == 1 and not got[2][2]
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[5] == (0, 5, True) and got[6] == (0, 6, True)
    assert got[8][1] == 7 and got[12][1] == 11 and got[11] == (1, 11, True)
    assert all(r["kept"] and r["component_id"] is None for r in rows if r["doc_id"] is None)
    left = near_dedup.drop_near_copies(odd)
    assert left.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted("1 3 4 5 6 7 9 10 11 None None 13 14".split())
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.drop_near_copies(none).count() == 0


def test_superminhash_estimates_jaccard():
    sets = []
    for k in range(200):
        x = np.unique(mix(np.arange(k * 3000 + 1, k * 3000 + 1001, dtype=np.uint64)))
        sets += [x[:900], x[100:]]
    sig = near_dedup.superminhash(sets, 128)
    same = (sig[::2] == sig[1::2]).mean(1)
    assert abs(same.mean() - 0.8) < 0.01 and same.std() < np.sqrt(0.16 / 128) * 1.1
    small = near_dedup.superminhash([counter(5, 1), counter(5, 1)[::-1].copy(), np.zeros(0, np.uint64)], 128)
    assert (small[0] == small[1]).all() and len(set(small[0].tolist())) == 128 and (small[2] == near_dedup._FULL).all()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(spark, links):
    df = spark.createDataFrame(links, "a long, b long").repartition(4)
    got = {r["node"]: r["component"] for r in near_dedup.components(df).collect()}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            for w in near[todo.pop()] - seen:
                seen.add(w)
                todo.append(w)
        assert got.get(v, v) == min(seen)


def test_op4_against_sql(spark):
    ours, theirs = queries.op4_exact_dedup(spark, DATA).toPandas(), connect().execute(queries.ORACLE_SQL["op4_exact_dedup"]).df()
    assert differences(ours, theirs) == ([], [])
    assert (ours.group_size > 1).any()


def test_exact_with_a_full_filter(spark):
    """One block for many rows: the filter passes too much, the result is the same."""
    df = spark.range(20000).selectExpr("id AS doc_id", "CAST(id DIV 3 AS string) AS text")
    rows = exact_dedup.decisions(df, max_blocks=1).where("kept").collect()
    assert len(rows) == 6667 and all(r["doc_id"] == min(3 * (r["doc_id"] // 3) + 2, 19999) for r in rows)
    assert exact_dedup.drop_copies(df, max_blocks=1).count() == 6667


def test_exact_edge_cases(spark, odd, none):
    rows = exact_dedup.decisions(odd).collect()
    assert len(rows) == odd.count()
    got = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert got[1]["keep_id"] == 2 and not got[1]["kept"] and got[2]["kept"]
    assert got[3]["keep_id"] == 5 and got[3]["group_size"] == 4  # null counts as empty; one of them has no id
    assert got[12]["group_size"] == 2 and got[12]["kept"] and got[6]["group_size"] == 1
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted("2 5 6 8 9 10 11 12 None 13 14".split())
    assert exact_dedup.decisions(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def test_exact_is_native(spark, odd):
    plan = exact_dedup.decisions(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastHashJoin" in plan


def test_hot_groups(spark):
    """A third of all rows are copies of one text."""
    df = spark.range(9000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'the same words again and again', concat('row number ', id, ' of these')) AS text")
    assert exact_dedup.decisions(df).where("NOT kept").count() == 2999
    assert near_dedup.near_duplicates(df).where("component_id = 0").count() == 3000
    assert near_dedup.drop_near_copies(df).count() == 6001


def test_among_never_misses(spark):
    rows, keys = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 7)
    got = among(rows, "k", keys, 715).where("__q_in").select("k").toPandas().k
    assert set(range(0, 5000, 7)) <= set(got) and len(got) < 900


def brute_lines(rows):
    """(id, text) rows and the order of equal ids to what op6 leaves of them: every window against the first one equal in bytes."""
    seen, drop = {}, defaultdict(set)
    for at in sorted(rows):
        lines = rows[at].split("\n")
        for k in range(len(lines)):
            for n in (1, 2):
                key = tuple(lines[k : k + n])
                if len(key) < n or (n == 1 and len(key[0].split()) < 50 and len(key[0].encode()) < 300):
                    continue
                lead, first = seen.setdefault(key, (at, k))
                if (lead, first) != (at, k):
                    drop[at] |= {j for j in range(k, k + n) if lead != at or j >= first + n}
    return {at: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[at]) for at, t in rows.items()}


def check_lines(spark, docs, **kw):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    order = {(r["doc_id"], r["h"], r["text"]) for r in df.selectExpr("doc_id", "text", "xxhash64(doc_id, text) AS h").collect()}
    want = sorted({(i, kept) for (i, h), kept in brute_lines({(i, h): t for i, h, t in order}).items()})
    assert sorted({(r["doc_id"], r["text"]) for r in line_dedup.drop_repeated_chunks(df.repartition(3), **kw).collect()}) == want


def test_repeated_ids_keep_unique_text(spark):
    a, b = ["\n".join(f"{x} line {k}" for k in range(12)) for x in "ab"]
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.drop_repeated_chunks(spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")).collect())
    assert got == [(1, a), (2, ""), (2, b)]
    check_lines(spark, [(1, a), (2, a), (2, b), (2, b), (3, a + "\n" + b), (3, b + "\nown\n" + a), (3, "own\n" + b)])


def test_lines_of_random_texts_with_repeated_ids(spark):
    rng = np.random.default_rng(8)
    check_lines(spark, [(int(rng.integers(60)), "\n".join(f"line {x}" for x in rng.integers(0, 40, rng.integers(1, 9)))) for _ in range(300)])


def test_lines_with_one_hash_are_compared_by_bytes(spark):
    """One byte of hash: unlike lines meet all the time, and no unique line may go."""
    docs = [(k, "\n".join(f"doc {k} line {j}" for j in range(20))) for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_chunks(df, digest=1).collect()} == dict(docs)


def test_lines_edge_cases(spark, odd, none):
    rows = line_dedup.drop_repeated_chunks(odd).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"]: r["text"] for r in rows}[3] is None
    assert line_dedup.drop_repeated_chunks(none).count() == 0


def test_banding_follows_the_threshold():
    assert near_dedup.banding(80) == (32, 4)
    for percent in (5, 30, 50, 80, 95, 100):
        bands, rows = near_dedup.banding(percent)
        assert bands * rows <= 512 and (1 - (percent / 100) ** rows) ** bands <= near_dedup.MISS * 1.0001


def test_near_copies_at_other_thresholds(spark):
    rng = np.random.default_rng(11)
    docs = []
    for k in range(60):
        base = [f"b{k}-{j}" for j in range(60)]
        docs.append((4 * k, " ".join(base)))
        for c in range(1, 4):  # the first 60 - cut words, then others
            cut = int(rng.integers(1, 28))
            docs.append((4 * k + c, " ".join(base[: 60 - cut] + [f"o{k}-{c}-{j}" for j in range(cut)])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for percent in (50, 95):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, width=3, percent=percent).collect()}
        assert got == brute_components(docs, 3, percent)


def test_a_shared_template_gives_no_pairs(spark):
    """All documents share 300 words and differ in 200: none is a near copy, and the work must not grow with pairs."""
    template = " ".join(f"t{j}" for j in range(300))
    docs = [(k, template + " " + " ".join(f"o{k}-{j}" for j in range(200 if k % 50 else 20))) for k in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    near = spark.createDataFrame([(0, i, len(t.split()) - 3, i) for i, t in docs if i % 50], "a long, doc_id long, n long, comp long")
    assert near_dedup._across(near, df, 4, 80).count() == 0
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df, width=4).collect()}
    assert got == {i: 0 if i % 50 == 0 else i for i, _ in docs}


def template_rows(n, outliers):
    """``n`` documents of one component (183 common words and 17 own ones), and outliers that hold half of the common words."""
    common = [f"c{j}" for j in range(183)]
    rows = [(k, " ".join(common + [f"o{k}-{j}" for j in range(17)])) for k in range(n)]
    return rows + [(n + k, " ".join(common[:92] + [f"u{k}-{j}" for j in range(90)])) for k in range(outliers)]


def test_a_large_component_does_not_meet_itself(spark, monkeypatch):
    rows = template_rows(500, 20)
    seen = []
    real = near_dedup._met

    def watched(prefix, percent):
        by_key = {}
        for r in prefix.select("a", "t", "comp").collect():
            by_key.setdefault((r["a"], r["t"]), []).append(r["comp"])
        seen.append((sum(len(c) ** 2 for c in by_key.values()), sum((len(c) - max(map(c.count, set(c)))) * len(c) for c in by_key.values())))
        return real(prefix, percent)

    monkeypatch.setattr(near_dedup, "_met", watched)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, width=4).collect()}
    assert got == brute_components(rows, 4)
    assert all(rest < whole / 10 for whole, rest in seen if whole > 10_000)


def test_meetings_equal_all_pairs(spark):
    """What meets is what all rows of a key would have met, but for pairs of one component."""
    rng = random.Random(8)
    rows, sizes = [], {}
    for d in range(120):
        sizes[d] = rng.randrange(4, 9)
        for k in range(1, sizes[d] + 1):
            rows.append((0, rng.randrange(12), d, sizes[d], 0 if d < 70 else d % 7 + 1, k, [0] * (near_dedup.BITMAP // 64)))
    rows = list({(r[0], r[1], r[2]): r for r in rows}.values())
    df = spark.createDataFrame(rows, "a long, t long, doc_id long, n long, comp long, k int, bits array<long>")
    want = set()
    for x in rows:
        for y in rows:
            if x[1] == y[1] and x[4] != y[4] and (x[3], x[2]) < (y[3], y[2]):
                need = -(-(x[3] + y[3]) * 80 // 180)
                if x[5] <= x[3] - -(-x[3] * 160 // 180) + 1 and x[3] * 100 >= y[3] * 80 and min(x[3] - x[5], y[3] - y[5]) + 1 >= need:
                    want.add((min(x[2], y[2]), max(x[2], y[2])))
    got = {tuple(r) for r in near_dedup._met(near_dedup.stage(df, "prefix"), 80).collect()}
    assert got == want and len(want) > 20


def test_texts_are_read_three_times_for_sets_at_most(spark, monkeypatch):
    """Star, second look and meetings each read the texts of their documents; links among those that meet take the sets of the meetings."""
    reads, real = [], near_dedup.among
    monkeypatch.setattr(near_dedup, "among", lambda rows, *more, **named: (reads.append("text" in rows.columns), real(rows, *more, **named))[1])
    pair = lambda *_: near_dedup.stage(spark.createDataFrame([(0, 1)], "a long, b long"), "pairs")
    monkeypatch.setattr(near_dedup, "_again", pair)
    monkeypatch.setattr(near_dedup, "_met", pair)
    rows = template_rows(12, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()}
    assert got == brute_components(rows, 4) and sum(reads) <= 3


def test_tables_that_are_not_read_any_more_are_deleted(spark):
    from quire.llm import common

    before = set(os.listdir(common._root(spark))) if os.path.isdir(common._root(spark)) else set()
    rows = template_rows(12, 2)
    kept = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), width=4)
    assert {t.split("-")[0] for t in set(os.listdir(common._root(spark))) - before} == {"gone"}
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in brute_components(rows, 4).items() if c == i}


def test_rows_that_may_be_copies_shuffle_once(spark):
    texts = [(k, f"text {k % 7}" if k < 40 else f"own {k}") for k in range(60)]
    kept = exact_dedup.drop_copies(spark.createDataFrame(texts, "doc_id long, text string"))
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 4  # one with the hot groups, one with all, and the filter twice
    assert sorted(r["doc_id"] for r in kept.collect()) == [*range(33, 60)]
