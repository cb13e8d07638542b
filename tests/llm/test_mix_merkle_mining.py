"""Mixing, Merkle manifest and hard-negative mining against SQL and brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import connect, differences
from quire.llm import hard_negatives, merkle, mixing

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_mixing", "op12_merkle", "op13_hard_negatives"])
def test_same_as_sql(spark, name):
    ours, theirs = entry.queries()[name](spark, SMALL).toPandas(), connect(SMALL).execute(entry.oracle_sql()[name]).df()
    assert len(theirs) > 100
    assert differences(ours, theirs) == ([], [])


# --- mixing ------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    """By the rule as told: share by weight, stop what is above, share the excess again, until none is above."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    total, stopped = sum(sizes), set()
    while True:
        left = total - sum(most * sizes[k] for k in stopped)
        rest = sum(w[k] for k in range(len(sizes)) if k not in stopped)
        out = [float(most * s) if k in stopped else left * w[k] / rest for k, s in enumerate(sizes)]
        new = {k for k, s in enumerate(sizes) if k not in stopped and out[k] > most * s * (1 + 1e-12)}
        if not new:
            return out
        stopped |= new


def test_targets_are_shared_again_until_none_is_above(spark):
    for sizes in ([1, 100, 3], [5, 5, 5, 5], [1, 2, 3, 1000, 7, 90], [0, 4], [10], [1, 1, 1, 10**9]):
        sums = spark.createDataFrame([(f"s{k:03d}", 0, s) for k, s in enumerate(sizes)], "__q_src string, __q_b int, words long")
        got = [r["target"] for r in mixing.targets(sums, (5, 2, 1), 8).orderBy("__q_no").collect()]
        assert got == pytest.approx(brute_targets(sizes), rel=1e-12)


def test_permutation(spark):
    for n in (1, 2, 3, 100, 1000):
        for key in (0, 7, 10**9):
            got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(key).cast("long"))).collect()]
            assert sorted(got) == list(range(n))
    assert got != sorted(got)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_blocks_hold_what_is_taken(spark):
    texts = [(k, " ".join(f"w{k}_{j}" for j in range((k * 7) % 90)), None if k % 11 == 0 else f"src{k % 4}") for k in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string").repartition(3)
    mix = mixing.Mix(docs, block_words=16, shard_slots=20)
    taken = {r["doc_id"]: r for r in mix.taken().collect()}
    blocks = mix.blocks().collect()
    seen = Counter()
    for b in blocks:
        own = words(b["text"])
        assert len(own) == b["n_words"] <= 16
        seen.update(own)
    per_doc = Counter()
    for w, n in seen.items():
        assert n <= 3
        per_doc[int(w[1:].split("_")[0])] += n
    assert {k: per_doc[k] for k in taken} == {k: r["taken"] for k, r in taken.items()}
    by_source = defaultdict(int)
    for r in taken.values():
        by_source[r["source"]] += r["taken"]
    goal = {r["source"]: r["target"] for r in taken.values()}
    assert all(abs(by_source[s] - t) <= 0.5 for s, t in goal.items())
    assert list(goal) and sum(goal.values()) == pytest.approx(sum(r["size"] for r in taken.values()))
    slots = defaultdict(list)
    for b in blocks:
        slots[b["shard"]].append(b["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) > 5
    again = mixing.Mix(docs.repartition(5), block_words=16, shard_slots=20).blocks()
    key = lambda r: (r["shard"], r["slot"])
    assert sorted(blocks, key=key) == sorted(again.collect(), key=key)


def test_draws_follow_the_weights(spark):
    found = spark.createDataFrame([(0, 60000), (1, 30000), (2, 10000)], "__q_no long, __q_slots long")
    rows = mixing.draws(found, 1000, 3).collect()
    shards = defaultdict(dict)
    for r in rows:
        shards[r["shard"]][r["__q_no"]] = r["n"]
    assert len(shards) == 100 and all(sum(v.values()) == 1000 for v in shards.values())
    share = np.array([v[0] for v in shards.values()])
    assert abs(share.mean() - 600) < 8 and 8 < share.std() < 25  # a multinomial's: 15.5


def test_mixing_edge_cases(spark, odd, none):
    rows = mixing.Mix(odd).taken().collect()
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], len(words(r["text"]))) for r in odd.collect())
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == pytest.approx(sum(r["size"] for r in rows), abs=4)
    assert mixing.Mix(none).taken().count() == 0 and mixing.Mix(none).blocks().count() == 0
    empty = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in mixing.Mix(empty).taken().collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


# --- Merkle manifest -----------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """Levels from the leaves up to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[k : k + 3]) for k in range(0, len(last), 3)])
    return levels


def brute_manifest(rows):
    """{(id, leaf): (subroot, root, proof)} of (id, source, leaf) rows."""
    groups = defaultdict(list)
    for i, s, leaf in rows:
        groups[(s is not None, (s or "").encode())].append(((i is not None, i or 0), leaf))
    trees = [brute_tree([x[1] for x in sorted(groups[s])]) for s in sorted(groups)]
    top = brute_tree([t[-1][0] for t in trees])
    out = []

    def siblings(levels, k):
        found = []
        for level in levels[:-1]:
            first = k - k % 3
            found += [level[j] for j in range(first, min(first + 3, len(level))) if j != k]
            k //= 3
        return found

    for g, (s, levels) in enumerate(zip(sorted(groups), trees, strict=True)):
        for k, (i, leaf) in enumerate(sorted(groups[s])):
            out.append((i[1] if i[0] else None, leaf, levels[-1][0], top[-1][0], sha(*siblings(levels, k), *siblings(top, g))))
    return Counter(out)


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def check_manifest(docs, part_rows):
    rows = docs.collect()
    own = [(r["doc_id"], r["source"], sha(*(enc(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))) for r in rows]
    m = merkle.Manifest(docs, changed={"text": F.replace("text", F.lit("\n"), F.lit(""))}, part_rows=part_rows)
    got = m.proofs().collect()
    assert Counter((r["id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got) == brute_manifest(own)
    changed = Counter(leaf for (_, _, leaf), r in zip(own, rows, strict=True) if "\n" in (r["text"] or ""))
    assert Counter(r["leaf"] for r in got if not r["verified"]) == changed
    assert all(r["verified"] == (r["folded_root"] == m.root) for r in got)


def test_manifest_of_many_partitions(spark):
    rows = [(k * 7919 % 100003, ["a", "b", None, "é", "😀"][0 if k % 3 == 0 else k % 5], None if k % 4 else "en", k, f"text\n{k}" if k % 6 == 0 else f"t{k}") for k in range(900)]
    check_manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5), 7)


def test_manifest_edge_cases(spark, odd, none):
    check_manifest(odd, 20_000)
    check_manifest(odd, 2)
    assert merkle.Manifest(none).root is None and merkle.Manifest(none).proofs().count() == 0
    check_manifest(spark.createDataFrame([(1, "s", None, None, "x\ny")], "doc_id long, source string, lang string, n_chars long, text string"), 10)
    check_manifest(spark.createDataFrame([(k, f"s{k:03d}", None, k, "x") for k in range(100)], "doc_id long, source string, lang string, n_chars long, text string"), 6)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=6), st.randoms(use_true_random=False))
def test_merging_is_associative(sizes, random):
    leaves = {(t, 0, k): (n, sha(f"{t}/{k}")) for t, n in enumerate(sizes) for k in range(n)}
    expected = brute_tree([brute_tree([leaves[t, 0, k][1] for k in range(n)])[-1][0] for t, n in enumerate(sizes)])[-1][0]
    parts = [merkle.resolve({k: v}, len(sizes)) for k, v in leaves.items()] + [{}]
    random.shuffle(parts)
    while len(parts) > 1:  # any two fragments, in any order
        a, b = parts.pop(random.randrange(len(parts))), parts.pop(random.randrange(len(parts)))
        parts.append(merkle.merge([a, b], len(sizes)))
    assert [v[1] for v in parts[0].values()] == [expected]


def test_a_run_of_rows_keeps_few_nodes():
    leaves = {(0, 0, k): (100_000, str(k)) for k in range(31_111, 64_444)}
    assert len(merkle.resolve(leaves, 1)) <= 4 * math.ceil(math.log(100_000, 3))


# --- hard negatives --------------------------------------------------------------------


def brute_mining(rows, positives=5, negatives=3):
    """rows: (id, label, integers)."""
    out = []
    for i, label, a in rows:
        if i % 50:
            continue
        score = [(-sum(x * y for x, y in zip(a, b)), j, m) for j, m, b in rows if j != i]  # short vectors: zeros
        for p, j, _ in sorted(s for s in score if s[2] == label)[:positives]:
            able = sorted(s for s in score if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p)[:negatives]
            out += [(i, j, k + 1, s[1], -p, -s[0]) for k, s in enumerate(able)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["clusters", "copies", "random"])
def test_mining_equals_brute_force(spark, kind):
    rng = np.random.default_rng(5)
    n, dim = 600, 12
    mid = rng.normal(size=(10, dim))
    x = {"clusters": mid[rng.integers(0, 10, n)] + 0.05 * rng.normal(size=(n, dim)), "random": rng.normal(size=(n, dim)), "copies": np.repeat(mid, 60, axis=0)}[kind]
    labels = rng.integers(0, 3, n)
    data = [(int(k), [float(v) for v in x[k]], int(labels[k])) for k in range(n)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(4)
    expected = brute_mining([(k, m, [math.floor(256 * v) for v in e]) for k, e, m in data])
    for first, block in ((1, 16), (8, 2048)):
        got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, first=first, block_rows=block, sample=200)
        assert sorted(tuple(r) for r in got.collect()) == expected
    assert expected or kind == "copies"


def test_bounds_hold_and_skip():
    rng = np.random.default_rng(3)
    mid = rng.normal(size=(8, 16)) * 1000
    x = np.floor(np.repeat(mid, 50, axis=0) + rng.normal(size=(400, 16)) * 20).astype(np.int64)
    c = hard_negatives.centroids(x[rng.permutation(400)], 8)
    near = hard_negatives._nearest(x.astype(float), c)
    radii = np.array([np.sqrt(((x[near == k] - c[k]) ** 2).sum(axis=1)).max(initial=0) for k in range(8)])
    upper, lower = hard_negatives.Bounds(16, c, radii, np.bincount(near, minlength=8)).of(x[:20])
    s = x[:20] @ x.T
    for k in range(8):
        if (near == k).any():
            assert (s[:, near == k] <= upper[:, k, None]).all() and (s[:, near == k] >= lower[:, k, None]).all()
    kth = np.sort(s, axis=1)[:, -5]
    assert (upper < kth[:, None]).mean() > 0.5  # most lists are skipped


def test_mining_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1, "x"), (50, [1.0], 1, None), (100, [], 2, "y"), (1, [0.9, 0.4], 1, "x"), (2, [0.8, 0.3], 2, "x"), (3, [nan, 1.0], 1, "x"), (4, [inf, 1.0], 2, "x"), (5, [None, 1.0], 2, "x"), (6, None, 2, "x"), (7, [1.0, 0.5], None, "x"),
        (None, [1.0, 0.5], 1, "x"), (8, [0.8, 0.3], 2, "x"), (9, [0.8, 0.3], 2, "x"), (10, [-1.0, -0.5], 1, "x"), (1, [0.9, 0.4], 1, "x"), (11, [0.7, 0.2], 3, None),
    ]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, label int, w string, list int, rank int, score long")
    got = sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0).collect())
    kept = {r[0]: (r[0], r[2], [math.floor(256 * v) for v in r[1]]) for r in rows if None not in (r[0], r[1], r[2]) and all(v is not None and math.isfinite(v) for v in r[1])}
    assert got == brute_mining(list(kept.values())) and len(got) > 3
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
