"""op6 against planted passages of one to five lines and against all windows of two lines, not against chunks()."""

from collections import defaultdict

import numpy as np

from compare import DATA
from quire.llm import line_dedup, queries


def test_planted_passages_go_whole(spark):
    rng = np.random.default_rng(3)
    texts, planted = [[f"own {d} line {k} {rng.integers(1 << 40)}" for k in range(12)] for d in range(200)], defaultdict(list)
    for p in range(100):
        size = p % 5 + 1
        passage = [f"passage {p} line {k} " + " ".join(f"w{x}" for x in rng.integers(0, 999, 50 if size == 1 else 6)) for k in range(size)]
        for d in rng.choice(200, 20, replace=False).tolist():
            planted[p].append(d)
            texts[d].append(passage)
    docs = []
    for d, parts in enumerate(texts):
        flat = [parts[k] for k in rng.permutation(len(parts))]
        docs.append((d, "\n".join(y for x in flat for y in (x if isinstance(x, list) else [x]))))
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_chunks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    first = {p: min(ds) for p, ds in planted.items()}
    for d, text in docs:
        want = [x for x in text.split("\n") if x.startswith("own") or first[int(x.split()[1])] == d]
        assert got[d]["text"].split("\n") == want and got[d]["n_removed"] == text.count("\n") + 1 - len(want)


def test_all_windows_of_the_table(spark):
    docs = dict(tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    seen, drop = {}, defaultdict(set)
    for i in sorted(docs):
        lines = docs[i].split("\n")
        long = [len(x.split()) >= 50 or len(x.encode()) >= 300 for x in lines]
        for k in range(len(lines)):
            for n in (1, 2):
                key = tuple(lines[k : k + n])
                if len(key) == n and (n == 2 or long[k]):
                    d0, k0 = seen.setdefault(key, (i, k))
                    if (d0, k0) != (i, k):
                        drop[i] |= {j for j in range(k, k + n) if d0 != i or j >= k0 + n}
    for r in queries.op6_line_dedup(spark, DATA).collect():
        lines = docs[r["doc_id"]].split("\n")
        assert r["text"] == "\n".join(x for k, x in enumerate(lines) if k not in drop[r["doc_id"]]) and r["n_removed"] == len(drop[r["doc_id"]])
    assert any(drop.values())


def test_a_line_said_again_and_again(spark):
    docs = [(1, "x\nx\nx\nx\ny"), (2, "a\nx\ny\nb"), (3, "short\nz"), (4, "short\nv")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_chunks(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "x\nx\ny", 2: "a\nb", 3: "short\nz", 4: "short\nv"}
