import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from compare import DATA
from quire.llm import decontaminate, language_id, queries
from llm_brute import brute_components


def test_pipeline_against_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    judge = language_id.Judge(language_id.learn(spark.read.parquet(f"{DATA}/documents.parquet")))
    docs = {i: t for i, t in docs.items() if judge(t)[0] != "und"}
    last = {}
    for i in sorted(docs):
        last[docs[i]] = i
    docs = {i: docs[i] for i in last.values()}
    docs = {i: docs[i] for i, (_, c) in brute_components(sorted(docs.items()), 5).items() if c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    match = decontaminate.Matcher(items)
    docs = {i: t for i, t in docs.items() if not match(t)}
    library = Tokenizer.from_file(queries.vocabulary())
    want = {i: hashlib.sha256(np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes()).hexdigest() for i, t in docs.items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, DATA).collect()} == want


def test_stages_keep_columns_and_survive_odd_rows(spark, odd, none):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "decontamination", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    for docs in (odd, none):
        now = docs
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            now = f(spark, now, DATA)
            assert k == len(names) - 1 or now.columns == docs.columns
            f(spark, docs, DATA).count()
        now.count()
