"""The registered queries of this subpackage: each applies an operator, with production parameters, to its whole table."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, chat, decontaminate, exact_dedup, hard_negatives, language_id, line_dedup, merkle, mixing, near_dedup, pii, sharding, toxicity
from quire.llm.common import read, stage


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file; QUIRE_TOKENIZERS names another folder."""
    folder = os.environ.get("QUIRE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), vocabulary())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"), 4, 2)
    profiles = language_id.learn(docs.where(~held))
    return language_id.predict(docs, profiles).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"), 3, 1)
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held)
    lexicon = toxicity.learn(docs, labels)
    return toxicity.score(docs, lexicon).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_chunks(read(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read(spark, sf_dir, "documents"), os.environ.get("QUIRE_PII_KEY", "not a secret: set QUIRE_PII_KEY").encode())


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=4)


#: The extra conversation of op9.
EXTRA = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _chat_digests(batches):
    """Rows are read one after the other, their lists as arrays: a batch of lists as Python objects takes many times its size."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        ids, texts, *lists = (batch.column(c) for c in ("conv_id", "formatted", "mask", "starts", "ends"))
        out = []
        for k, conv in enumerate(ids.to_pylist()):
            formatted = texts[k].as_py()
            turns = chat.parse(formatted)
            loss = chat.masked_text(formatted, *(x[k].values.to_numpy() for x in lists))
            out.append((conv, len(turns), sha("".join(f"{role}\n{text}\n" for role, text, _, _ in turns)), len(loss), sha(loss), len(formatted)))
        if out:
            c = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2]), pa.array(c[3], pa.int64()), pa.array(c[4]), pa.array(c[5], pa.int64())], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = turns.unionByName(spark.createDataFrame(EXTRA, turns.schema))
    formatted = chat.format_chats(both, vocabulary())
    digests = formatted.mapInArrow(_chat_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    # staged, since only so the batches between the two workers are small; a row is a few hundred bytes
    return stage(digests, "chats")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), shards=8)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(read(spark, sf_dir, "documents"), keep_text=False).taken().drop("source")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.Manifest(read(spark, sf_dir, "documents"), changed={"text": tampered}).proofs().withColumnRenamed("id", "doc_id").drop("source")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_bpe, op3_language_id, op4_exact_dedup, op5_toxicity, op6_line_dedup, op7_pii, op8_near_dedup, op9_chat, op10_sharding, op11_mixing, op12_merkle, op13_hard_negatives, pipeline)
}


def _sc(v: str, key: str) -> str:
    """``mixing.scattered`` in SQL."""
    u = f"((({v}) & 2147483647) * 48271 + ((({v}) >> 31) % 2147483647) * 69621 + (({key}) % 2147483647) * 40692) % 2147483647"
    return f"((({u}) * ({u}) + 12345) % 2147483647)"


#: The mix by sources: full passes take each word once, the last pass the first blocks of its permutation.
MIXING_SQL = rf"""
    WITH RECURSIVE sized AS (
        SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS src, {_sc("doc_id", "5")} % 256 AS b FROM documents
    ), sources AS (
        SELECT *, source_size * 3 AS cap, source_size * 3 / w AS cap_w FROM (
            SELECT src, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY src) - 1 AS no, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM sized GROUP BY src)
    ), levels AS (
        SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap_w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
               / sum(w) OVER (ORDER BY cap_w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM sources
    ), goals AS (
        SELECT *, round(target)::BIGINT AS t, source_size // 256 AS f FROM (SELECT *, least(cap::DOUBLE, w * max(lev) OVER ()) AS target FROM levels)
    ), rest AS (
        SELECT *, CASE WHEN source_size > 0 THEN t // source_size ELSE 0 END AS passes FROM goals
    ), last_slots AS (
        SELECT src, no, f, source_size, passes, t - passes * source_size AS r, no * 1009 + passes * 97 + 11 AS key, unnest(range((t - passes * source_size + 255) // 256)) AS i FROM rest
    ), perm AS (
        SELECT src, i, f AS n, key, i AS x, 0 AS r FROM last_slots WHERE i < f
        UNION ALL
        SELECT src, i, n, key, CASE WHEN {_sc("greatest(x, other)", "key + r + 2")} % 2 = 1 THEN other ELSE x END, r + 1
        FROM (SELECT *, ((k - x) % n + n) % n AS other FROM (SELECT *, ({_sc("r", "key")} * 2147483647 + {_sc("r", "key + 1")}) % n AS k FROM perm WHERE r < 24))
    ), cut AS (
        SELECT s.src, coalesce(p.x, s.f) * 256 AS first, least(CASE WHEN s.i < s.f THEN 256 ELSE s.source_size - s.f * 256 END, s.r - s.i * 256) AS words
        FROM last_slots s LEFT JOIN perm p ON p.src = s.src AND p.i = s.i AND p.r = 24
    ), placed AS (
        SELECT *, sum(size) OVER (PARTITION BY src ORDER BY b, doc_id) - size AS start FROM sized
    ), more AS (
        SELECT p.doc_id, sum(least(p.start + p.size, c.first + c.words) - greatest(p.start, c.first)) AS words
        FROM placed p JOIN cut c ON p.src = c.src AND p.start < c.first + c.words AND c.first < p.start + p.size GROUP BY p.doc_id
    )
    SELECT p.doc_id, p.size, g.source_size, g.target, (g.passes * p.size + coalesce(m.words, 0))::BIGINT AS taken
    FROM placed p JOIN rest g ON g.src = p.src LEFT JOIN more m ON m.doc_id = p.doc_id"""


#: Trees level by level; the fold of a proof is a recursion over the levels of a row's path.
MERKLE_SQL = """
    WITH RECURSIVE docs AS (
        SELECT *, chr(10) AS nl, coalesce(octet_length(source::BLOB) || ':' || source, '-') AS s, coalesce(octet_length(lang::BLOB) || ':' || lang, '-') AS l,
               coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS n, coalesce(length(doc_id::VARCHAR) || ':' || doc_id, '-') AS d,
               CASE WHEN list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS tampered
        FROM documents
    ), leaves AS (
        SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS size,
               sha256(d || s || l || n || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(d || s || l || n || coalesce(strlen(tampered) || ':' || tampered, '-')) AS bad FROM docs
    ), sub AS (
        SELECT source, 0 AS level, i, size, leaf AS h FROM leaves
        UNION ALL SELECT source, level + 1, i // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM sub WHERE size > 1 GROUP BY source, level, i // 3, size
    ), subroots AS (
        SELECT source, level AS height, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS no, count(*) OVER () AS groups FROM sub WHERE size = 1
    ), top AS (
        SELECT 0 AS level, no AS i, groups AS size, subroot AS h FROM subroots
        UNION ALL SELECT level + 1, i // 3, (size + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE size > 1 GROUP BY level, i // 3, size
    ), nodes AS (
        SELECT source, false AS upper, level, i, h FROM sub UNION ALL SELECT NULL, true, level, i, h FROM top
    ), runs AS (
        SELECT upper, CASE WHEN upper THEN NULL ELSE source END AS source, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM nodes GROUP BY ALL
    ), steps AS (
        SELECT l.doc_id, k, k >= r.height AS upper, CASE WHEN k < r.height THEN l.source END AS source, CASE WHEN k < r.height THEN k ELSE k - r.height END AS level,
               CASE WHEN k < r.height THEN l.i // (3 ** k)::BIGINT ELSE r.no // (3 ** (k - r.height))::BIGINT END AS i
        FROM (SELECT l.*, unnest(range(r.height + (SELECT max(level) FROM top))) AS k FROM leaves l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source) l
        JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source
    ), paths AS (
        SELECT s.doc_id, s.k, array_to_string(hs[:(s.i % 3)], '') AS before, array_to_string(hs[(s.i % 3 + 2):], '') AS after
        FROM steps s JOIN runs r ON r.upper = s.upper AND r.source IS NOT DISTINCT FROM s.source AND r.level = s.level AND r.run = s.i // 3
    ), folded AS (
        SELECT doc_id, 0 AS k, bad AS h FROM leaves UNION ALL SELECT f.doc_id, f.k + 1, sha256(p.before || f.h || p.after) FROM folded f JOIN paths p ON p.doc_id = f.doc_id AND p.k = f.k
    ), proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY k)) AS proof, max(k) + 1 AS n FROM paths GROUP BY doc_id)
    SELECT l.doc_id, l.leaf, r.subroot, t.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
    FROM leaves l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source JOIN (SELECT h FROM top WHERE size = 1) t ON true
    LEFT JOIN proofs p ON p.doc_id = l.doc_id JOIN folded f ON f.doc_id = l.doc_id AND f.k = coalesce(p.n, 0)"""


HARD_NEGATIVES_SQL = """
    WITH rows AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scores AS (
        SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
    ), positives AS (
        SELECT a, b AS p, s AS ps FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
    )
    SELECT p.a AS anchor_id, p.p AS positive_id, row_number() OVER w AS rank, n.b AS negative_id, p.ps AS positive_score, n.s AS negative_score
    FROM positives p JOIN scores n ON n.a = p.a AND NOT n.same AND 50 * p.ps <= 100 * n.s AND 100 * n.s <= 95 * p.ps
    WINDOW w AS (PARTITION BY p.a, p.p ORDER BY n.s DESC, n.b) QUALIFY row_number() OVER w <= 3"""

ORACLE_SQL = {
    "op13_hard_negatives": HARD_NEGATIVES_SQL,
    "op12_merkle": MERKLE_SQL,
    "op11_mixing": MIXING_SQL,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)""",
    "op9_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), sized AS (
            SELECT *, length(regexp_replace(role, ctl, '\0+', 'g')) + length(regexp_replace(text, ctl, '\0+', 'g')) + 8 + 8 + 7 AS chars
            FROM turns, (SELECT '\\|<\|turn\|>|<\|text\|>|<\|end\|>|<\|endoftext\|>|<\|startoftext\|>|<\|im_start\|>|<\|im_end\|>|</?s>|\[/?INST\]|<</?SYS>>' AS ctl)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM sized GROUP BY conv_id""",
}
