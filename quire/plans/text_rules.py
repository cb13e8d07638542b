"""Row rules over lines of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.plans.tables import LINES_SQL, lines, q, s_any_contains, s_count, s_has, s_in, s_last_word, s_natural, s_norm, s_words

KEYS = ["doc_id", "line_no"]

# --- SQL forms of the predicates, over an SQL expression ---------------------------


def s_url(t: str) -> str:
    e = f"trim({t}, {q(T.EDGE_PUNCTUATION)})"
    return f"({e} <> '' AND NOT {s_has(e, r'\s')} AND {s_has(e, T.URL_LIKE)})"


def s_email(t: str) -> str:
    return s_has(f"trim({t}, {q(T.EDGE_PUNCTUATION)})", f"^(?:{T.EMAIL})$")


def s_copyright(t: str) -> str:
    low = f"lower({t})"
    return f"({t} <> '' AND length({t}) <= 220 AND {s_count(t, T.EN_WORD)} <= 32 AND {s_has(t, T.COPYRIGHT_TAIL)} AND {s_any_contains(low, T.COPYRIGHT_SIGNALS)} AND NOT {s_any_contains(low, T.DISCLAIMERS)})"


def s_metadata(t: str) -> str:
    return f"({t} <> '' AND ({s_url(t)} OR {s_email(t)} OR {s_copyright(t)}))"


def s_entry(t: str) -> str:
    commas, year, doi, journal, pages = s_count(t, "[,;]"), s_has(t, T.YEAR), s_has(t, T.DOI), s_has(t, T.JOURNAL), s_has(t, T.PAGE_RANGE)
    led = f"({s_has(t, T.REF_INDEX)} OR {s_has(t, T.AUTHOR_START)})"
    return f"({t} <> '' AND (({doi} AND ({year} OR {commas} >= 1)) OR ({led} AND ({year} OR {doi} OR {journal} OR {pages} OR {commas} >= 2)) OR ({year} AND ({journal} OR {pages}) AND {commas} >= 1)))"


def s_code(t: str) -> str:
    tokens = f"string_split({t}, ' ')"
    code = " OR ".join(s_has("x", p) for p in (T.INDEXED_SYMBOL, T.FORTRAN_FLOAT, T.CODE_OPERATOR, T.ALL_CAPS_CODE)) + f" OR contains(x, '_') OR ({s_has('x', '[A-Za-z]')} AND {s_has('x', r'\d')})"
    codeish = f"len(list_filter({tokens}, lambda x: {code}))"
    upper = f"{s_count(t, r'\p{Lu}')} / greatest(1, {s_count(t, r'\p{L}')})"
    dense = f"({s_natural(t)} <= 4 OR ({upper} >= 0.55 AND NOT {s_has(t, T.PROSE_CUE)}) OR {s_count(t, T.CODE_OPERATOR)} >= greatest(6, length({t}) // 18))"
    return f"(length({t}) >= 24 AND NOT {s_has(t, '[一-鿿]')} AND len({tokens}) BETWEEN 2 AND 64 AND (({s_has(t, T.FORTRAN_LOOP)} AND {codeish} >= 2) OR ({codeish} >= greatest(3, len({tokens}) // 2) AND {dense})))"


def s_prose(raw: str) -> str:
    t = f"trim(regexp_replace(coalesce({raw}, ''), {q(T.PLACEHOLDER)}, ' ', 'g'))"
    linked = f"(contains({t}, '@') OR contains({t}, 'http://') OR contains({t}, 'https://') OR {s_url(t)})"
    return f"({t} <> '' AND NOT {s_code(s_norm(t))} AND NOT {linked} AND {s_count(t, T.EN_WORD)} >= 8 AND {s_count(t, r'\p{L}')} >= 30)"


def s_starts(t: str) -> str:
    return f"({t} <> '' AND ({s_has(t, '^[a-z]')} OR {s_in(s_last_word(f'left({t}, 32)'), T.CONTINUATION_STARTS)}))"


def s_ends(t: str) -> str:
    return f"({t} <> '' AND (ends_with({t}, '-') OR (NOT {s_has(t, '[.!?:;]$')} AND {s_in(s_last_word(t), T.CONTINUATION_ENDS)})))"


def _select(columns: Callable[[F.Column], dict[str, F.Column]]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lines(spark, sf_dir).select(*KEYS, *[v.alias(k) for k, v in columns(F.col("text")).items()])

    return run


def _sql(columns: dict[str, str]) -> str:
    return f"WITH {LINES_SQL}, n AS (SELECT *, {s_norm('text')} AS t FROM lines) SELECT doc_id, line_no, " + ", ".join(f"{v} AS {k}" for k, v in columns.items()) + " FROM n"


_low = "replace(lower(t), '&', ' and ')"
_heading = f"trim(regexp_replace(regexp_replace({_low}, '[^a-z ]+', ' ', 'g'), ' +', ' ', 'g'))"
_plain = f"trim(regexp_replace(coalesce(text, ''), {q(T.PLACEHOLDER)}, ' ', 'g'))"
_weird = r"[^\s\p{L}\p{N}.,;:!?()\[\]{}'\"_/+*&%$#=@-]"
_segments = f"list_filter(list_transform(regexp_split_to_array(replace({_plain}, ' and ', ', '), ',|;|\\band\\b'), lambda s: trim(s, ' *†‡§,;')), lambda s: s <> '')"
#: The letters of names outside ASCII as letters inside, so that DuckDB's word edges hold.
_plainly = lambda s: s_words(f"regexp_replace(regexp_replace({s}, '[À-ÖØ-Þ]', 'A', 'g'), '[ß-öø-ÿ]', 'a', 'g')")
_named = f"len(list_filter({_segments}, lambda s: len(regexp_extract_all({_plainly('s')}, {q(T.AUTHOR_NAME)})) BETWEEN 2 AND 5))"

_RULES: dict[str, tuple[Callable[[F.Column], dict[str, F.Column]], dict[str, str]]] = {
    "reference_headings": (
        lambda c: {"normalized": T.normalize_reference_heading(c), "is_heading": T.is_reference_heading(c)},
        {"normalized": _heading, "is_heading": s_in(_heading, T.REFERENCE_HEADINGS)},
    ),
    "reference_entries": (
        lambda c: {"is_entry": T.is_reference_entry(c), "is_continuation": T.is_reference_continuation(c)},
        {
            "is_entry": s_entry("t"),
            "is_continuation": f"(t <> '' AND ({s_has('t', r'^[a-z(\\\[\"' + chr(39) + r'`\)\],.;:]')} OR {s_has('t', T.DOI)} OR {s_has('t', T.JOURNAL)} OR {s_has('t', T.PAGE_RANGE)} OR ({s_has('t', T.YEAR)} AND ({s_count('t', ',')} >= 1 OR length(t) <= 240))))",
        },
    ),
    "metadata_fragments": (
        lambda c: {"is_url": T.is_url_fragment(T.normalize_text(c)), "is_email": T.is_email_fragment(T.normalize_text(c)), "is_copyright": T.is_short_copyright_tail(c), "is_metadata": T.is_hard_metadata(c)},
        {"is_url": s_url("t"), "is_email": s_email("t"), "is_copyright": s_copyright("t"), "is_metadata": s_metadata("t")},
    ),
    "code_literals": (lambda c: {"is_code": T.is_code_literal(c), "natural_words": T.natural_word_count(T.normalize_text(c)).cast("long")}, {"is_code": s_code("t"), "natural_words": f"{s_natural('t')}::BIGINT"}),
    "english_prose": (lambda c: {"is_prose": T.is_english_prose(c), "n_words": T.english_word_count(c).cast("long")}, {"is_prose": s_prose("text"), "n_words": f"{s_count('text', T.EN_WORD)}::BIGINT"}),
    "cjk_dominance": (
        lambda c: {"zh_chars": T.zh_char_count(c).cast("long"), "is_dominant": T.is_cjk_dominant(c)},
        {
            "zh_chars": f"{s_count('text', '[一-鿿]')}::BIGINT",
            "is_dominant": f"(length(t) >= 16 AND {s_count('t', '[一-鿿]')} >= 10 AND {s_count('t', '[一-鿿]')} >= 2 * {s_count('t', '[A-Za-z]')} AND {s_count('t', '[一-鿿]')} >= 2 * {s_count('t', T.EN_WORD)})",
        },
    ),
    "garbled_fragments": (
        lambda c: {"is_garbled": T.is_garbled(c), "is_short": T.is_short_fragment(c)},
        {
            "is_garbled": f"({_plain} = '' OR contains({_plain}, '�') OR {s_count(_plain, _weird)} / greatest(1, {s_count(_plain, r'\S')}) > 0.35)",
            "is_short": s_has("trim(text)", T.SHORT_FRAGMENT),
        },
    ),
    "math_balance": (
        lambda c: {"is_balanced": T.has_balanced_math(c), "n_placeholders": F.size(T.placeholder_sequence(c)).cast("long")},
        {"is_balanced": f"({s_count('text', r'\$')} - {s_count('text', r'\\\$')}) % 2 = 0", "n_placeholders": f"{s_count('text', T.PLACEHOLDER)}::BIGINT"},
    ),
    "protocol_shells": (
        lambda c: {"is_shell": T.is_protocol_shell(c)},
        {
            "is_shell": f"(trim(text) <> '' AND ((length(trim(text)) <= {T.PROMPT_ECHO_CHARS} AND {s_has('trim(text)', T.PROMPT_ECHO)}) OR (starts_with(trim(text), '{{') AND {s_any_contains('text', ['\"translated_text\"', '\"translations\"', '“translated_text”', '“translations”'])})))"
        },
    ),
    "author_lists": (
        lambda c: {"is_authors": T.is_author_list(c)},
        {"is_authors": f"({_plain} <> '' AND length({_plain}) <= 240 AND NOT {s_any_contains(_plain, ['@', 'http://', 'https://'])} AND len({_segments}) >= 3 AND {_named} >= greatest(3, len({_segments}) - 1))"},
    ),
    "continuation_signals": (
        lambda c: {
            "starts_on": T.starts_like_continuation(c), "ends_open": T.ends_like_continuation(c), "starts_heading": T.starts_like_heading_or_list(c),
            "suspicious": T.last_token_is_suspicious(T.normalize_text(c)), "last_word": T.last_word(T.normalize_text(c)),
        },
        {"starts_on": s_starts("t"), "ends_open": s_ends("t"), "starts_heading": s_has("t", T.HEADING_START), "suspicious": s_in(s_last_word("t"), T.SUSPICIOUS_ENDS), "last_word": s_last_word("t")},
    ),
    "text_previews": (
        lambda c: {"preview": T.preview_text(c), "chunk_words": F.concat_ws(",", F.transform(T.english_chunk_word_lengths(c), lambda n: n.cast("string")))},
        {
            "preview": "CASE WHEN length(t) <= 220 THEN t ELSE rtrim(left(t, 219)) || '…' END",
            "chunk_words": f"array_to_string(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), {q(T.EN_CHUNK)}), lambda r: len(regexp_extract_all(r, {q(T.EN_WORD)}))), lambda n: n > 0), ',')",
        },
    ),
}


def block_policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of all lines by language: the flagship query."""
    from quire.plans.tables import table

    langs, c = table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("text")
    # normalised once, code rules evaluated once
    t = F.col("t")
    rules = {"empty": t == "", "reference_heading": T.is_reference_heading(t, clean=True), "metadata": T.is_hard_metadata(t, clean=True), "reference": T.is_reference_entry(t, clean=True), "code": F.col("code"), "prose": T.is_english_prose(t, code=F.col("code"))}
    label = F.coalesce(*[F.when(v, k) for k, v in rules.items()], F.lit("other"))
    labelled = lines(spark, sf_dir).withColumn("t", T.normalize_text(c)).withColumn("code", T.is_code_literal(t, clean=True)).withColumn("label", label)
    # counts by document first, so that what meets the languages is small
    counts = labelled.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    return counts.join(langs, "doc_id", "left").groupBy(F.coalesce("lang", F.lit("none")).alias("lang"), "label").agg(F.sum("n").alias("n_lines"), F.sum("chars").alias("n_chars"))


QUERIES = {name: _select(columns) for name, (columns, _) in _RULES.items()} | {"block_policy_summary": block_policy_summary}
SQL = {name: _sql(columns) for name, (_, columns) in _RULES.items()} | {
    "block_policy_summary": f"""WITH {LINES_SQL}, n AS (SELECT *, {s_norm("text")} AS t FROM lines), l AS (
        SELECT doc_id, text, CASE WHEN t = '' THEN 'empty' WHEN {s_in(_heading, T.REFERENCE_HEADINGS)} THEN 'reference_heading' WHEN {s_metadata("t")} THEN 'metadata' WHEN {s_entry("t")} THEN 'reference'
               WHEN {s_code("t")} THEN 'code' WHEN {s_prose("text")} THEN 'prose' ELSE 'other' END AS label FROM n)
        SELECT coalesce(d.lang, 'none') AS lang, label, count(*) AS n_lines, sum(length(l.text))::BIGINT AS n_chars FROM l LEFT JOIN documents d USING (doc_id) GROUP BY 1, 2"""
}
