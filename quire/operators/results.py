"""Batches and their results, risk of formula texts, forced and kept texts, stale jobs: native Columns and DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.spans import CONNECTORS, SLOT
from quire.operators.hints import risk_phrases
from quire.operators.outputs import let

# --- fixed values ------------------------------------------------------------
TERM_EDGES, TERM_CHARS = " ,.;:()[]{}，。；：（）【】", 80
WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
BRACKET_CITATION = r"^\[\s*\d+[A-Za-z]?(?:\s*[-,]\s*\d+[A-Za-z]?)*\s*\]$"
SUPERSCRIPT_CITATION = r"^\^\{\s*\d+[A-Za-z]?(?:\s*[-,]\s*\d+[A-Za-z]?)*\s*\}$"
SYMBOLIC_LINE = r"^(?:[$>#]|[-*]\s+|\|[-\p{L}\p{N}_ .]+|[A-Za-z_][\p{L}\p{N}_.-]*\s*=)"
ASSIGNMENT = r"^\s*(?:[$>#]\s*[\p{L}\p{N}_]+|[A-Za-z_][\p{L}\p{N}_.-]*\s*=\s*\S+)"
FIELD_VALUE = r"(?:^|[^\p{L}\p{N}_])(?:Default|Type|Input|Output|Usage|Example)\s*:\s*\\?<?[A-Z0-9_./-]+>?\z"
MIXED_CHARS, MIXED_WORDS, MIXED_LONG, MIXED_CUES, MIXED_SYMBOLS = 48, 8, 5, 2, 0.28
ROUTE_RISK, ROUTE_SLOTS, ROUTE_SEGMENTS, ROUTE_MOST_SLOTS = 6, 4, 16, 24
SPLIT_SLOTS, SPLIT_CHARS, SPLIT_DENSITY = 16, 1200, 0.016
NO_PID = "后端启动时发现遗留 running 任务，但未记录 worker pid"
DEAD_PID = ("后端启动时发现遗留 running 任务，但 worker 进程 ", " 已不存在")
# -----------------------------------------------------------------------------
_BLANKS = " \t\n\r\x0b\x0c"
_MICRO_WORD = r"[a-z]+(?:[-'][a-z]+)?"


# --- scalars -----------------------------------------------------------------------


def clean_term_key(c: Column) -> Column:
    return F.left(F.btrim(T.normalize_text(c), F.lit(TERM_EDGES)), F.lit(TERM_CHARS))


def escape_string(c: Column) -> Column:
    """As the inside of a quoted string: backslashes, quotes and line ends escaped."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
        c = F.replace(c, F.lit(raw), F.lit(escaped))
    return c


def is_citation(c: Column) -> Column:
    """Numbers in brackets, or as a superscript.  The repeated group is possessive: Java would walk it by recursion."""
    t = T.normalize_text(c)
    return t.rlike(BRACKET_CITATION.replace(")*", ")*+")) | t.rlike(SUPERSCRIPT_CITATION.replace(")*", ")*+"))


def density_ratio(source: Column, output: Column) -> Column:
    """CJK signs of an output for each word of its source; 0 where either has none."""
    words = F.regexp_count(T.strip_placeholders(source), F.lit(WORD.replace(")*", ")*+")))
    return F.when(words > 0, T.zh_char_count(T.strip_placeholders(output)) / words).otherwise(0.0)


def is_preserve_candidate(c: Column) -> Column:
    """Commands, assignments, field values, or lines of which at least half look so."""
    t = F.btrim(F.coalesce(c, F.lit("")), F.lit(_BLANKS))
    lines = F.filter(F.transform(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")
    n, symbolic = F.size(lines), F.size(F.filter(lines, lambda x: x.rlike(SYMBOLIC_LINE)))
    return (t != "") & (((n >= 2) & (symbolic >= F.greatest(F.lit(1), F.floor(n / 2)))) | t.rlike(ASSIGNMENT) | t.rlike(FIELD_VALUE))


# --- forced and kept texts ------------------------------------------------------------


def force_mixed_literal(c: Column, bodylike: Column) -> Column:
    """Body text that is prose in spite of its literals: it has to be translated."""
    t = T.normalize_text(c)
    long_words = F.size(F.filter(T.words(t), lambda w: F.length(w) >= 4))
    symbols = F.length(t) - F.length(F.translate(t, "=<>+-*/()[]{}", ""))
    sized = (F.length(t) >= MIXED_CHARS) & (T.english_word_count(t) >= MIXED_WORDS) & (long_words >= MIXED_LONG)
    return bodylike & sized & (T.natural_word_count(t) >= MIXED_WORDS) & (symbols / F.length(t) < MIXED_SYMBOLS) & (F.regexp_count(t, F.lit(T.edged(T.PROSE_CUE))) >= MIXED_CUES)


def force_body(c: Column, bodylike: Column, grouped: Column, with_formulas: Column) -> Column:
    """Body prose that has to be translated: 8 words, 6 in a group, 5 with formulas.  Whether it is code is asked of what its placeholders leave."""
    words = T.english_word_count(T.strip_placeholders(c))
    least = F.when(grouped, 6).when(with_formulas, 5).otherwise(8)
    return bodylike & (F.trim(F.coalesce(c, F.lit(""))) != "") & ~T.is_garbled(c) & ~T.is_short_fragment(c) & (words >= least) & T.is_english_prose(c)


def is_no_translation_code(c: Column) -> Column:
    """Code, a prompt or path at the start, or two lines or more that begin like a shell's or a table's."""
    t = T.normalize_text(c)
    led = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x.rlike("^[|$>-]"))
    start = t.startswith("$ ") | t.startswith("> ") | t.startswith("./") | t.startswith("../")
    return (t != "") & (start | (F.size(led) >= 2) | T.is_code_literal(t, clean=True))


# --- risk and routes of texts with formulas ----------------------------------------------


def _is_micro(t: Column) -> Column:
    """A segment of connectors only (``t``: normalised, lower case)."""
    link = lambda w: w.isin(*sorted(CONNECTORS))

    def decide(w: Column) -> Column:
        n, every = F.size(w), F.forall(w, link)
        ends = F.coalesce(link(F.get(w, F.lit(0))) | link(F.try_element_at(w, F.lit(-1))), F.lit(False))
        return (n == 0) | ((n <= 2) & (F.length(t) <= 20) & every) | ((n <= 3) & (F.length(t) <= 24) & ends) | ((n <= 4) & every)

    return let(F.regexp_extract_all(t, F.lit(_MICRO_WORD), F.lit(0)), decide)


def formula_risk(text: Column) -> Column:
    """struct(score, slots, segments, effective): how risky a text's placeholders make it, and what its parts are.

    A segment is what stands between two placeholders and has a letter; effective ones are more than connectors.
    """
    text = F.coalesce(text, F.lit(""))
    prose = F.lower(T.normalize_text(T.strip_placeholders(text)))
    slots = F.regexp_count(text, F.lit(SLOT.pattern))
    point = lambda c, n=1: F.when(c, n).otherwise(0)

    def scored(pieces: Column) -> Column:
        segments = F.transform(F.filter(pieces, lambda x: x.rlike(r"\p{L}")), lambda x: F.lower(T.normalize_text(x)))
        return let(segments, lambda s: let(F.size(F.filter(s, _is_micro)), lambda micro: total(pieces, s, micro)))

    def total(pieces: Column, s: Column, micro: Column) -> Column:
        n, density = F.size(s), slots / F.greatest(F.lit(1), F.length(text))
        led = F.get(s, F.lit(0))
        rest = F.slice(s, F.lit(2), F.greatest(F.lit(0), n - 1))
        cues = prose.contains("abbreviated as") | prose.contains("stands for") | prose.contains("denoted as")
        score = (
            point(risk_phrases(text), 3) + point(F.exists(s, lambda x: F.length(x).between(1, 32))) + point(slots >= 4, 2) + point(slots >= 8, 2) + point(F.length(prose) >= 180) + point(density >= 0.015) + point(density >= 0.03)
            - F.when(micro >= F.greatest(F.lit(2), n - 1), 2).when(micro > 0, 1).otherwise(0) + point(F.coalesce(led.rlike("^(?:the|a|an) ") & (F.length(led) <= 24), F.lit(False)))
            + point(F.exists(rest, lambda x: x.rlike("^(?:which|where|that|is|are|can) "))) + point(n >= 3) + point(slots > 0) + point((slots > 0) & (F.element_at(pieces, -1) != "")) + point(text.contains(")") & cues)
        )
        return F.struct(score.cast("int").alias("score"), slots.cast("int").alias("slots"), n.alias("segments"), F.when(micro < n, n - micro).otherwise(n).alias("effective"), F.length(prose).alias("prose_chars"))

    return let(F.split(text, SLOT.pattern), scored)


def formula_route(risk: Column, grouped: Column) -> Column:
    """single where a text is sent in one piece with its placeholders tagged, else none.  ``risk``: formula_risk()."""
    some = (risk["slots"] >= ROUTE_SLOTS) & (risk["slots"] < ROUTE_MOST_SLOTS) & (risk["score"] >= ROUTE_RISK) & risk["effective"].between(1, ROUTE_SEGMENTS)
    return F.when(some & ~grouped & ~((risk["effective"] >= 5) & (risk["prose_chars"] >= 180)), "single").otherwise("none")


def heavy_split_reason(text: Column, slots: Column) -> Column:
    """Why a text is split before it is sent; empty where it isn't."""
    heavy = (slots >= SPLIT_SLOTS) & ((F.length(text) >= SPLIT_CHARS) | (slots >= ROUTE_MOST_SLOTS)) & ((slots >= ROUTE_MOST_SLOTS) | (slots / F.greatest(F.lit(1), F.length(text)) >= SPLIT_DENSITY))
    return F.when(heavy, "heavy_formula_density").otherwise("")


# --- batches, pages, pairs -----------------------------------------------------------------


def chunked(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """Adds ``chunk``: consecutive rows of a key, ``size`` at a time, numbered from 0."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size))


def touched_pages(translated: DataFrame, items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, page_idx): the pages that a batch's results change.  ``translated``: doc, id, is_group; ``items``: doc, item_id, unit_id, page_idx.

    The id of a group stands for the pages of all its members, any other id for its item's page; unknown ids touch nothing.
    """
    ids = translated.where("is_group").select(doc, F.col("id").alias("unit_id"))
    own = translated.where("NOT is_group").select(doc, F.col("id").alias("item_id"))
    pages = items.join(ids, [doc, "unit_id"], "left_semi").select(doc, "page_idx").unionByName(items.join(own, [doc, "item_id"], "left_semi").select(doc, "page_idx"))
    return pages.distinct()


def is_boundary_pair(prev: str, next_: str) -> Column:
    """Does a candidate pair lie at a boundary: another page or zone, or a first, last or single block?  Repaired blocks never do."""
    a, b = (lambda c: F.col(f"{prev}.{c}")), (lambda c: F.col(f"{next_}.{c}"))
    edge = a("role").isin("head", "tail", "single") | b("role").isin("head", "tail", "single")
    return ~a("repaired") & ~b("repaired") & ((a("page_idx") != b("page_idx")) | (a("zone") != b("zone")) | edge)


def without_singletons(rows: DataFrame, doc: str, group: str) -> DataFrame:
    """Groups of one member are none."""
    n = F.count(F.lit(1)).over(Window.partitionBy(doc, group))
    return rows.withColumn(group, F.when(n > 1, F.col(group)).otherwise(""))


def recover_stale(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """jobs (status, stage, error, pid, ...) in which running ones without a live process have failed.  ``live``: pid, one row each."""
    alive = live.select("pid").distinct().withColumn("__live", F.lit(True))
    joined = jobs.join(alive, "pid", "left")
    stale = (F.col("status") == "running") & F.col("__live").isNull()
    detail = F.when(F.col("pid").isNull(), NO_PID).otherwise(F.concat(F.lit(DEAD_PID[0]), F.col("pid").cast("string"), F.lit(DEAD_PID[1])))
    done = {"status": F.lit("failed"), "stage": F.lit("failed"), "error": detail, "pid": F.lit(None)}
    return joined.select(*[F.when(stale, done[c]).otherwise(F.col(c)).alias(c) if c in done else F.col(c) for c in jobs.columns])
