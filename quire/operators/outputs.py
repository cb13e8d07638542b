"""Model outputs and runs: parsing, checks in order, residue, command prefixes, failure classes, page kinds, regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T

# --- fixed values ------------------------------------------------------------
RESIDUE = r"[A-Za-z][A-Za-z0-9\s,;:()'./%+-]{30,}"
COMMAND_OPERATORS = (">", "<", "|", "||", "&&", "2>", "1>", ">>", "=", ":")
FLAG, FILE, NUMBER, ARGUMENT, HEAD = r"^-{1,2}[A-Za-z0-9][\w.-]*$", r"^[A-Za-z0-9_.-]+\.[A-Za-z0-9]{1,8}$", r"^-?\d+(?:\.\d+)?$", r"^<[^<>\n]+>$", r"^[A-Za-z][\w.-]{0,31}$"
#: (class, needles): the first whose needles occur in error or log.
FAILURES = (
    ("dns_resolution_failed", ("Failed to resolve", "NameResolutionError", "Temporary failure in name resolution", "socket.gaierror")), ("upstream_timeout", ("ReadTimeout", "ConnectTimeout", "timed out")), ("process_timeout", None),
    ("placeholder_unstable", ("PlaceholderInventoryError", "UnexpectedPlaceholderError", "placeholder inventory mismatch", "unexpected placeholders in translation", "placeholder instability")),
    ("source_pdf_missing", ("source pdf not found",)), ("auth_failed", ("401", "403", "missing or invalid X-API-Key", "Unauthorized")), ("rate_limited", ("429", "rate limit", "Too Many Requests")),
    ("typst_dependency_download_failed", ("packages.typst.org", "failed to download package", "downloading @preview/")),
)
REDACTION = {
    "auto": "auto", "text_layer_only": "text_layer_only", "text_redaction": "text_layer_only", "visual_cover": "visual_cover", "visual_only": "visual_cover", "visual_cover_and_remove_text": "visual_cover_and_remove_text", "visual_and_text": "visual_cover_and_remove_text",
}
HEAVY_SEGMENTS, WINDOW_SEGMENTS, HEAVY_CHARS, HEAVY_MEMBERS = 12, 8, 1600, 3
VALUE_CHARS, VALUE_CJK, KEY_WORDS, VALUE_WORDS = 12, 8, 4, ("的", "已", "将", "被", "从", "在", "这", "其")
DULL_KEYS = ("or", "and", "the", "from", "with", "for", "this", "that")
FULL_COLUMN, SLOT = 0.62, (0.18, 0.48)
# -----------------------------------------------------------------------------


def _any(c: Column, needles: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


# --- commands ----------------------------------------------------------------------


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once a row; a plain expression in a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def command_prefix(text: Column) -> Column:
    """The longest run of command-like tokens at the start of a text whose rest is prose of six words or more; empty where there is none."""
    return let(F.split(T.normalize_text(text), " "), _command_prefix)


def _command_prefix(tokens: Column) -> Column:
    head = F.get(tokens, F.lit(0))
    heady = head.rlike(HEAD) & ((F.lower(head) == head) | head.rlike(r"[\d.-]"))
    before = lambda i: F.get(tokens, i - 1)
    value = lambda t, i: t.isin(*COMMAND_OPERATORS) | t.rlike(ARGUMENT) | t.rlike(FLAG) | t.rlike(NUMBER) | t.rlike(FILE) | t.rlike(r"[/\\_=]") | before(i).isin(*COMMAND_OPERATORS) | before(i).rlike(FLAG)
    first_no = F.array_position(F.transform(tokens, lambda t, i: (i > 0) & ~value(t, i)), F.lit(True))
    used = let(first_no, lambda k: F.when(k == 0, F.size(tokens)).otherwise(k - 1).cast("int"))
    some = lambda arr, p: F.exists(arr, lambda t: t.rlike(p))
    points = lambda c, n: F.when(c, n).otherwise(0)

    def checked(used: Column) -> Column:
        prefix = F.slice(tokens, F.lit(1), used)
        tail = F.slice(tokens, F.lit(2), F.greatest(F.lit(0), used - 1))
        evidence = (
            points(some(tail, FLAG), 2) + points(some(tail, FILE), 2) + points(some(tail, ARGUMENT), 2) + points(F.exists(prefix, lambda t: t.isin(*COMMAND_OPERATORS)), 2) + points(F.size(F.filter(tail, lambda t: t.rlike(NUMBER))) >= 2, 1)
            + points(some(tail, r"[/\\=]"), 1) + points(head.rlike(r"[\d.-]"), 1)
        )
        rest = F.array_join(F.slice(tokens, used + 1, F.size(tokens)), " ")
        return F.when((used >= 3) & (evidence >= 2) & (T.natural_word_count(rest) >= 6), F.array_join(prefix, " ")).otherwise("")

    return F.when((F.size(tokens) >= 3) & heady, let(used, checked)).otherwise("")


# --- outputs -----------------------------------------------------------------------


def residue_spans(text: Column) -> Column:
    """Stretches of ten or more English words of prose left in an output."""
    found = F.regexp_extract_all(T.strip_placeholders(text), F.lit(RESIDUE), F.lit(0))
    return F.filter(F.transform(found, T.normalize_text), lambda s: (F.regexp_count(s, F.lit(T.EN_WORD)) >= 10) & T.is_english_prose(s))


def is_mainly_english(source: Column, output: Column, must: Column) -> Column:
    """Prose that had to be translated came back with a long English stretch, or with twelve English words or more and few CJK signs."""
    clean = T.strip_placeholders(output)
    n, zh = T.english_word_count(clean), T.zh_char_count(clean)
    open_case = must & (F.trim(output) != "") & T.is_english_prose(source) & ~T.is_author_list(source)
    return open_case & ((F.size(residue_spans(output)) > 0) | ((n >= 12) & ((zh == 0) | (n >= F.greatest(F.lit(12), F.floor(zh / 2))))))


def first_problem(source: Column, output: Column) -> Column:
    """The first check that an output fails, in order; null where it passes all.  A changed order of tokens is a warning."""
    src, out = T.placeholder_sequence(source), T.placeholder_sequence(output)
    same = T.normalize_text(source) == T.normalize_text(output)
    return (
        F.when(F.trim(F.coalesce(output, F.lit(""))) == "", "empty").when(~T.has_balanced_math(output), "math").when(T.is_protocol_shell(output), "shell").when(same & T.is_english_prose(source), "untranslated")
        .when(F.size(F.array_except(out, src)) > 0, "unexpected_placeholder").when(F.array_sort(out) != F.array_sort(src), "placeholder_inventory").when(out != src, "warn_order")
    )


def json_text(content: Column) -> Column:
    """The JSON object in an answer: fences dropped, typographic quotes and colons as ASCII, from the first { to the last }; null where there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(content, F.lit(""))), r"^```[^\n]*\n", ""), r"\n```\s*+$", "")
    loose = F.translate(bare, "“”„‟‘’‚‛：", '"""""""":')
    return F.nullif(F.regexp_extract(loose, r"(?s)^[^{]*+(\{.*\})", 1), F.lit(""))


def string_field(content: Column, *names: str) -> Column:
    """The first of these fields that an answer has, in its JSON or as a ``name: value`` line."""
    obj = json_text(content)
    tries = [F.get_json_object(obj, f"$.{n}") for n in names] + [F.nullif(F.trim(F.regexp_extract(F.coalesce(content, F.lit("")), rf"(?im)^[^\S\n]*{n}\s*[:：]\s*(.+)$", 1)), F.lit("")) for n in names]
    return F.coalesce(*tries)


def term_allowed(key: Column, value: Column) -> Column:
    """May a remembered term stand in a prompt?  Keys of up to four words with a letter; values equal to the key, or short CJK noun phrases."""
    k, v = F.trim(F.coalesce(key, F.lit(""))), F.trim(F.coalesce(value, F.lit("")))
    keyed = (F.length(k) >= 2) & ~F.lower(k).isin(*DULL_KEYS) & k.rlike(r"\p{L}") & (F.size(F.split(k, r"\s+")) <= KEY_WORDS)
    noun = v.rlike("[一-鿿]") & (F.length(v) <= VALUE_CHARS) & (T.zh_char_count(v) <= VALUE_CJK) & ~v.rlike("[，。；：、,.!?！？]") & ~_any(v, VALUE_WORDS)
    return keyed & (v != "") & ((F.lower(k) == F.lower(v)) | noun)


def heavy_group(segments: Column, chars: Column, members: Column, continued: Column) -> Column:
    """Why a group is split; null where it stays whole."""
    return (
        F.when(segments > HEAVY_SEGMENTS, "formula_heavy_group").when(segments > WINDOW_SEGMENTS, "formula_windowed_group").when((chars > HEAVY_CHARS) & ~continued, "long_continuation_group").when((members > HEAVY_MEMBERS) & ~continued, "large_continuation_group")
    )


# --- runs --------------------------------------------------------------------------


def job_failure(status: Column, error: Column, log: Column, return_code: Column, stage: Column) -> Column:
    """The class of a failed job's failure: text signs in order, then rendering, exit codes and unknown; null for other jobs."""
    text = F.concat_ws("\n", F.nullif(F.trim(F.coalesce(error, F.lit(""))), F.lit("")), F.coalesce(log, F.lit("")))
    out = F.when(~F.coalesce(status == "failed", F.lit(False)), F.lit(None).cast("string"))
    for name, needles in FAILURES:
        out = out.when(F.coalesce(return_code == -1, F.lit(False)) if needles is None else _any(text, needles), name)
    return out.when(F.coalesce(stage.contains("render"), F.lit(False)), "render_failed").when(F.coalesce(return_code != 0, F.lit(False)), "process_exit_failed").otherwise("unknown")


def page_kind(large_background: Column, visible: Column, hidden: Column, vector_heavy: Column) -> Column:
    return (
        F.when(large_background & hidden & ~visible, "pseudo_editable_scan").when(large_background & ~visible, "scan_image").when(vector_heavy, "vector_heavy").when(large_background, "mixed_complex").otherwise("editable_text")
    )


def redaction_route(strategy: Column, cover_only: Column) -> Column:
    """The route of a strategy's name; unknown names are an error when they are read."""
    s = F.lower(F.trim(F.coalesce(strategy, F.lit(""))))
    known = F.create_map(*[F.lit(x) for kv in REDACTION.items() for x in kv])[s]
    return F.when(s == "", F.when(cover_only, "visual_cover").otherwise("auto")).when(s.isin(*REDACTION), known).otherwise(F.raise_error(F.concat(F.lit("unsupported strategy: "), s)).cast("string"))


def render_mode(pages: DataFrame, key: str, sample: int = 3) -> DataFrame:
    """(key, mode): typst where at least half of the first three pages are editable and not all are pseudo scans, else typst_visual."""
    first = pages.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy("page_idx"))).where(F.col("__k") <= sample)
    n = lambda c: F.count(F.when(c, 1))
    agg = first.groupBy(key).agg(F.count(F.lit(1)).alias("n"), n(F.col("editable")).alias("e"), n(F.col("pseudo_scan")).alias("p"))
    return agg.select(key, F.when((F.col("p") < F.col("n")) & (F.col("e") >= F.ceil(F.col("n") / 2)), "typst").otherwise("typst_visual").alias("mode"))


def canonical_item_id(c: Column) -> Column:
    """page-b12 as page-b0012; what has no whole block number stays."""
    page, block = F.substring_index(c, "-b", 1), F.regexp_extract(c, r"^.*?-b(\d{1,9})$", 1)
    whole = (block != "") & (F.length(c) == F.length(page) + 2 + F.length(block))
    number = F.when(block != "", block.cast("long").cast("string"))
    return F.when(whole, F.concat(page, F.lit("-b"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number))).otherwise(c)


def reader_regions(items: DataFrame, source: DataFrame) -> DataFrame:
    """Translated items with their source region: by id, else by canonical id, else the item's own page and box.

    ``items``: doc_id, item_id, page_idx, text.  ``source``: doc_id, id, page, text.
    """
    s1 = source.select(F.col("doc_id").alias("d1"), F.col("id").alias("i1"), F.col("page").alias("p1"), F.col("text").alias("t1"))
    s2 = source.select(F.col("doc_id").alias("d2"), F.col("id").alias("i2"), F.col("page").alias("p2"), F.col("text").alias("t2"))
    both = items.join(s1, (F.col("doc_id") == F.col("d1")) & (F.col("item_id") == F.col("i1")), "left").join(s2, (F.col("doc_id") == F.col("d2")) & (canonical_item_id(F.col("item_id")) == F.col("i2")), "left")
    how = F.when(F.col("i1").isNotNull(), "id").when(F.col("i2").isNotNull(), "canonical").otherwise("own")
    return both.select("doc_id", "item_id", how.alias("matched"), F.coalesce("p1", "p2", F.col("page_idx") + 1).alias("page"), F.coalesce("t1", "t2", "text").alias("source_text"))


def artifact_entries(jobs: DataFrame, columns: dict[str, str], job: str = "job_id") -> DataFrame:
    """(job, artifact_key, artifact_group, relative_path): one row per path column that a job has (an unpivot)."""
    each = [F.struct(F.lit(c).alias("artifact_key"), F.lit(group).alias("artifact_group"), F.col(c).cast("string").alias("relative_path")) for c, group in columns.items()]
    return jobs.select(job, F.inline(F.array(*each))).where("trim(relative_path) <> ''")


# --- layout signals ------------------------------------------------------------------


def column_guess(x0: Column, x1: Column, width: Column) -> Column:
    return F.when(width <= 0, "unknown").when(F.greatest(F.lit(0.0), x1 - x0) >= width * FULL_COLUMN, "full").when((x0 + x1) / 2 <= width / 2, "left").otherwise("right")


def column_mode(blocks: DataFrame, page: list[str]) -> DataFrame:
    """(page..., mode, split_x): two columns where either side has two text blocks of column size, or one each and an empty block beside.

    ``blocks``: page..., textish, text, x0, x1, page_width.
    """
    w = (F.col("x1") - F.col("x0")) / F.col("page_width")
    rows = blocks.withColumn("guess", column_guess(F.col("x0"), F.col("x1"), F.col("page_width"))).withColumn("slot", F.col("textish") & w.between(*SLOT)).withColumn("c", (F.col("x0") + F.col("x1")) / 2)
    n = lambda c: F.count(F.when(c, 1))
    side = lambda s: F.col("slot") & (F.col("guess") == s)
    full = F.trim("text") != ""
    agg = rows.groupBy(*page).agg(
        n(side("left")).alias("ls"), n(side("right")).alias("rs"), n(side("left") & full).alias("lc"), n(side("right") & full).alias("rc"), n((F.length(F.trim("text")) < 2) & F.col("guess").isin("left", "right")).alias("gaps"),
        F.percentile(F.when(side("left") & full, F.col("c")), 0.5).alias("lm"), F.percentile(F.when(side("right") & full, F.col("c")), 0.5).alias("rm"), F.max("page_width").alias("w"),
    )
    sparse = ((F.col("ls") >= 2) & (F.col("rs") >= 2)) | ((F.col("ls") >= 1) & (F.col("rs") >= 1) & (F.col("gaps") > 0))
    double = (F.col("w") > 0) & (((F.col("lc") >= 2) & (F.col("rc") >= 2)) | sparse)
    split = F.when(double, F.coalesce((F.col("lm") + F.col("rm")) / 2, F.col("w") / 2)).otherwise(F.greatest(F.lit(0.0), F.col("w")) / 2)
    return agg.select(*page, F.when(F.col("w") <= 0, "unknown").when(double, "double").otherwise("single").alias("mode"), F.round(split, 3).alias("split_x"))


def provider_hints(blocks: DataFrame, doc: str, group: str, order: list[str]) -> DataFrame:
    """Adds hint_role, hint_scope, hint_order of each member of a provider group, in order."""
    from quire.operators.reading_order import boundary_role

    w = Window.partitionBy(doc, group)
    rank, size = F.row_number().over(w.orderBy(*order)) - 1, F.count(F.lit(1)).over(w)
    pages = F.max("page_idx").over(w) > F.min("page_idx").over(w)
    has = F.coalesce(F.trim(F.col(group)), F.lit("")) != ""
    return blocks.withColumn("hint_role", F.when(has, boundary_role(rank, size)).otherwise("")).withColumn("hint_scope", F.when(has, F.when(pages, "cross_page").otherwise("intra_page")).otherwise("")).withColumn("hint_order", F.when(has, rank).otherwise(-1))


def subtract(rects: DataFrame, guards: DataFrame, page: list[str]) -> DataFrame:
    """(page..., id, r): pieces of each rectangle outside ONE guard it overlaps by over 0.5 (up to four), or the rectangle itself.

    Rectangles that meet several guards take as many passes; this is one.
    """
    g = guards.groupBy(*page).agg(F.min_by("r", "id").alias("g"))
    rows = rects.join(g, page, "left")
    r, k = F.col("r"), F.col("g")
    inter = G.rect(F.greatest(r["x0"], k["x0"]), F.greatest(r["y0"], k["y0"]), F.least(r["x1"], k["x1"]), F.least(r["y1"], k["y1"]))
    rows = rows.withColumn("i", inter)
    i = F.col("i")
    hit = F.coalesce(G.overlap_area(r, k) > 0.5, F.lit(False))
    pieces = F.array(G.rect(r["x0"], r["y0"], i["x0"], r["y1"]), G.rect(i["x1"], r["y0"], r["x1"], r["y1"]), G.rect(i["x0"], r["y0"], i["x1"], i["y0"]), G.rect(i["x0"], i["y1"], i["x1"], r["y1"]))
    kept = F.when(hit, F.filter(pieces, lambda p: G.area(p) > 0.5)).otherwise(F.array(r))
    return rows.select(*page, "id", F.explode(kept).alias("r"))
