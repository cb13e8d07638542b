"""Hints and rules around a translation: structured blocks, soft hints, reference text, approved pairs, page routes, exception classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.outputs import command_prefix, let

# --- fixed values ------------------------------------------------------------
FIELD_LABEL = r"(?:^|\s*[•\-]\s+)([A-Za-z][A-Za-z0-9 _./-]{1,40})\s*:"
LITERAL = r"(?i)^(?:-?\d+(?:\.\d+)?(?:[Ee][+-]?\d+)?|true|false|null|none|yes|no|<[^<>\n]{1,80}>|\"[^\"]{0,120}\"|'[^']{0,120}'|\[[^\]\n]{1,160}\])$"
STRUCTURED_CHARS = 1200
REFERENCE = r"^\s*(?:\[\d+\]|[A-Z][^,]{0,40},\s+[A-Z])"
NUMBERED_REFERENCE = r"^\s*\d+\.\s+(?:[A-Z][A-Za-z'`-]+,\s+[A-Z]|[A-Z][A-Za-z'`-]+(?:\s+[A-Z]\.){1,3}(?:\s+[A-Z][A-Za-z'`-]+)?)"
NUMBERED_SUMMARY = r"^\s*\d+\.\s+[A-Z]"
SUMMARY_CUES = r"(?i)\b(if|when|then|thus|are|is|was|were|seen|rules?|vertices?|order|bump|more|governed)\b"
RISKS = ("abbreviated as", "defined as", "denoted as", "is defined as", "can be defined as", "where ", "represented by", "expressed as", "written as", "calculated as", "corresponds to", "refers to", "stands for")
#: kind: (redaction, background, composition, reason)
ROUTES = {
    "editable_text": ("text_layer_only", "source_pdf_page", "typst_overlay", "visible editable text layer"),
    "pseudo_editable_scan": ("visual_cover_and_remove_text", "hidden_text_stripped_source", "typst_background", "large background image with hidden text layer"),
    "scan_image": ("visual_cover", "image_background", "typst_background", "large background image without visible text"),
    "vector_heavy": ("visual_cover", "cleaned_background", "typst_background", "vector drawing count exceeds safe text-layer cleanup threshold"),
    "mixed_complex": ("visual_cover", "cleaned_background", "typst_background", "large background image with additional page content"),
}
#: (class, status codes, needles in the lower-cased text), in order.
EXCEPTIONS = (
    ("dns_resolution_failed", (), ("failed to resolve", "temporary failure in name resolution", "nameresolutionerror", "socket.gaierror")), ("upstream_timeout", (), ("readtimeout", "connecttimeout", "timed out")),
    ("upstream_rate_limited", (429,), ("rate limited", "rate limit", "too many requests", "retry-after")), ("auth_failed", (401, 403), ("unauthorized", "forbidden", "invalid api key", "token expired", "missing api key", "missing or invalid x-api-key")),
    ("upstream_bad_request", (400,), ()), ("placeholder_unstable", (), ("placeholderinventoryerror", "unexpectedplaceholdererror", "placeholder inventory mismatch", "placeholder instability")), ("translation_protocol_shell", (), ("translationprotocolerror", "protocol/json shell")),
    ("typst_dependency_download_failed", (), ("failed to download package", "packages.typst.org", "downloading @preview/")), ("render_failed", (), ("typst compile", "typst error", "render failed", "failed to render", "font not found", "missing bundled font")),
    ("json_decode_failed", (), ("jsondecodeerror", "expecting value", "extra data", "invalid control character")), ("document_schema_validation_failed", (), ("validationerror", "normalized document schema validation failed")), ("source_pdf_missing", (), ("source pdf not found",)),
    ("source_pdf_open_failed", (), ("fitz.fitzerror", "pymupdf", "cannot open broken document", "file data error")),
)
# -----------------------------------------------------------------------------


def field_labels(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(T.normalize_text(text), F.lit(FIELD_LABEL), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def is_structured_block(text: Column) -> Column:
    """Two field labels or more, or one whose value is a literal, in 1200 characters at most."""
    t = T.normalize_text(text)
    n = F.size(field_labels(text))
    value = F.trim(F.regexp_extract(t, r"^[^:]*:(.*)$", 1))
    return (t != "") & (F.length(t) <= STRUCTURED_CHARS) & ((n >= 2) | ((n == 1) & value.rlike(LITERAL)))


def soft_hints(lines: Column, text: Column, bodylike: Column) -> Column:
    """Names of what a block looks like, in order.  ``lines``: its text by line."""
    clean = F.filter(F.transform(lines, T.normalize_text), lambda x: x != "")
    command = lambda clean: F.transform(clean, lambda x: command_prefix(x) != "")
    starts = command_prefix(text) != ""

    def names(norm: Column, clean: Column, command: Column, starts: Column) -> Column:
        prose = F.exists(clean, lambda x: (T.natural_word_count(x) >= 6) & (T.alpha_count(x) >= 24))
        tail = F.array_join(F.slice(clean, F.lit(2), F.greatest(F.lit(0), F.size(clean) - 1)), " ")
        found = [
            ("body_text_block", bodylike), ("long_english_prose", T.natural_word_count(norm) >= 8), ("command_prefix_then_prose_tail", (F.size(clean) >= 2) & F.get(command, F.lit(0)) & (T.natural_word_count(tail) >= 6)),
            ("mixed_literal_and_prose_block", F.exists(command, lambda x: x) & prose), ("single_line_command_prefix_with_prose_tail", starts), ("starts_with_command_prefix", starts),
        ]
        return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in found])))

    return let(T.normalize_text(text), lambda t: let(clean, lambda c: let(command(c), lambda k: let(starts, lambda s: names(t, c, k, s)))))


def apply_hints(rows: DataFrame, hints: DataFrame, item: str = "item_id") -> DataFrame:
    """rows with style_hint and structure_kind: an item's last hint joins what it has, on a new line.  ``hints``: item, seq, kind, hint."""
    last = hints.groupBy(item).agg(F.max_by(F.struct("kind", "hint"), "seq").alias("h"))
    joined = rows.join(last, item, "left")
    old = F.nullif(F.trim(F.coalesce("style_hint", F.lit(""))), F.lit(""))
    style = F.when(F.col("h").isNull(), F.col("style_hint")).otherwise(F.concat_ws("\n", old, "h.hint"))
    return joined.withColumn("structure_kind", F.col("h.kind")).withColumn("style_hint", style).drop("h")


def skips_reference_text(text: Column) -> Column:
    """Reference text is left alone, unless it is prose of 12 words or more that does not look like an entry."""
    t = F.trim(F.coalesce(text, F.lit("")))
    entry = t.rlike(REFERENCE) | t.rlike(NUMBERED_REFERENCE) | F.lower(t).rlike("^(references|bibliography)") | t.contains(" et al.") | t.rlike(T.edged(r"\b\d{4}\b"))
    ends = t.rlike("[.。!?;；:]$") & (T.natural_word_count(t) >= 12)
    prose = F.when(t.rlike(NUMBERED_SUMMARY), t.rlike(T.edged(SUMMARY_CUES))).otherwise(ends)
    return ~((t != "") & ~entry & (T.english_word_count(t) >= 12) & prose)


def risk_phrases(text: Column) -> Column:
    low = F.lower(T.normalize_text(T.strip_placeholders(text)))
    out = F.lit(False)
    for p in RISKS:
        out = out | low.contains(p)
    return out


def exception_class(text: Column, status: Column, stage: Column) -> Column:
    """The first class whose status code or needle fits; a missing file while rendering counts as a failed rendering."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for k, (name, codes, needles) in enumerate(EXCEPTIONS):
        cond = F.coalesce(status.isin(*codes), F.lit(False)) if codes else F.lit(False)
        for n in needles:
            cond = cond | low.contains(n)
        out = F.when(cond, name) if out is None else out.when(cond, name)
        if k == 1:
            out = out.when((stage == "render") & (low.contains("filenotfounderror") | low.contains("no such file or directory")), "render_failed")
    return out.otherwise("python_unhandled_exception")


def page_routes(kind: Column) -> Column:
    """struct(redaction, background, compose, reason) of a page kind."""
    out = None
    for name, (a, b, c, d) in ROUTES.items():
        value = F.struct(F.lit(a).alias("redaction"), F.lit(b).alias("background"), F.lit(c).alias("compose"), F.lit(d).alias("reason"))
        out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
    return out


def approved_chains(pairs: DataFrame, doc: str, first_number: int = 1001, most_rounds: int = 64) -> DataFrame:
    """(doc, item_id, continuation_group, position): chains of approved pairs (doc, seq, prev_id, next_id), numbered by their first pair.

    Of two pairs with the same prev the last counts.  Every round doubles how far each item looks back, so a chain of n items takes
    log n rounds of one join each; lineage is cut by checkpoints.
    """
    last = pairs.groupBy(doc, "prev_id").agg(F.max_by("next_id", "seq").alias("next_id"), F.min("seq").alias("seq"))
    heads = pairs.join(pairs.select(F.col(doc).alias("__d"), F.col("next_id").alias("__n")).distinct(), (F.col(doc) == F.col("__d")) & (F.col("prev_id") == F.col("__n")), "left_anti")
    # an item's back pointer (anc, dist); heads point to themselves
    links = last.groupBy(doc, F.col("next_id").alias("item_id")).agg(F.min("prev_id").alias("anc")).withColumn("dist", F.lit(1))
    roots = heads.groupBy(doc, F.col("prev_id").alias("item_id")).agg(F.min("seq").alias("seq"))
    now = links.unionByName(roots.select(doc, "item_id", F.col("item_id").alias("anc"), F.lit(0).alias("dist"))).checkpoint()
    for _ in range(most_rounds):
        up = now.select(F.col(doc).alias("__d"), F.col("item_id").alias("__i"), F.col("anc").alias("__a"), F.col("dist").alias("__s"))
        fresh = now.join(up, (F.col(doc) == F.col("__d")) & (F.col("anc") == F.col("__i")), "left").select(doc, "item_id", F.coalesce("__a", "anc").alias("anc"), (F.col("dist") + F.coalesce("__s", F.lit(0))).alias("dist")).checkpoint()
        moved = fresh.join(now.select(doc, "item_id", F.col("anc").alias("__b")), [doc, "item_id"]).where("anc <> __b").limit(1).count()
        now = fresh
        if not moved:
            break
    order = F.row_number().over(Window.partitionBy(doc).orderBy("seq")) + first_number - 1
    named = roots.withColumn("group", F.concat(F.lit("cg-review-"), F.lpad(order.cast("string"), 4, "0"))).select(F.col(doc).alias("__d"), F.col("item_id").alias("__r"), "group")
    return now.join(named, (F.col(doc) == F.col("__d")) & (F.col("anc") == F.col("__r"))).select(doc, "item_id", F.col("group").alias("continuation_group"), F.col("dist").cast("long").alias("position"))
