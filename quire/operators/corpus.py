"""Text-corpus operators: exact dedupe with fan-out, batching, term mining, glossaries, job memory."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# --- fixed values ------------------------------------------------------------
TECH_TERM = r"\b(?:[A-Z][a-z]+(?:-[A-Z][A-Za-z0-9]+)+|[A-Z]{2,}(?:[-_/][A-Za-z0-9]+)+|[A-Za-z]+[0-9][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)*|[A-Z]{2,}[a-z]*\b)\b"
COMMON_WORDS = ("AND", "ARE", "CAN", "FOR", "FROM", "HAS", "HAVE", "HERE", "INTO", "NOT", "THE", "THIS", "THAT", "THESE", "THOSE", "WERE", "WHEN", "WITH")
TERM_PAIRS = (
    r"([一-鿿][一-鿿A-Za-z0-9·\-]{1,24})（(?:或称|又称|简称)?([A-Za-z][A-Za-z0-9 ._+/\-]{1,48})）",
    r"([一-鿿][一-鿿A-Za-z0-9·\-]{1,24})\((?:or |also known as )?([A-Za-z][A-Za-z0-9 ._+/\-]{1,48})\)",
)
TRIM_CHARS = ".,;:()[]{}<>\"'“”‘’"
MAX_TERMS, CONTEXT_CHARS = 240, 160
MEMORY_TERMS, PROMPT_TERMS, SOURCES = 160, 20, 8
BATCH_FLOOR, BATCH_MIN_CHARS, BATCH_MAX_CHARS, BATCH_PLACEHOLDERS = 6, 16, 1200, 8
# -----------------------------------------------------------------------------
#: Java walks a repeated group by recursion: a term has at most 200 parts.
_TECH_TERM = T.edged(TECH_TERM).replace(")+|", "){1,200}|").replace(")*|", "){0,200}|")


# --- dedupe ----------------------------------------------------------------------


def signature(kind: Column, layout: Column, semantic: Column, source: Column, grouped: Column, protected: Column) -> Column:
    """A hash of what makes two pending items the same; null (never equal) for grouped, protected and blank ones."""
    src = F.trim(F.coalesce(source, F.lit("")))
    key = F.sha2(F.to_json(F.struct(kind.alias("kind"), layout.alias("layout"), semantic.alias("semantic"), src.alias("source"))), 256)
    return F.when(~grouped & ~protected & (src != ""), key)


def dedupe(rows: DataFrame, sig: str, order: list[str], item: str = "item_id") -> DataFrame:
    """Adds rep_id: the first item with the same signature (its own id where the signature is null).

    Aggregates before it joins, so a signature that many rows share meets one row of its representative.
    """
    first = rows.where(F.col(sig).isNotNull()).groupBy(sig).agg(F.min(F.struct(*order, F.col(item).alias("__id"))).alias("__f")).select(F.col(sig).alias("__s"), F.col("__f.__id").alias("__rep"))
    return rows.join(first, F.col(sig) == F.col("__s"), "left").withColumn("rep_id", F.coalesce("__rep", item)).drop("__s", "__rep")


def fan_out(deduped: DataFrame, results: DataFrame, item: str = "item_id") -> DataFrame:
    """Each item with its representative's result columns (results: item, ...)."""
    others = [c for c in results.columns if c != item]
    return deduped.select(item, "rep_id").join(results.withColumnRenamed(item, "rep_id"), "rep_id", "left").select(item, "rep_id", *others)


def cache_split(rows: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Adds hit and the cached value: a lookup by content hash."""
    return rows.join(cache.select(key, F.col("value").alias("cached")), key, "left").withColumn("hit", F.col("cached").isNotNull())


# --- batching --------------------------------------------------------------------


def queue_of(low_risk: Column, heavy: Column) -> Column:
    """batched_fast for low-risk items, single_slow for those split as heavy, else single_fast."""
    return F.when(low_risk, "batched_fast").when(heavy, "single_slow").otherwise("single_fast")


def is_low_risk(text: Column, bodylike: Column, grouped: Column) -> Column:
    """Plain English body text of 16 to 1200 characters with at most 8 placeholders, outside continuation groups."""
    compact = T.normalize_text(T.strip_placeholders(text))
    return bodylike & ~grouped & T.is_english_prose(text) & F.length(compact).between(BATCH_MIN_CHARS, BATCH_MAX_CHARS) & (F.size(T.placeholder_sequence(text)) <= BATCH_PLACEHOLDERS)


def batches(rows: DataFrame, doc: str, order: list[str], batch_size: int, queue: str = "queue") -> DataFrame:
    """Adds batch_id: chunks of max(batch_size, 6) of a document's batched items in order; others stand alone."""
    size = max(BATCH_FLOOR, batch_size)
    k = F.row_number().over(Window.partitionBy(doc, queue).orderBy(*order)) - 1
    return rows.withColumn("batch_id", F.when(F.col(queue) == "batched_fast", F.concat(F.lit("b"), F.floor(k / size).cast("string"))).otherwise(F.concat(F.lit("s"), F.substring(queue, 8, 1), k.cast("string"))))


# --- terms -----------------------------------------------------------------------


def _worth_preserving(term: Column) -> Column:
    joined, digit, alpha = term.rlike("[-_/]"), term.rlike(r"\d"), term.rlike(r"\p{L}")
    upper = (F.upper(term) == term) & alpha
    return (F.length(term) >= 2) & ~F.upper(term).isin(*COMMON_WORDS) & F.when(joined | digit, alpha).otherwise(upper & (F.length(term) <= 12))


def preserve_terms(rows: DataFrame, text: str, order: list[str], existing: DataFrame | None = None, min_hits: int = 1, most: int = MAX_TERMS) -> DataFrame:
    """(term, hits): technical terms by caseless count, in the spelling seen first; the ``most`` most frequent ones (a top-k report).

    Occurrences count on the map side before they meet.  ``existing``: (source) of a curated glossary, left out.
    """
    found = rows.select(*order, F.posexplode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TECH_TERM), F.lit(0))).alias("__at", "raw"))
    terms = found.withColumn("term", F.btrim("raw", F.lit(TRIM_CHARS))).where(_worth_preserving(F.col("term"))).withColumn("key", F.lower("term"))
    counted = terms.groupBy("key").agg(F.count(F.lit(1)).alias("hits"), F.min(F.struct(*order, "__at", "term")).alias("f")).select("key", F.col("f.term").alias("term"), "hits").where(F.col("hits") >= min_hits)
    if existing is not None:
        counted = counted.join(existing.select(F.lower("source").alias("key")).distinct(), "key", "left_anti")
    return counted.orderBy(F.desc("hits"), F.lower("term")).limit(most).select("term", "hits")


def glossary_key(c: Column) -> Column:
    """Trimmed, with A-Z as a-z; other letters keep their case."""
    return F.translate(F.trim(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def merge_glossaries(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """(pos, source, target, ...): later entries replace earlier ones of the same key at the earlier one's position; overlay comes after base."""
    both = base.withColumn("__t", F.lit(0)).unionByName(overlay.withColumn("__t", F.lit(1))).withColumn("__k", glossary_key(F.col("source")))
    w = Window.partitionBy("__k")
    order = F.struct("__t", "pos")
    kept = both.withColumn("__first", F.min(order).over(w)).withColumn("__last", F.max(order).over(w)).where(order == F.col("__last"))
    place = F.row_number().over(Window.orderBy("__first")) - 1  # a glossary has at most a few hundred entries
    return kept.withColumn("pos", place).drop("__t", "__k", "__first", "__last")


def overridden_count(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """How many overlay rows have the key of a base row."""
    keys = base.select(glossary_key(F.col("source")).alias("k")).distinct()
    return overlay.select(glossary_key(F.col("source")).alias("k")).join(keys, "k", "left_semi").agg(F.count(F.lit(1)).alias("overridden"))


def match_glossary(rows: DataFrame, glossary: DataFrame, text: str, item: str = "item_id", most_entries: int = 200) -> DataFrame:
    """(item, source, target, level): entries that occur in a text, within 160 characters of their context where they have one.

    A glossary has at most ``most_entries`` entries (a larger one is an error), so they come to the driver and go into the
    plan as literals: every pattern is compiled once, texts are read once, nothing is joined.  Before the pattern of a
    plain entry a text is searched for its letters, and contexts are looked for in texts with a hit only.
    """
    entries = glossary.limit(most_entries + 1).collect()
    if len(entries) > most_entries:
        raise ValueError(f"a glossary has at most {most_entries} entries")
    if not entries:
        return rows.select(item, F.lit("").alias("source"), F.lit("").alias("target"), F.lit("").alias("level")).limit(0)
    t, low = F.col(text), F.lower(text)
    merged: dict[tuple[str, str, str, str], tuple] = {}
    for e in entries:
        context = (e["context"] or "").lower()
        first = merged.setdefault((e["source"].lower(), (e["target"] or "").lower(), e["level"], context), (e["source"], e["target"], e["level"], []))
        first[3].append(_entry_hit(t, low, e["source"], e["match_mode"], context))
    found = F.array(*[F.when(T._any(hits), F.struct(F.lit(s).alias("source"), F.lit(g).alias("target"), F.lit(v).alias("level"))) for s, g, v, hits in merged.values()])
    return rows.select(item, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("e")).select(item, "e.source", "e.target", "e.level")


def _entry_hit(t: Column, low: Column, source: str, mode: str, context: str) -> Column:
    """Does an entry occur?  With a context, it must stand within 160 characters of some occurrence."""
    pattern = source if mode == "regex" else ("(?i)" if mode == "case_insensitive" else "") + r"(?<![A-Za-z0-9_])" + re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", source) + r"(?![A-Za-z0-9_])"
    hit = t.rlike(pattern)
    if context.strip():
        spans = F.regexp_extract_all(t, F.lit(f"(?s)(?:.{{0,160}}{pattern}.{{0,160}})"), F.lit(0))
        hit = F.when(low.contains(context) & hit, F.exists(spans, lambda x: F.lower(x).contains(context))).otherwise(False)
    if mode == "regex":
        return hit
    near = low.contains(source.lower()) if mode == "case_insensitive" and source.isascii() else t.contains(source) if mode != "case_insensitive" else F.lit(True)
    return F.when(near, hit).otherwise(False)


def glossary_usage(rows: DataFrame, glossary: DataFrame, source: str, target: str) -> DataFrame:
    """One row: entry and hit counts by distinct key, and the share of preferred entries that were adopted."""
    g = glossary.select(F.lower("source").alias("s"), F.lower("target").alias("t"), "level", F.lower(F.trim("source")).alias("key"))
    hits = rows.join(F.broadcast(g), F.lower(source).contains(F.col("s")) | F.lower(target).contains(F.col("t")))
    flagged = hits.groupBy("key").agg(
        F.max(F.lower(source).contains(F.col("s"))).alias("in_source"), F.max(F.lower(target).contains(F.col("t"))).alias("in_target"), F.max(F.lower(target).contains(F.col("t")) & (F.col("level") == "preferred")).alias("adopted")
    )
    n = lambda c: F.count(F.when(c, 1))
    counts = g.agg(F.count(F.lit(1)).alias("entry_count"), n(F.col("level") == "preferred").alias("preferred_count"))
    used = flagged.agg(n(F.col("in_source")).alias("source_hit_entry_count"), n(F.col("in_target")).alias("target_hit_entry_count"), n(F.col("in_source") & ~F.col("in_target")).alias("unapplied_source_hit_entry_count"), n(F.col("adopted")).alias("preferred_hit_entry_count"))
    rate = F.when(F.col("preferred_count") > 0, F.round(F.col("preferred_hit_entry_count") / F.col("preferred_count"), 4)).otherwise(0.0)
    return used.join(counts, how="cross").select("entry_count", "source_hit_entry_count", "target_hit_entry_count", F.greatest(F.lit(0), F.col("entry_count") - F.col("source_hit_entry_count")).alias("unused_entry_count"), "unapplied_source_hit_entry_count", "preferred_hit_entry_count", rate.alias("preferred_adoption_rate"))


def term_pairs(rows: DataFrame, text: str, item: str = "item_id") -> DataFrame:
    """(item, key, value, score): a CJK term with its English name in brackets after it, in full-width or ASCII brackets."""
    t = T.normalize_text(F.col(text))
    found = [F.arrays_zip(F.regexp_extract_all(t, F.lit(p), F.lit(2)).alias("key"), F.regexp_extract_all(t, F.lit(p), F.lit(1)).alias("value")) for p in TERM_PAIRS]
    pairs = rows.select(item, F.explode(F.concat(*found)).alias("p")).select(item, F.btrim("p.key", F.lit(TRIM_CHARS + " ")).alias("key"), F.col("p.value").alias("value"), F.lit(1.0).alias("score"))
    return pairs.where("length(key) >= 2").distinct()


# --- memory ----------------------------------------------------------------------


def fold_memory(occurrences: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys..., hits, value, sources): terms folded in order; a later value replaces one unless it lacks CJK where the other has it; the last 8 distinct sources.

    ``occurrences``: keys..., value, source and the order columns.
    """
    o = F.struct(*order)
    cjk = F.col("value").rlike("[一-鿿]")
    firsts = occurrences.groupBy(*keys, "source").agg(F.min(o).alias("__o"))
    sources = firsts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__o", "source"))).alias("s")).select(*keys, F.transform(F.slice("s", F.greatest(F.lit(1), F.size("s") - SOURCES + 1), F.lit(SOURCES)), lambda x: x["source"]).alias("sources"))
    agg = occurrences.groupBy(*keys).agg(F.count(F.lit(1)).alias("hits"), F.max_by("value", o).alias("__any"), F.max(F.when(cjk, F.struct(o.alias("o"), F.col("value")))).alias("__zh"))
    return agg.join(sources, keys).select(*keys, "hits", F.coalesce("__zh.value", "__any").alias("value"), "sources")


def trim_memory(memory: DataFrame, partition: list[str], key: str, most: int = MEMORY_TERMS) -> DataFrame:
    """The ``most`` records with the largest (hits, key)."""
    w = Window.partitionBy(*partition).orderBy(F.desc("hits"), F.desc(key))
    return memory.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= most).drop("__k")


def prompt_terms(memory: DataFrame, partition: list[str], key: str, most: int = PROMPT_TERMS) -> DataFrame:
    """Adds rank: the first ``most`` records by hits descending, key ascending."""
    w = Window.partitionBy(*partition).orderBy(F.desc("hits"), key)
    return memory.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
