"""Results back to records: canonical results of a batch, and their texts, states and units on the items they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import spans
from quire.functions import text as T
from quire.operators.outputs import json_text, let
from quire.operators.results import force_body

# --- fixed values ------------------------------------------------------------
GROUP_PREFIX, KEEP, KEPT_LABEL, KEEP_WORDS = "__cg__:", "keep_origin", "skip_model_keep_origin", ("keep", "skip", "no_translate", "keeporigin", "keep_origin")
MATH_SPAN = r"(?<!\\)\$(?:\\.|[^$\\\n])++(?<!\\)\$"
SOURCE_END = r"[.!?。！？；;:：)\]）】”’\"']\s*$"
DANGLING = r"[，,、\s]*(?:在|为|是|等于|对于)\s*$"
LEAK_LEAST = 8
WEIGHED_TOKEN, WORD_SIGN = r"<[futnvc]\d+-[0-9a-z]{3}/>|\[\[FORMULA_\d+]]", r"[A-Za-z0-9_\-./]"
REASONING = ("保持简洁", "按照规则", "因此输出", "综上，输出", "注意：原文", "译文也应保留")
REASONING_ENDS = (r"(?s)(?:综上，输出。?|因此输出：?)\s*(.+?)\s*$", r"(?s)输出[:：]\s*(.+?)\s*$")
REASONING_CHARS, REASONING_SHARE = 180, 0.35
# -----------------------------------------------------------------------------


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), rf"^{T.SPACES}+|{T.SPACES}+$", "")


def _rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{T.SPACES}+$", "")


def decision_of(c: Column) -> Column:
    d = F.replace(F.lower(F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit("translate")))), F.lit("-"), F.lit("_"))
    return F.when(d.isin(*KEEP_WORDS), KEEP).otherwise("translate")


def unwrap(text: Column, item_id: Column) -> Column:
    """The text inside up to three JSON shells: its translated_text, or that of the entry of this item or of the only one."""

    def once(c: Column) -> Column:
        def inner(obj: Column) -> Column:
            each = F.from_json(F.get_json_object(obj, "$.translations"), "array<struct<item_id:string,translated_text:string>>")
            mine = F.get(F.filter(each, lambda r: (item_id != "") & (F.trim(r["item_id"]) == item_id)), F.lit(0))
            only = F.when(F.size(each) == 1, F.get(each, F.lit(0)))
            found = F.when(mine.isNotNull(), F.coalesce(mine["translated_text"], F.lit(""))).when(only.isNotNull(), F.coalesce(only["translated_text"], F.lit("")))
            return F.coalesce(F.trim(F.coalesce(F.get_json_object(obj, "$.translated_text"), found)), c)

        return F.when(c.contains("translated_text") & c.contains("{"), let(json_text(c), inner)).otherwise(c)

    return let(let(let(_strip(text), once), once), once)


def repair_duplicates(source: Column, output: Column) -> Column:
    """An output that repeats placeholders without the repeats; null where that is not possible or not needed.

    What stays is the first way through the output in the source's order; every placeholder must be the source's.
    """

    def walk(want: Column, got: Column) -> Column:
        start = F.struct(F.lit(0).alias("p"), F.array().cast("array<string>").alias("kept"))

        def step(acc: Column, t: Column) -> Column:
            hit = F.coalesce(F.get(want, acc["p"]) == t, F.lit(False))
            return F.struct((acc["p"] + hit.cast("int")).alias("p"), F.concat(acc["kept"], F.array(F.when(hit, t).otherwise(""))).alias("kept"))

        return F.aggregate(got, start, step)

    def rebuilt(parts: Column, kept: Column) -> Column:
        joined = F.array_join(F.zip_with(parts, F.concat(kept, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        return _strip(F.regexp_replace(F.regexp_replace(joined, r"[ \t]{2,}", " "), rf"{T.SPACES}+([,.;:!?])", "$1"))

    def decide(want: Column, got: Column) -> Column:
        able = (F.size(want) > 0) & (F.size(got) > F.size(want)) & (F.size(F.array_except(got, want)) == 0)
        out = let(walk(want, got), lambda w: F.when(w["p"] == F.size(want), rebuilt(F.split(output, T.PLACEHOLDER, -1), w["kept"])))
        return F.when(able, let(out, lambda t: F.when(T.placeholder_sequence(t) == want, t)))

    return let(T.placeholder_sequence(source), lambda want: let(T.placeholder_sequence(output), lambda got: decide(want, got)))


def canonical_results(results: DataFrame, records: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, unit_id, seq, decision, translated_text, final_status): results in one form.

    ``results``: doc, unit_id, seq, decision, translated_text, final_status.  ``records``: doc, unit_id, source, bodylike, grouped, with_formulas, one for each unit.  JSON shells are opened, repeated placeholders
    repaired; a text that equals its source without having to be translated is kept as it is.  Results of unknown units only lose their shells.  A null decision is ``translate``; a given status stays.
    """
    rows = results.join(records.select(doc, "unit_id", "source", "bodylike", "grouped", "with_formulas"), [doc, "unit_id"], "left")
    rows = rows.withColumn("decision", decision_of(F.col("decision"))).withColumn("text", unwrap(F.col("translated_text"), F.coalesce("unit_id", F.lit("")))).withColumn("source", F.when(F.col("source").isNotNull(), _strip(F.col("source"))))
    text, source = F.col("text"), F.col("source")
    said = source.isNotNull() & (F.col("decision") != KEEP) & (text != "")
    rows = rows.withColumn("text", F.when(said, F.coalesce(repair_duplicates(source, text), text)).otherwise(text))
    copied = said & (text == source) & ~F.coalesce(force_body(source, F.col("bodylike"), F.col("grouped"), F.col("with_formulas")), F.lit(False))
    rows = rows.withColumn("decision", F.when(copied, KEEP).otherwise(F.col("decision")))
    kept = F.col("decision") == KEEP
    status = F.coalesce(F.nullif("final_status", F.lit("")), F.when(kept, "kept_origin").otherwise("translated"))
    return rows.select(doc, "unit_id", "seq", "decision", F.when(kept, "").otherwise(_strip(text)).alias("translated_text"), status.alias("final_status"))


# --- onto the records ------------------------------------------------------------------


def restore(text: Column, tokens: Column) -> Column:
    """Tokens replaced in map order; formulas come back as inline math."""

    def value(t: Column) -> Column:
        body = F.trim(t["restore_text"])
        bare = F.trim(F.regexp_replace(body, r"^\$([^$\n]+)\$$", "$1"))
        return F.when(t["token_type"] == "formula", F.when(body == "", "").otherwise(F.concat(F.lit("$"), bare, F.lit("$")))).otherwise(F.coalesce(t["restore_text"], F.lit("")))

    return F.aggregate(F.coalesce(tokens, F.array().cast("array<struct<token_tag:string,token_type:string,restore_text:string>>")), text, lambda acc, t: F.when(F.coalesce(t["token_tag"], F.lit("")) == "", acc).otherwise(F.replace(acc, t["token_tag"], value(t))))


def salvaged(text: Column) -> Column:
    """The answer at the end of a text that also tells its reasoning; null where there is none."""
    signs = sum((F.when(text.contains(m), 1).otherwise(0) for m in REASONING), F.lit(0))
    first_line = lambda p: F.trim(F.split(F.trim(F.regexp_extract(text, p, 1)), r"\R")[0])
    fits = lambda c: F.when((c != "") & (F.length(c) < F.greatest(F.lit(REASONING_CHARS), F.length(text) * REASONING_SHARE)), c)
    return F.when(signs >= 2, F.coalesce(*[fits(first_line(p)) for p in REASONING_ENDS]))


def is_open_source(source: Column) -> Column:
    """Does a source end in the middle of a sentence?"""
    return (_strip(source) != "") & ~_strip(source).rlike(SOURCE_END)


def trimmed_leak(text: Column, open_source: Column, own_math: Column, next_math: Column) -> Column:
    """The text without what belongs to the next item: from the first formula on that only the next item's source has.  Null where nothing leaks, the source has an end, or too little is left."""
    able = open_source & (F.size(next_math) > 0) & text.contains("$")
    leaked = F.filter(F.array_except(F.coalesce(next_math, F.array().cast("array<string>")), own_math), lambda m: text.contains(m))
    at = F.array_min(F.transform(leaked, lambda m: F.call_function("instr", text, m)))
    head = F.substring(text, F.lit(1), at - 1)
    short = _rstrip(F.regexp_replace(_rstrip(head), DANGLING, ""))
    sentence = _rstrip(F.regexp_extract(head, r"(?s)^(.*[。！？；])", 1))
    candidate = F.when(F.length(short) >= LEAK_LEAST, short).when(F.length(sentence) >= LEAK_LEAST, sentence)
    return F.when(able, F.when(F.size(leaked) > 0, candidate))


def text_weight(source: Column) -> Column:
    """A source's units, 1 at least: placeholders 3, a run of blanks 0.2, words 0.55 a letter and 1 at least, other signs 1 (an angle 3)."""
    whole = F.coalesce(source, F.lit(""))
    text = F.when(whole.contains("<") | whole.contains("[["), F.regexp_replace(whole, WEIGHED_TOKEN, "\x00")).otherwise(whole)
    n = lambda pattern: F.regexp_count(text, F.lit(pattern))
    left = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    tokens = F.length(text) - F.length(F.translate(text, "\x00", ""))
    angles = F.length(text) - F.length(F.translate(text, "<", ""))
    # runs go at once: sign by sign, a replacement costs a call for every sign
    words, others = F.length(text) - left(f"{WORD_SIGN}+"), left(f"{WORD_SIGN[:-1]}{T.SPACES[1:]}+")
    single = n(rf"(?<!{WORD_SIGN}){WORD_SIGN}(?!{WORD_SIGN})")
    return F.greatest(F.lit(1.0), words * 0.55 + single * 0.45 + n(f"{T.SPACES}+") * 0.2 + others + (tokens + angles) * 2.0)


def _units(records: DataFrame, doc: str) -> DataFrame:
    """Adds __unit and __n: groups of two and more by continuation group or by the group unit that items have; others are units of their own."""
    existing = F.when(F.coalesce("unit_id", F.lit("")).startswith(GROUP_PREFIX), F.col("unit_id"))
    group = F.nullif(F.trim(F.coalesce("continuation_group", F.lit(""))), F.lit(""))
    key = F.when(group.isNotNull(), F.concat(F.lit("continuation:"), group)).when(existing.isNotNull(), F.concat(F.lit("unit:"), existing))
    # items without a group have a key of their own, so that they don't meet in one partition
    rows = records.withColumn("__held", existing).withColumn("__grouped", key.isNotNull()).withColumn("__key", F.coalesce(key, F.concat(F.lit("item:"), F.col("item_id"))))
    w = Window.partitionBy(doc, "__key")
    ids = F.collect_set("__held").over(w)
    rows = rows.withColumn("__n", F.when(F.col("__grouped"), F.count(F.lit(1)).over(w)).otherwise(1)).withColumn("__rank", F.row_number().over(w.orderBy("pos", "item_id")) - 1)
    first = F.first("__held", ignorenulls=True).over(w.orderBy("pos", "item_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    named = F.when(F.size(ids) == 1, ids[0]).when(group.isNotNull(), F.concat(F.lit(GROUP_PREFIX), group)).otherwise(first)
    return rows.withColumn("__unit", F.when(F.col("__n") >= 2, named).otherwise(F.col("item_id"))).drop("__key", "__grouped")


def apply_results(records: DataFrame, results: DataFrame, doc: str = "doc_id") -> DataFrame:
    """records with unit_id, unit_kind, should_translate, label, final_status, protected_translated_text, translated_text and unit_translated_text after ``results``.

    ``records``: doc, item_id, pos, source, tokens (token_tag, token_type, restore_text), should_translate, label, final_status, continuation_group, unit_id, tail_prefix (null: none).  ``results``: doc, unit_id, seq, decision,
    translated_text, final_status; of several for a unit the last counts, unknown units are passed over.  A group's text is split over its members by their sources; a result for the item itself comes after its group's.  Failed results clear the text and
    leave the item to be translated, kept ones clear it and end it.  Items without a result keep what they have.
    """
    last = results.groupBy(doc, "unit_id").agg(F.max_by(F.struct("decision", "translated_text", "final_status"), F.struct("seq", "translated_text")).alias("r"))
    raw = _strip(F.col("r.translated_text"))
    last = last.select(doc, F.col("unit_id").alias("__id"), decision_of(F.col("r.decision")).alias("d"), raw.alias("t0"), F.coalesce("r.final_status", F.lit("")).alias("s0")).withColumn("t1", salvaged(F.col("t0")))
    last = last.select(doc, "__id", "d", F.coalesce("t1", "t0").alias("t"), F.when(F.col("t1").isNotNull(), "partially_translated").otherwise(F.col("s0")).alias("s"))

    # what sources are needed for is computed first, so that texts don't take part in the windows unless the caller keeps them
    source = F.coalesce("source", F.lit(""))
    in_group = (F.trim(F.coalesce("continuation_group", F.lit(""))) != "") | F.coalesce("unit_id", F.lit("")).startswith(GROUP_PREFIX)
    rows = records.withColumn("__math", F.regexp_extract_all(source, F.lit(MATH_SPAN), F.lit(0))).withColumn("__open", is_open_source(source)).withColumn("__weight", F.when(in_group, text_weight(F.col("source"))))
    rows = _units(rows, doc).withColumn("__next", F.lead("__math").over(Window.partitionBy(doc).orderBy("pos", "item_id")))

    # a group's text is split once, then dealt out to the members by rank
    members = rows.where("__n >= 2").groupBy(doc, "__unit").agg(F.array_sort(F.collect_list(F.struct("__rank", "__weight"))).alias("m"), F.max_by("tokens", -F.col("__rank")).alias("__tokens"))
    grouped = members.join(last.withColumnRenamed("__id", "__unit"), [doc, "__unit"])
    split = spans.split_group_udf(F.col("t"), F.transform("m", lambda x: x["__weight"]))
    parts = F.when((F.col("d") != KEEP) & (F.col("s") != "failed"), split)
    grouped = grouped.select(doc, "__unit", F.col("d").alias("gd"), F.col("t").alias("gt"), F.col("s").alias("gs"), F.col("__tokens").alias("gtokens"), parts.alias("gparts"))
    single = last.select(doc, F.col("__id").alias("item_id"), F.col("d").alias("id"), F.col("t").alias("it"), F.col("s").alias("is_"))
    rows = rows.join(grouped, [doc, "__unit"], "left").join(single, [doc, "item_id"], "left")

    leak = trimmed_leak(F.col("it"), F.col("__open"), F.col("__math"), F.col("__next"))
    rows = rows.withColumn("__leak", F.when(F.coalesce("it", F.lit("")) != "", leak))
    rows = rows.withColumn("it", F.coalesce("__leak", "it")).withColumn("is_", F.when(F.col("__leak").isNotNull(), "partially_translated").otherwise(F.col("is_")))
    has_g, has_i = F.col("gd").isNotNull(), F.col("id").isNotNull()
    state = lambda has, s, d: F.when(~has, "none").when(s == "failed", "failed").when(d == KEEP, "kept").otherwise("text")
    rows = rows.withColumn("g", state(has_g, F.col("gs"), F.col("gd"))).withColumn("i", state(has_i, F.col("is_"), F.col("id")))
    g, i = F.col("g"), F.col("i")
    skipped = (g == "text") & ~F.coalesce("should_translate", F.lit(True))
    decided = F.when(i != "none", i).otherwise(g)
    part = F.get(F.col("gparts"), F.col("__rank"))
    joined = lambda t: F.when(F.coalesce("tail_prefix", F.lit("")) == "", t).otherwise(_join(F.col("tail_prefix"), t))
    pick = lambda own, group, before: F.when(i == "text", own).when(decided.isin("failed", "kept"), "").when((g == "text") & skipped, "").when(g == "text", group).otherwise(before)
    # what several columns show is computed once
    rows = rows.withColumn("__own", F.when(i == "text", joined(restore(F.col("it"), F.col("tokens")))))
    text = pick(F.col("__own"), restore(part, F.col("gtokens")), F.col("translated_text"))
    protected = pick(joined(F.col("it")), part, F.col("protected_translated_text"))
    whole = pick(F.col("__own"), restore(F.col("gt"), F.col("gtokens")), F.col("unit_translated_text"))
    should = F.when(i == "failed", True).when(i == "kept", False).when(g == "failed", True).when(g == "kept", False).otherwise(F.col("should_translate"))
    label = F.when(i == "failed", "").when(i == "kept", KEPT_LABEL).when(g == "failed", "").when(g == "kept", KEPT_LABEL).otherwise(F.col("label"))
    named = lambda s: F.when(s == "", "translated").otherwise(s)
    status = (
        F.when(i == "failed", "failed").when(i == "kept", "kept_origin").when(i == "text", named(F.col("is_"))).when(g == "failed", "failed").when(g == "kept", "kept_origin").when(skipped, F.col("final_status")).when(g == "text", named(F.col("gs"))).otherwise(F.col("final_status"))
    )
    keeps_group = (i == "text") & F.col("__held").isNotNull()
    unit = F.when(keeps_group, F.col("__held")).otherwise(F.col("__unit"))
    kind = F.when(keeps_group | (F.col("__n") >= 2), "group").otherwise("single")
    others = [c for c in records.columns if c not in ("unit_id", "unit_kind", "should_translate", "label", "final_status", "protected_translated_text", "translated_text", "unit_translated_text")]
    return rows.select(
        *others, unit.alias("unit_id"), kind.alias("unit_kind"), should.alias("should_translate"), label.alias("label"), status.alias("final_status"), protected.alias("protected_translated_text"), text.alias("translated_text"), whole.alias("unit_translated_text"),
    )


def _join(prefix: Column, tail: Column) -> Column:
    left, right = _rstrip(prefix), _strip(tail)
    return F.when(left == "", right).when(right == "", left).when(F.substring(right, 1, 1).isin(*",.;:!?)]}"), F.concat(left, right)).otherwise(F.concat_ws(" ", left, right))
