"""Translation policies as one ordered label cascade over rows, with counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.outputs import let

#: Labels that a model may give, and that mean "keep the original".
MODEL_KEEPS = ("code", "no_trans", "keep_origin", "skip_model_keep_origin")


def at_or_after(page: Column, block: Column, cutoff_page: Column, cutoff_block: Column) -> Column:
    """(page, block) >= cutoff; false where the cutoff is not known in both parts."""
    return F.coalesce((page > cutoff_page) | ((page == cutoff_page) & (block >= cutoff_block)), F.lit(False)) & cutoff_page.isNotNull() & cutoff_block.isNotNull()


def keep_origin_reason(source: Column, policy: Column, caption_like: Column, zone: Column) -> Column:
    """Why an item is kept without a request, by the first rule that holds; null where none does."""
    compact = T.normalize_text(T.strip_placeholders(source))
    short = (F.length(compact) <= 4) & compact.rlike(r"^[\p{L}\p{N} ]+$")
    return (
        F.when(F.trim(F.coalesce(source, F.lit(""))) == "", "empty_source_text").when(compact == "", "placeholder_only").when(policy.eqNullSafe(F.lit(False)), "policy_skip").when(T.is_hard_metadata(source), "hard_metadata_fragment")
        .when(short & caption_like, "short_non_body_label").when(short & ~F.coalesce(policy, F.lit(False)) & (zone == "non_flow"), "short_non_body_label")
    )


def model_label(label: Column, existing: Column, grouped: Column, bodylike: Column, codelike: Column, short: Column) -> Column:
    """The label to set from a model's answer; null where it is refused: settled labels stay, group members and prose are translated."""
    settled = F.coalesce(existing, F.lit("")).rlike("^(translate_|skip_|code)")
    keep = label.isin(*MODEL_KEEPS)
    refused = keep & (grouped | (bodylike & ~codelike) | ~short)
    mapped = F.when(keep, "skip_model_keep_origin").otherwise(label)
    return F.when(~settled & label.isNotNull() & (label != "translate") & ~refused, mapped)


def content_labels(rows: DataFrame, metadata_pages: int = 8, metadata: bool = True) -> DataFrame:
    """Adds content_label, what apply_policies() says of a text by itself: metadata fragment (first pages only), CJK source, code; else empty.

    ``rows``: text, page_idx, kind, is_bodylike.  Where it is added before a cutoff is joined, texts don't shuffle.
    """
    first = F.col("page_idx") <= metadata_pages if metadata else F.lit(False)

    # by a lambda: as one expression of the stage's code, the rules make a method that the JVM doesn't compile
    def decide(t: Column) -> Column:
        return F.when(F.when(first, T.is_hard_metadata(t, clean=True)).otherwise(False), "skip_metadata_fragment").when(T.is_cjk_dominant(t, clean=True), "skip_cjk_source_body").when(
            (F.col("kind") == "code") | F.when(F.col("is_bodylike"), T.is_code_literal(t, clean=True)).otherwise(False), "code").otherwise("")

    return rows.withColumn("content_label", let(T.normalize_text(F.col("text")), decide))


def apply_policies(rows: DataFrame, metadata_pages: int = 8, reference_tail: bool = True, metadata: bool = True, titles: bool = True) -> DataFrame:
    """Adds label and should_translate.  Order: title, reference tail, metadata fragment (first pages only), CJK source, code, forced literal.

    ``rows``: text, page_idx, block_idx, cutoff_page, cutoff_block, is_title_like, kind, is_bodylike; or content_label in place of text, kind and is_bodylike.  A flag turns its rule off.
    """
    if "content_label" not in rows.columns:
        rows = content_labels(rows, metadata_pages, metadata)
        return apply_policies(rows, metadata_pages, reference_tail, metadata, titles).drop("content_label")
    tail = at_or_after(F.col("page_idx"), F.col("block_idx"), F.col("cutoff_page"), F.col("cutoff_block"))
    on = lambda flag, cond: cond if flag else F.lit(False)
    label = F.when(on(titles, F.col("is_title_like")), "skip_title").when(on(reference_tail, tail), "skip_reference_tail").otherwise(F.col("content_label"))
    return rows.withColumn("label", label).withColumn("should_translate", F.col("label") == "")


def policy_counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("should_translate").cast("long")).alias("to_translate"))


def page_summaries(rows: DataFrame, *page: str) -> DataFrame:
    """Totals by page: kept originals count as translated; pending are those to translate with neither."""
    done = (F.trim(F.coalesce("translated_text", F.lit(""))) != "") | (F.trim(F.coalesce("final_status", F.lit(""))) == "kept_origin")
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy(*page).agg(F.count(F.lit(1)).alias("total_items"), n(done).alias("translated_items"), n(F.col("should_translate") & ~done).alias("pending_items"), n(~F.col("should_translate")).alias("skipped_items"))


def expand_ranges(spec: Column) -> Column:
    """Sorted distinct pages of "1~3,7": reversed ranges count too, anything else is dropped."""
    parts = F.split(F.coalesce(spec, F.lit("")), ",")
    valid = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(\s*[~-]\s*\d+)?$"))
    bounds = F.transform(valid, lambda p: F.split(p, r"\s*[~-]\s*"))
    lists = F.transform(bounds, lambda b: F.sequence(F.least(b[0].cast("int"), F.element_at(b, -1).cast("int")), F.greatest(b[0].cast("int"), F.element_at(b, -1).cast("int"))))
    return F.array_sort(F.array_distinct(F.flatten(lists)))
