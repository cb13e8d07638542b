"""The normalised document: defaults with a report, role enrichment, assets, validation, items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import roles as R

#: Enumerations of the contract.
CONTENT_KINDS = ("text", "image", "table", "formula", "code", "unknown")
LAYOUT_ROLES = ("title", "heading", "paragraph", "list_item", "caption", "header", "footer", "footnote", "page_number", "unknown")
SEMANTIC_ROLES = ("body", "abstract", "reference", "metadata", "affiliation", "acknowledgement", "unknown")


def enrich(blocks: DataFrame) -> DataFrame:
    """Adds layout_role, semantic_role, structure_role, policy (given ones stay)."""
    no = F.lit(None).cast("string")
    layout = R.layout_role(F.col("given_layout"), F.col("kind"), F.col("sub_type"), no, F.col("tags"))
    rows = blocks.withColumn("layout_role", layout)
    rows = rows.withColumn("semantic_role", R.semantic_role(F.col("given_semantic"), F.col("kind"), F.col("sub_type"), no, F.col("tags"), F.col("layout_role")))
    rows = rows.withColumn("structure_role", R.structure_role(F.col("given_structure"), no, F.col("sub_type"), F.col("layout_role"), F.col("semantic_role")))
    return rows.withColumn("policy", F.coalesce("policy", R.translate_policy(F.col("kind"), F.col("layout_role"), F.col("semantic_role"))))


def role_profile(rows: DataFrame) -> DataFrame:
    """Adds the boolean predicates over roles and tags."""
    lay, sem, st, no = F.col("layout_role"), F.col("semantic_role"), F.col("structure_role"), F.lit(None).cast("string")
    tags, kind = F.col("tags"), F.col("kind")
    return rows.withColumns(
        {
            "is_caption_like": R.is_caption_like(lay, st, no, tags, kind), "is_footnote_like": R.is_footnote_like(lay, st, no, tags, kind), "is_reference_entry": R.is_reference_entry_role(sem, st, no, tags),
            "is_reference_heading": (st == "reference_heading") | R.has_any_tag(tags, ("reference_heading",)), "is_algorithm": (R.clean(F.col("sub_type")) == "algorithm") | (kind == "algorithm") | R.has_any_tag(tags, ("algorithm",)),
            "is_metadata": (R.clean(F.col("sub_type")) == "metadata") | (sem == "metadata"), "is_title_like": R.is_title_like(lay, st), "is_bodylike": R.is_bodylike_role(lay, sem, st), "is_textual": R.is_textual(kind, lay),
        }
    )


def defaults_report(blocks: DataFrame, defaults: dict[str, Column], *keys: str) -> DataFrame:
    """How many rows lacked each field."""
    return blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("blocks_seen"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"defaulted_{c}") for c in defaults])


def apply_defaults(blocks: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return blocks.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def violations(blocks: DataFrame) -> DataFrame:
    """(document_id, path, message): every broken rule of every block; empty for a valid document."""
    bad = lambda cond, what: F.when(F.coalesce(cond, F.lit(True)), what)
    x = lambda i: F.get("bbox", F.lit(i))
    rules = F.array(
        bad(F.size("bbox") != 4, "bbox: expected 4 numbers"), bad(x(2) < x(0), "bbox: x1 < x0"), bad(x(3) < x(1), "bbox: y1 < y0"), bad(~F.col("kind").isin(*CONTENT_KINDS), "content.kind: unexpected"),
        bad(~F.col("layout_role").isin(*LAYOUT_ROLES), "layout_role: unexpected"), bad(~F.col("semantic_role").isin(*SEMANTIC_ROLES), "semantic_role: unexpected"), bad(F.col("order") < 0, "order: negative"), bad(F.col("policy.translate").isNull(), "policy.translate: missing"), bad(F.trim("block_id") == "", "block_id: empty"),
    )
    path = F.concat(F.lit("pages["), F.col("page_index").cast("string"), F.lit("].blocks["), F.col("order").cast("string"), F.lit("]"))
    return blocks.select("document_id", path.alias("path"), F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("message"))


def strict(blocks: DataFrame) -> DataFrame:
    """The blocks; reading one with an unknown kind or role fails."""
    ok = F.col("kind").isin(*CONTENT_KINDS) & F.col("layout_role").isin(*LAYOUT_ROLES) & F.col("semantic_role").isin(*SEMANTIC_ROLES)
    return blocks.withColumn("__ok", F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid block "), F.col("block_id"))).cast("boolean"))).where("__ok").drop("__ok")


def validation_report(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("document_id").agg(F.countDistinct("page_index").alias("page_count"), F.count(F.lit(1)).alias("block_count"))


def assets(blocks: DataFrame, key: str = "document_id") -> DataFrame:
    """(key, asset_id, uri): of each asset its first block with a non-empty uri."""
    rows = blocks.where("trim(asset_id) <> '' AND trim(uri) <> ''")
    return rows.groupBy(key, "asset_id").agg(F.min(F.struct("page_index", "order", F.trim("uri").alias("uri"))).alias("f")).select(key, "asset_id", F.col("f.uri").alias("uri"))


def translatable(inside_algorithm: Column) -> Column:
    """Explicit policy, unless inside an algorithm; else body text by role without a skip tag."""
    by_role = (F.col("kind") == "text") & ((F.col("semantic_role") == "abstract") | ((F.col("semantic_role") == "body") & (F.col("structure_role") == "body") & F.col("layout_role").isin("paragraph", "unknown", "")))
    allowed = ~inside_algorithm & ~F.col("is_algorithm")
    return F.when(F.col("policy.translate").isNotNull(), F.col("policy.translate") & allowed).otherwise(allowed & ~R.has_any_tag(F.col("tags"), ("skip_translation",)) & by_role)


def text_items(blocks: DataFrame) -> DataFrame:
    """(document_id, item_id, page_idx, block_idx, text, ...): translatable blocks and formulas kept as they are."""
    rows = role_profile(blocks)
    keep = ~R.has_any_tag(F.col("tags"), ("skip_translation",)) & ((F.col("kind") == "formula") | F.col("sub_type").isin("display_formula", "formula"))
    item = F.concat(F.lit("p"), F.lpad((F.col("page_index") + 1).cast("string"), 3, "0"), F.lit("-b"), F.lpad(F.col("order").cast("string"), 3, "0"))
    return rows.where((F.trim("text") != "") & (translatable(F.lit(False)) | keep)).select("document_id", item.alias("item_id"), F.col("page_index").alias("page_idx"), F.col("order").alias("block_idx"), "text", "kind", "layout_role", "semantic_role", "structure_role", "bbox")


def sync_records(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old records brought up to a new extraction: matched ones take the new source and lose their translation if it differs, new ones join, those without a source stay."""
    o, n = old.alias("o"), new.alias("n")
    cond = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = o.join(n, cond, "full_outer")
    same = F.col("n.source_text").isNull() | F.col("o.source_text").eqNullSafe(F.col("n.source_text"))
    return joined.select(
        *[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], F.coalesce("n.source_text", "o.source_text").alias("source_text"), F.when(same, F.col("o.translated_text")).otherwise("").alias("translated_text"),
        F.when(F.col(f"o.{keys[0]}").isNull(), "added").when(F.col(f"n.{keys[0]}").isNull(), "kept").when(same, "unchanged").otherwise("changed").alias("sync"),
    )


def reference_cutoff(rows: DataFrame, key: str, is_heading: Column) -> DataFrame:
    """(key, cutoff_page, cutoff_block): the first title that is a reference heading."""
    return rows.where(is_heading).groupBy(key).agg(F.min(F.struct("page_idx", "block_idx")).alias("c")).select(key, F.col("c.page_idx").alias("cutoff_page"), F.col("c.block_idx").alias("cutoff_block"))


def carry_algorithm(blocks: DataFrame, least: int = 1) -> DataFrame:
    """Adds inside_algorithm: the block before it on the page is an algorithm."""
    w = Window.partitionBy("document_id", "page_index").orderBy("order")
    return blocks.withColumn("inside_algorithm", F.coalesce(F.lag(F.col("is_algorithm"), least).over(w), F.lit(False)))
