"""Layout, semantic and structure roles of blocks, and the translate policy, as native Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
LAYOUT_OF_SUB_TYPE = {"title": "title", "heading": "heading", "body": "paragraph", "header": "header", "footer": "footer", "page_number": "page_number", "footnote": "footnote"}
STRUCTURE_OF_LAYOUT = {
    "title": "title", "heading": "heading", "paragraph": "body", "list_item": "body", "caption": "caption", "footnote": "footnote", "header": "metadata", "footer": "metadata", "page_number": "metadata",
}
ANCILLARY = ("header", "footer", "page_number", "footnote", "caption")
CAPTION_SUB_TYPES = ("caption", "figure_caption", "image_caption", "table_caption", "code_caption")
CONTRACT_CAPTION_TAGS = ("caption", "image_caption", "table_caption", "table_footnote", "image_footnote")
CAPTION_TAGS = ("caption", "figure_caption", "image_caption", "table_caption", "table_footnote", "image_footnote")
FOOTNOTE_TAGS = ("footnote", "image_footnote", "table_footnote", "vision_footnote")
REFERENCE_TAGS = ("reference_entry", "reference_zone")
CAPTION_BLOCKS = ("figure_caption", "image_caption", "table_caption", "table_footnote")
BODYLIKE_LAYOUT = ("paragraph", "list_item")
BODYLIKE_SEMANTIC = ("body", "abstract")
BODYLIKE_STRUCTURE = ("", "body", "abstract", "example_line", "option_header", "option_description", "example_intro")
TEXTUAL_LAYOUT = ("title", "heading", "paragraph", "list_item", "caption")
# -----------------------------------------------------------------------------


def clean(c: Column) -> Column:
    """Trimmed and lower-cased; null is empty."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def _mapped(c: Column, table: dict[str, str], default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], default)


def _known(c: Column) -> Column:
    """The role where one is given and known."""
    return F.when(~clean(c).isin("", "unknown"), clean(c))


def has_any_tag(tags: Column, wanted: tuple[str, ...]) -> Column:
    low = F.transform(F.coalesce(tags, F.array().cast("array<string>")), clean)
    return F.arrays_overlap(low, F.array(*[F.lit(x) for x in wanted]))


def layout_role(explicit: Column, kind: Column, sub_type: Column, derived: Column, tags: Column) -> Column:
    sub = clean(sub_type)
    caption = (clean(derived) == "caption") | has_any_tag(tags, CONTRACT_CAPTION_TAGS) | sub.isin(*CAPTION_SUB_TYPES)
    of_text = _mapped(sub, LAYOUT_OF_SUB_TYPE, F.when(caption, "caption").otherwise("paragraph"))
    return F.coalesce(_known(explicit), F.when(clean(kind) == "text", of_text).otherwise("unknown"))


def semantic_role(explicit: Column, kind: Column, sub_type: Column, derived: Column, tags: Column, layout: Column) -> Column:
    role, sub = clean(derived), clean(sub_type)
    found = (
        F.when((role == "abstract") | has_any_tag(tags, ("abstract",)), "abstract")
        .when((role == "formula_number") | (sub == "formula_number"), "metadata")
        .when((role == "reference_entry") | has_any_tag(tags, REFERENCE_TAGS) | (sub == "reference_entry"), "reference")
        .when((sub == "metadata") | (role == "metadata"), "metadata")
        .when(role.isin("acknowledgments", "acknowledgements", "acknowledgement"), "acknowledgement")
        .when(role == "affiliation", "affiliation")
        .when(layout.isin(*ANCILLARY), "metadata")
        .when((clean(kind) == "text") & layout.isin("paragraph", "list_item"), "body")
        .otherwise("unknown")
    )
    return F.coalesce(_known(explicit), found)


def structure_role(explicit: Column, from_metadata: Column, sub_type: Column, layout: Column, semantic: Column) -> Column:
    found = (
        F.when((clean(sub_type) == "reference_entry") | (semantic == "reference"), "reference_entry")
        .when(semantic == "abstract", "body")
        .when(semantic == "metadata", "metadata")
        .otherwise(_mapped(layout, STRUCTURE_OF_LAYOUT, F.lit("")))
    )
    return F.coalesce(_known(explicit), _known(from_metadata), found)


def translate_policy(kind: Column, layout: Column, semantic: Column) -> Column:
    """struct(translate, reason)."""
    says = lambda yes, why: F.struct(F.lit(yes).alias("translate"), why.alias("reason"))
    return (
        F.when(kind != "text", says(False, F.lit("non_text")))
        .when(layout.isin(*ANCILLARY), says(False, F.concat(F.lit("layout_role="), layout)))
        .when(semantic.isin("reference", "metadata", "affiliation", "acknowledgement", "unknown"), says(False, F.concat(F.lit("semantic_role="), semantic)))
        .when(layout.isin("title", "heading", "paragraph", "list_item") & (semantic == "abstract"), says(True, F.lit("semantic_role=abstract")))
        .when(layout.isin("title", "heading", "paragraph", "list_item") & (semantic == "body"), says(True, F.lit("main_text")))
        .otherwise(says(False, F.lit("conservative_skip")))
    )


def is_caption_like(layout: Column, structure: Column, derived: Column, tags: Column, block_type: Column) -> Column:
    return (structure == "figure_caption") | (layout == "caption") | clean(derived).isin("caption", "figure_caption") | has_any_tag(tags, CAPTION_TAGS) | clean(block_type).isin(*CAPTION_BLOCKS)


def is_footnote_like(layout: Column, structure: Column, derived: Column, tags: Column, block_type: Column) -> Column:
    return (layout == "footnote") | structure.isin(*FOOTNOTE_TAGS) | clean(derived).isin(*FOOTNOTE_TAGS) | has_any_tag(tags, FOOTNOTE_TAGS) | clean(block_type).isin(*FOOTNOTE_TAGS)


def is_reference_entry_role(semantic: Column, structure: Column, derived: Column, tags: Column) -> Column:
    return (semantic == "reference") | (structure == "reference_entry") | (clean(derived) == "reference_entry") | has_any_tag(tags, REFERENCE_TAGS)


def is_title_like(layout: Column, structure: Column) -> Column:
    return layout.isin("title", "heading") | structure.isin("title", "heading", "section_heading")


def is_bodylike_role(layout: Column, semantic: Column, structure: Column) -> Column:
    return semantic.isin(*BODYLIKE_SEMANTIC) | structure.isin(*BODYLIKE_STRUCTURE) | layout.isin(*BODYLIKE_LAYOUT)


def is_textual(kind: Column, layout: Column) -> Column:
    return (kind == "text") | layout.isin(*TEXTUAL_LAYOUT)


def effective_role(layout: Column, semantic: Column, structure: Column) -> Column:
    none = F.lit("")
    return F.coalesce(F.nullif(clean(layout), none), F.nullif(clean(semantic), none), F.nullif(clean(structure), none), none)


def continuation_hint(hint: Column) -> Column:
    """A hint struct with trimmed strings, reading order of -1 at least and confidence in [0, 1]."""
    text = lambda f: F.coalesce(F.trim(hint[f]), F.lit("")).alias(f)
    return F.struct(
        text("source"), text("group_id"), text("role"), text("scope"),
        F.greatest(F.lit(-1), F.coalesce(hint["reading_order"], F.lit(-1))).alias("reading_order"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(hint["confidence"], F.lit(0.0)))).alias("confidence"),
    )
