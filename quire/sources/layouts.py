"""Page-layout dialects: four JSON payloads, each parsed by schema into one row per block.

A payload is one JSON string (one file read with ``wholetext``).  Parsing is ``from_json`` and ``posexplode``: no Python, and blocks spread
over tasks as soon as they are rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import roles as R
from quire.functions import text as T

GENERIC = "provider string, pages array<struct<width: double, height: double, unit: string, blocks: array<struct<type: string, sub_type: string, bbox: array<double>, text: string, tags: array<string>, derived: struct<role: string>>>>>"
PADDLE = (
    "dataInfo struct<pages: array<struct<width: double, height: double>>>, preprocessedImages array<string>, layoutParsingResults array<struct<prunedResult: struct<width: double, height: double, "
    "parsing_res_list: array<struct<block_label: string, block_content: string, block_bbox: array<double>, block_id: int, group_id: int, block_order: int>>>>>"
)
_SPANS = "lines: array<struct<bbox: array<double>, spans: array<struct<type: string, content: string, bbox: array<double>>>>>"
_CHILD = f"type: string, sub_type: string, bbox: array<double>, {_SPANS}"
MINERU = f"pdf_info array<struct<page_size: array<double>, para_blocks: array<struct<{_CHILD}, blocks: array<struct<{_CHILD}, blocks: array<struct<{_CHILD}>>>>>>>>"
CONTENT_LIST = "array<array<struct<type: string, bbox: array<double>, content: map<string, string>>>>"

# --- fixed values ------------------------------------------------------------
GENERIC_LAYOUT = {"title": "title", "heading": "heading", "abstract": "paragraph", "body": "paragraph", "header": "header", "footer": "footer", "page_number": "page_number", "footnote": "footnote"}
GENERIC_STRUCTURE = {"title": "title", "heading": "heading", "abstract": "body", "body": "body", "reference_entry": "reference_entry", "footnote": "footnote"}
#: label: (kind, sub type, tags)
PADDLE_LABELS = {
    "doc_title": ("text", "title", ["title"]), "abstract": ("text", "body", ["abstract"]), "text": ("text", "body", []), "paragraph_title": ("text", "heading", ["heading"]),
    "reference_content": ("text", "reference_entry", ["reference_entry", "reference_zone", "skip_translation"]), "formula_number": ("text", "formula_number", ["formula_number", "skip_translation"]),
    "header": ("text", "header", ["skip_translation"]), "footer": ("text", "footer", ["skip_translation"]), "footnote": ("text", "footnote", ["footnote", "skip_translation"]),
    "aside_text": ("text", "metadata", ["metadata", "skip_translation"]), "number": ("text", "page_number", ["skip_translation"]), "figure_title": ("text", "figure_caption", ["caption", "figure_caption"]),
    "table": ("table", "table_html", ["table"]), "chart": ("image", "image_body", ["image", "skip_translation"]), "header_image": ("image", "image_body", ["image", "skip_translation"]),
    "footer_image": ("image", "image_body", ["image", "skip_translation"]), "image": ("image", "image_body", ["image", "skip_translation"]), "algorithm": ("code", "code_block", ["code"]),
    "display_formula": ("formula", "display_formula", ["formula"]), "formula": ("formula", "display_formula", ["formula"]), "vision_footnote": ("text", "footnote", ["footnote"]),
}
#: raw type: (kind, sub type)
CONTENT_LIST_TYPES = {"title": ("text", "title"), "paragraph": ("text", "body"), "page_header": ("text", "header"), "page_footer": ("text", "footer"), "page_number": ("text", "page_number"), "page_aside_text": ("text", "metadata")}
# -----------------------------------------------------------------------------

COLUMNS = ["document_id", "provider", "page_index", "order", "block_id", "kind", "sub_type", "raw_label", "text", "tags", "bbox", "page_width", "page_height", "policy", "given_semantic", "given_structure", "given_layout"]
_adapters: dict[str, tuple[Callable[[Column], Column], Callable[[DataFrame], DataFrame]]] = {}


def register(provider: str, detects: Callable[[Column], Column], parse: Callable[[DataFrame], DataFrame]) -> None:
    """Adds a dialect, or replaces the one of this name in its place; the first that detects a payload parses it."""
    _adapters[provider] = (detects, parse)


def detect(payload: Column) -> Column:
    """The provider of a JSON string; null where none fits."""
    out: Column | None = None
    for provider, (detects, _) in _adapters.items():
        out = F.when(detects(payload), provider) if out is None else out.when(detects(payload), provider)
    return out if out is not None else F.lit(None).cast("string")


def adapt(payloads: DataFrame) -> DataFrame:
    """(document_id, payload) to block rows (COLUMNS).  Each dialect filters its own payloads before it parses."""
    found = payloads.withColumn("provider", detect(F.col("payload")))
    out = None
    for provider, (_, parse) in _adapters.items():
        part = parse(found.where(F.col("provider") == provider)).withColumn("provider", F.lit(provider)).select(*COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out


def read(spark, path: str) -> DataFrame:
    """One payload per file: (document_id = path, payload)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document_id"), F.col("value").alias("payload"))


def _block_id(page: Column, order: Column) -> Column:
    return F.concat(F.lit("p"), F.lpad((page + 1).cast("string"), 3, "0"), F.lit("-b"), F.lpad(order.cast("string"), 4, "0"))


def _box(c: Column) -> Column:
    """Four numbers, or a zero box."""
    return F.when(F.size(c) == 4, c).otherwise(F.array(*[F.lit(0.0)] * 4))


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(R.clean(c), F.lit("")), F.lit(default))


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _finish(rows: DataFrame, **columns: Column) -> DataFrame:
    """Fills the columns a dialect does not give."""
    given = {"policy": F.lit(None).cast("struct<translate: boolean, reason: string>")} | {f"given_{r}": F.lit(None).cast("string") for r in ("semantic", "structure", "layout")} | columns
    return rows.withColumns(given).withColumn("block_id", _block_id(F.col("page_index"), F.col("order")))


def _generic(rows: DataFrame) -> DataFrame:
    """Flat blocks; body text between the title and an abstract or heading counts as author lines."""
    pages = rows.select("document_id", F.posexplode(F.from_json("payload", GENERIC)["pages"]).alias("page_index", "page"))
    b = pages.select("document_id", "page_index", F.col("page.width").alias("page_width"), F.col("page.height").alias("page_height"), F.posexplode("page.blocks").alias("order", "b"))
    b = b.withColumns({"kind": _or(F.col("b.type"), "text"), "sub_type": _or(F.col("b.sub_type"), "body")})
    w = Window.partitionBy("document_id", "page_index").orderBy("order")
    explicit = F.coalesce(F.nullif(R.clean(F.col("b.derived.role")), F.lit("")), F.col("sub_type"))
    gap = (F.col("kind") == "text") & (F.col("sub_type") == "body") & (F.lag(explicit).over(w) == "title") & F.lead(explicit).over(w).isin("abstract", "heading")
    b = b.withColumn("gap", F.coalesce(gap, F.lit(False)))
    text, sub = F.col("kind") == "text", F.col("sub_type")
    says = lambda yes, why: F.struct(F.lit(yes).alias("translate"), why.alias("reason"))
    policy = (
        F.when(F.col("gap"), says(False, F.lit("provider_front_matter:title_abstract_gap"))).when(~text, says(False, F.concat(F.lit("provider_non_text:"), F.col("kind"))))
        .when(sub.isin("abstract", "body", "heading"), says(True, F.concat(F.lit("provider_body_whitelist:"), sub))).otherwise(says(False, F.concat(F.lit("provider_non_body:"), sub)))
    )
    semantic = (
        F.when(F.col("gap"), "metadata").when(~text, "unknown").when(sub == "abstract", "abstract").when(sub.isin("header", "footer", "page_number", "footnote", "metadata"), "metadata").when(sub == "reference_entry", "reference").when(sub == "body", "body").otherwise("unknown")
    )
    return _finish(
        b, raw_label=F.coalesce("b.type", F.lit("text")), text=F.coalesce("b.text", F.lit("")), tags=F.coalesce("b.tags", _strings()), bbox=_box(F.col("b.bbox")), policy=policy, given_semantic=semantic,
        given_structure=F.when(text, R._mapped(sub, GENERIC_STRUCTURE, F.lit(""))).otherwise(""), given_layout=F.when(text, R._mapped(sub, GENERIC_LAYOUT, F.lit("unknown"))).otherwise("unknown"),
    )


def paddle_kind(label: Column) -> Column:
    """struct(kind, sub_type, tags) of a layout label."""
    out = None
    for name, (kind, sub, tags) in PADDLE_LABELS.items():
        value = F.struct(F.lit(kind).alias("kind"), F.lit(sub).alias("sub_type"), _strings(*tags).alias("tags"))
        out = F.when(R.clean(label) == name, value) if out is None else out.when(R.clean(label) == name, value)
    return out.otherwise(F.struct(F.lit("unknown").alias("kind"), F.lit("").alias("sub_type"), _strings("unknown").alias("tags")))


def _paddle(rows: DataFrame) -> DataFrame:
    """Layout results aligned by position with page sizes."""
    doc = rows.select("document_id", F.from_json("payload", PADDLE).alias("d"))
    pages = doc.select("document_id", F.posexplode("d.layoutParsingResults.prunedResult").alias("page_index", "p"), F.col("d.dataInfo.pages").alias("sizes"))
    b = pages.select(
        "document_id", "page_index", F.coalesce(F.get("sizes", F.col("page_index"))["width"], F.col("p.width")).alias("page_width"), F.coalesce(F.get("sizes", F.col("page_index"))["height"], F.col("p.height")).alias("page_height"),
        F.posexplode("p.parsing_res_list").alias("order", "b"),
    ).withColumn("k", paddle_kind(F.col("b.block_label")))
    return _finish(b, kind=F.col("k.kind"), sub_type=F.col("k.sub_type"), tags=F.col("k.tags"), raw_label=F.col("b.block_label"), text=F.coalesce("b.block_content", F.lit("")), bbox=_box(F.col("b.block_bbox")))


def _spans_text(lines: Column) -> Column:
    spans = F.coalesce(F.flatten(F.transform(lines, lambda x: F.transform(x["spans"], lambda s: s["content"]))), _strings())
    return F.array_join(F.filter(spans, lambda s: F.trim(F.coalesce(s, F.lit(""))) != ""), " ")


def mineru_kind(raw_type: Column, raw_sub: Column, has_text: Column) -> Column:
    kinds = lambda k, s: F.struct(F.lit(k).alias("kind"), F.lit(s).alias("sub_type"))
    t = raw_type
    return (
        F.when(t == "title", kinds("text", "title")).when(t == "interline_equation", kinds("formula", "display_formula")).when(t.isin("image", "image_body"), kinds("image", "figure")).when(t.isin("table", "table_body"), kinds("table", "table_body"))
        .when(t.isin("code", "code_body") | (R.clean(raw_sub) == "algorithm"), kinds("code", "code_block")).when(t == "page_header", kinds("text", "header")).when(t == "page_footer", kinds("text", "footer"))
        .when(t == "page_number", kinds("text", "page_number")).when(t.isin("image_footnote", "table_footnote"), kinds("text", "footnote")).when(t.isin("text", "list"), kinds("text", "body")).when(has_text, kinds("text", "metadata")).otherwise(kinds("unknown", ""))
    )


def _mineru(rows: DataFrame) -> DataFrame:
    """Paragraph blocks with up to two levels of children, in pre-order."""
    pages = rows.select("document_id", F.posexplode(F.from_json("payload", MINERU)["pdf_info"]).alias("page_index", "p"))
    top = pages.select("document_id", "page_index", F.get("p.page_size", F.lit(0)).alias("page_width"), F.get("p.page_size", F.lit(1)).alias("page_height"), F.posexplode("p.para_blocks").alias("i0", "b0"))
    level1 = top.select("*", F.posexplode("b0.blocks").alias("i1", "b1"))
    level2 = level1.select("*", F.posexplode("b1.blocks").alias("i2", "b2"))
    part = lambda df, b, i1, i2: df.select(
        "document_id", "page_index", "page_width", "page_height", F.struct("i0", i1.alias("i1"), i2.alias("i2")).alias("path"), F.col(f"{b}.type").alias("raw_label"), F.col(f"{b}.sub_type").alias("raw_sub"), _box(F.col(f"{b}.bbox")).alias("bbox"), _spans_text(F.col(f"{b}.lines")).alias("text")
    )
    none = F.lit(-1)
    flat = part(top, "b0", none, none).unionByName(part(level1, "b1", F.col("i1"), none)).unionByName(part(level2, "b2", F.col("i1"), F.col("i2")))
    flat = flat.withColumn("order", F.row_number().over(Window.partitionBy("document_id", "page_index").orderBy("path")) - 1).withColumn("k", mineru_kind(F.col("raw_label"), F.col("raw_sub"), F.col("text") != ""))
    return _finish(flat, kind=F.col("k.kind"), sub_type=F.col("k.sub_type"), tags=_strings())


def _content_list(rows: DataFrame) -> DataFrame:
    """A list of pages of blocks; text is all strings of a block's content."""
    pages = rows.select("document_id", F.posexplode(F.from_json("payload", CONTENT_LIST)).alias("page_index", "p"))
    b = pages.select("document_id", "page_index", F.posexplode("p").alias("order", "b"))
    spans = F.regexp_extract_all(F.array_join(F.map_values("b.content"), " "), F.lit(r'"content"\s*:\s*"((?:[^"\\]|\\.)*+)"'), F.lit(1))
    plain = F.array_join(F.map_values("b.content"), " ")
    text = F.when(F.size(spans) > 0, F.array_join(spans, " ")).otherwise(plain)
    kind = None
    for name, (k, s) in CONTENT_LIST_TYPES.items():
        value = F.struct(F.lit(k).alias("kind"), F.lit(s).alias("sub_type"))
        kind = F.when(F.col("b.type") == name, value) if kind is None else kind.when(F.col("b.type") == name, value)
    other = F.struct(F.when(F.col("b.type").contains("equation"), "formula").when(F.col("b.type").isin("image", "table", "code"), F.col("b.type")).otherwise("unknown").alias("kind"), F.coalesce("b.type", F.lit("")).alias("sub_type"))
    b = b.withColumn("k", kind.otherwise(other))
    size = lambda i: F.max(F.get("b.bbox", F.lit(i))).over(Window.partitionBy("document_id", "page_index"))
    return _finish(b, kind=F.col("k.kind"), sub_type=F.col("k.sub_type"), tags=_strings(), raw_label=F.col("b.type"), text=T.normalize_text(text), bbox=_box(F.col("b.bbox")), page_width=size(2), page_height=size(3))


register("generic_flat_ocr", lambda p: F.get_json_object(p, "$.provider").eqNullSafe("generic_flat_ocr") & F.get_json_object(p, "$.pages").isNotNull(), _generic)
register("paddle", lambda p: F.get_json_object(p, "$.layoutParsingResults").isNotNull(), _paddle)
register("mineru", lambda p: F.get_json_object(p, "$.pdf_info").isNotNull(), _mineru)
register("mineru_content_list_v2", lambda p: F.ltrim(p).startswith("["), _content_list)


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """A fifth dialect: (id, order, tag, text) of headings, paragraphs and list items of raw HTML, tags and entities of white space dropped."""
    pattern = r"(?is)<(h[1-6]|p|li)\b[^>]*>(.*?)</\1>"
    body = F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1>", "")
    found = F.arrays_zip(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)).alias("tag"), F.regexp_extract_all(body, F.lit(pattern), F.lit(2)).alias("inner"))
    return pages.select(id_col, F.posexplode(found).alias("order", "b")).select(id_col, F.col("order").cast("long").alias("order"), F.lower("b.tag").alias("tag"), T.normalize_text(F.regexp_replace("b.inner", "<[^>]*>", " ")).alias("text"))
