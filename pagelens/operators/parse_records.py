"""Canonical parse records and blocks from raw parser output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import normalize_bbox
from ..functions.text import strip

ITEM = "struct<bbox:array<double>,type:string,text:string>"
SPAN = "struct<bbox:array<double>,content:string,type:string>"
MIDDLE = f"struct<pdf_info:array<struct<page_idx:int,para_blocks:array<struct<bbox:array<double>,type:string,lines:array<struct<spans:array<{SPAN}>>>>>>>>"
PARSE_RESULT = f"page_id string, text string, layout array<{ITEM}>, content_list array<{ITEM}>, middle_json {MIDDLE}"
RECORD_DEFAULTS = {"page_text": "", "error_message": "", "raw_output_path": ""}


def layout_type(c: Column) -> Column:
    return F.coalesce(F.nullif(strip(c), F.lit("")), F.lit("unknown"))


def build_blocks(items: Column) -> Column:
    """Blocks in reading order of items with a proper box and text: id b0001..., reading order from 0, ties by place."""
    indexed = F.transform(items, lambda i, n: F.struct(normalize_bbox(i.bbox).alias("bbox"), layout_type(i.type).alias("layout_type"), strip(i.text).alias("text"), n.alias("n")))
    kept = F.filter(indexed, lambda i: i.bbox.isNotNull() & (i.text != ""))
    ordered = F.array_sort(F.transform(kept, lambda i: F.struct(i.bbox[1].alias("y"), i.bbox[0].alias("x"), i.n.alias("n"), i.bbox.alias("bbox"), i.layout_type.alias("layout_type"), i.text.alias("text"))))
    return F.transform(ordered, lambda b, n: F.struct(F.format_string("b%04d", n + 1).alias("block_id"), b.layout_type.alias("layout_type"), b.bbox.alias("bbox"), b.text.alias("text"), F.lit(None).cast("double").alias("confidence"), n.alias("reading_order")))


def block_text(blocks: Column, sep: str = "\n") -> Column:
    return F.array_join(F.transform(blocks, lambda b: b.text), sep)


def normalize_parse(raw: DataFrame) -> DataFrame:
    """One record per page: blocks of the layout (else of the content list), page text (else the joined blocks), status."""
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    items = F.when(some("layout"), F.col("layout")).otherwise(F.coalesce("content_list", F.array().cast(f"array<{ITEM}>")))
    rows = raw.withColumn("blocks", build_blocks(items))
    text = F.coalesce(F.nullif(strip(F.col("text")), F.lit("")), block_text(F.col("blocks")))
    rows = rows.withColumn("page_text", text)
    status = F.when((F.size("blocks") > 0) & (F.col("page_text") != ""), "success").otherwise("empty")
    return rows.select("page_id", "page_text", "blocks", status.alias("parser_status"))


def failed_records(pages: DataFrame, message: str, status: str = "failed") -> DataFrame:
    """Records of pages without a result; blank sizes become 0."""
    side = lambda c: F.coalesce(F.expr(f"try_cast(try_cast({c} AS DOUBLE) AS INT)"), F.lit(0)).alias(c)
    return pages.select("page_id", side("width"), side("height"), F.lit("").alias("page_text"), F.array().cast("array<struct<block_id:string,text:string>>").alias("blocks"), F.lit(status).alias("parser_status"), F.lit(message).alias("error_message"))


def elements(content: DataFrame) -> DataFrame:
    """(page_id, id, x, y, w, h, type, text) of content lists: truncated centres and sizes, text cut to 120, running ids over kept rows."""
    rows = content.select("page_id", F.posexplode("content_list").alias("pos", "i")).filter(F.size("i.bbox") >= 4)
    b = [F.col("i.bbox")[k] for k in range(4)]
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) - 1
    return rows.select("page_id", number.alias("id"), ((b[0] + b[2]) / 2).cast("int").alias("x"), ((b[1] + b[3]) / 2).cast("int").alias("y"), (b[2] - b[0]).cast("int").alias("w"), (b[3] - b[1]).cast("int").alias("h"), F.coalesce("i.type", F.lit("text")).alias("type"), F.substring(F.coalesce("i.text", F.lit("")), 1, 120).alias("text"))


def spans(middle: DataFrame) -> DataFrame:
    """(page_id, x1, y1, x2, y2, text) of the spans four levels down; inverted boxes go."""
    s = F.flatten(F.transform("middle_json.pdf_info", lambda p: F.flatten(F.transform(p.para_blocks, lambda b: F.flatten(F.transform(b.lines, lambda line: line.spans))))))
    rows = middle.select("page_id", F.posexplode(s).alias("pos", "s")).filter(F.size("s.bbox") >= 4)
    b = [F.col("s.bbox")[k] for k in range(4)]
    return rows.filter((b[2] > b[0]) & (b[3] > b[1])).select("page_id", "pos", *(c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), b, strict=True)), F.coalesce("s.content", F.lit("")).alias("text"))


def content_of_middle(middle: Column) -> Column:
    """Content list of a nested result: a paragraph's non-empty span contents joined by blanks; a box is required."""
    def text(b: Column) -> Column:
        parts = F.flatten(F.transform(b.lines, lambda line: F.transform(line.spans, lambda s: F.coalesce(s.content, F.lit("")))))
        return F.array_join(F.filter(parts, lambda t: t != ""), " ")

    pages = F.transform(middle.pdf_info, lambda p: F.transform(F.filter(p.para_blocks, lambda b: F.coalesce(F.size(b.bbox), F.lit(0)) >= 4), lambda b: F.struct(b.bbox.alias("bbox"), F.coalesce(b.type, F.lit("text")).alias("type"), text(b).alias("text"))))
    return F.flatten(pages)


def full_text(content: Column) -> Column:
    """Texts of a content list by (y1, x1), then place, joined by blanks."""
    rows = F.transform(content, lambda i, n: F.struct(F.coalesce(F.try_element_at(i.bbox, F.lit(2)), F.lit(0.0)).alias("y"), F.coalesce(F.try_element_at(i.bbox, F.lit(1)), F.lit(0.0)).alias("x"), n.alias("n"), F.coalesce(i.text, F.lit("")).alias("text")))
    return F.array_join(F.transform(F.array_sort(F.filter(rows, lambda r: r.text != "")), lambda r: r.text), " ")


def tables(content: Column) -> Column:
    return F.filter(content, lambda i: i.type == "table")


def strip_fences(c: Column) -> Column:
    """A model's JSON answer without its code fence."""
    return F.regexp_replace(F.regexp_replace(strip(c), "(?i)^```(?:json)?\\s*", ""), "\\s*```$", "")


def attack_plan(c: Column) -> Column:
    """Steps of a model's plan, in the current or the older form, else none."""
    step = "array<struct<probe_type:string,params:map<string,double>,target_strategy:string,reason:string>>"
    parsed = F.from_json(strip_fences(c), f"attack_plan {step}, plan {step}")
    return F.coalesce(parsed.attack_plan, parsed.plan, F.array().cast(step))


def ocr_boxes(polygon: Column, width: Column, height: Column) -> Column:
    """Box of a polygon's points, clipped to the image; null if nothing is left."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    b = [F.greatest(F.lit(0.0), F.array_min(xs)), F.greatest(F.lit(0.0), F.array_min(ys)), F.least(width.cast("double"), F.array_max(xs)), F.least(height.cast("double"), F.array_max(ys))]
    return F.when((b[2] > b[0]) & (b[3] > b[1]), F.array(*b))


def assign_spans(spans: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, pos, span text) for each span whose centre lies in a block's box, borders included; a span may be in several."""
    s = spans.select("page_id", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), F.col("text").alias("span"))
    b = blocks.select("page_id", "pos", "x1", "y1", "x2", "y2")
    return s.join(b, "page_id").filter(F.col("cx").between(F.col("x1"), F.col("x2")) & F.col("cy").between(F.col("y1"), F.col("y2"))).select("page_id", "pos", "span")
