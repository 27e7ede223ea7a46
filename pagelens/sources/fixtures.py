"""Layout relations derived from the star-schema tables by fixed integer rules.

A page is an order, an element one of its lines, and each of four
perturbation configs drops, shifts, retypes and edits elements by key. The
same rules are given as DuckDB common table expressions in ``CTES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_W, PAGE_H, CONFIGS = 1000, 1400, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Lines of an order in the order of their elem_id.
IN_PAGE = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    """Lines that have a part, and the columns of their elements except elem_id."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = line.join(part, line["l_partkey"] == part["p_partkey"])
    w = 20 + 3 * F.col("l_quantity").cast("long")
    h = 12 + 4 * F.col("l_linenumber").cast("long")
    x1, y1 = (F.col("l_partkey") * 37) % 900, (F.col("l_suppkey") * 53) % 1200
    kind = F.when(F.col("l_returnflag") == "A", "text").when(F.col("l_returnflag") == "N", "title").otherwise("table")
    text = F.when(F.col("l_partkey") % 13 == 0, "").otherwise(F.substring(F.concat_ws(" ", "p_name", "p_type"), 1, 120))
    columns = {
        "page_id": F.col("l_orderkey"), "x": F.floor((2 * x1 + w) / 2), "y": F.floor((2 * y1 + h) / 2), "w": w, "h": h,
        "type": kind, "text": text, "k": F.col("l_partkey") * 31 + F.col("l_suppkey") * 17 + F.col("l_linenumber"),
    }
    return rows, {name: c.alias(name) for name, c in columns.items()}


def clean_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, elem_id (from 0), centre x, y, size w, h, type, text, key k."""
    rows, c = _lines(spark, sf_dir)
    by_page = Window.partitionBy("l_orderkey").orderBy(*IN_PAGE)
    return rows.select(c["page_id"], (F.row_number().over(by_page) - 1).cast("long").alias("elem_id"), *[c[n] for n in ("x", "y", "w", "h", "type", "text", "k")])


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, boxes: a page's clean elements (centre x, y, size w, h) in order of elem_id, dealt by page over the shuffle's partitions."""
    rows, c = _lines(spark, sf_dir)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    boxes = rows.select(c["page_id"], F.struct(*IN_PAGE, *[c[n] for n in ("x", "y", "w", "h")]).alias("b")).repartition(n, "page_id")
    return boxes.groupBy("page_id").agg(F.transform(F.sort_array(F.collect_list("b")), lambda b: F.struct(b.x.alias("x"), b.y.alias("y"), b.w.alias("w"), b.h.alias("h"))).alias("boxes"))


def configs(spark: SparkSession) -> DataFrame:
    """The perturbation configs: a fixed dimension table of ``CONFIGS`` rows."""
    return spark.range(CONFIGS).select(F.concat(F.lit("C"), F.col("id").cast("string")).alias("config_id"), F.col("id").alias("c"))


def perturbed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, config_id, adv_id (from 0), x, y, w, h, type, text."""
    kc = F.col("k") + F.col("c") * 7
    so_far = Window.partitionBy("page_id").orderBy("elem_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = F.array(*[F.sum(((F.col("k") + c * 7) % 7 != 0).cast("long")).over(so_far) for c in range(CONFIGS)])  # counted before rows are multiplied
    rows = clean_elements(spark, sf_dir).withColumn("kept", kept).crossJoin(F.broadcast(configs(spark)))  # four rows
    rows = rows.withColumn("kc", kc).filter("kc % 7 <> 0")
    text = F.when(F.col("kc") % 3 == 0, F.regexp_replace("text", "a", "e")).when(F.col("kc") % 10 == 1, F.substring("text", 1, 4)).otherwise(F.col("text"))
    return rows.select(
        "page_id", "config_id", (F.element_at("kept", F.col("c").cast("int") + 1) - 1).alias("adv_id"),
        (F.col("x") + (F.col("kc") % 5) * 9).alias("x"), (F.col("y") + (F.col("kc") % 3) * 6).alias("y"), "w", "h",
        F.when(F.col("kc") % 11 == 0, "figure").otherwise(F.col("type")).alias("type"), text.alias("text"),
    )


def page_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (page, config) with the rectangle its probe covers: mx1, my1, mx2, my2."""
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id")).distinct()
    p, c = F.col("page_id"), F.col("c")
    mx1, my1 = (p * 13 + c * 29) % 700, (p * 7 + c * 31) % 900
    return pages.crossJoin(F.broadcast(configs(spark))).select("page_id", "config_id", mx1.alias("mx1"), my1.alias("my1"), (mx1 + 100 + (p % 5) * 60).alias("mx2"), (my1 + 80 + (p % 7) * 40).alias("my2"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks of documents: page_id, pipeline, condition, pos, x1, y1, x2, y2, text; blank lines are kept."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("pipeline"), F.col("source").alias("condition"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    x1, y1 = (F.col("pos") % 3) * 300, (F.col("pos") - F.col("pos") % 3) * 10
    return rows.select("page_id", "pipeline", "condition", "pos", x1.alias("x1"), y1.alias("y1"), (x1 + 280).alias("x2"), (y1 + 24).alias("y2"), "text")


CTES = """
raw AS (SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS elem_id,
  (l_partkey * 37) % 900 AS x1, (l_suppkey * 53) % 1200 AS y1, 20 + 3 * CAST(l_quantity AS BIGINT) AS w, 12 + 4 * CAST(l_linenumber AS BIGINT) AS h,
  CASE l_returnflag WHEN 'A' THEN 'text' WHEN 'N' THEN 'title' ELSE 'table' END AS type,
  CASE WHEN l_partkey % 13 = 0 THEN '' ELSE substr(p_name || ' ' || p_type, 1, 120) END AS text, l_partkey * 31 + l_suppkey * 17 + l_linenumber AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey),
clean AS (SELECT page_id, elem_id, CAST(floor((2 * x1 + w) / 2.0) AS BIGINT) AS x, CAST(floor((2 * y1 + h) / 2.0) AS BIGINT) AS y, w, h, type, text, k FROM raw),
config AS (SELECT 'C' || c AS config_id, c FROM range(4) t(c)),
adv0 AS (SELECT *, k + c * 7 AS kc FROM clean, config WHERE (k + c * 7) % 7 <> 0),
adv AS (SELECT page_id, config_id, row_number() OVER (PARTITION BY page_id, config_id ORDER BY elem_id) - 1 AS adv_id, x + (kc % 5) * 9 AS x, y + (kc % 3) * 6 AS y, w, h,
  CASE WHEN kc % 11 = 0 THEN 'figure' ELSE type END AS type,
  CASE WHEN kc % 3 = 0 THEN replace(text, 'a', 'e') WHEN kc % 10 = 1 THEN substr(text, 1, 4) ELSE text END AS text FROM adv0),
page AS (SELECT page_id, config_id, c, (page_id * 13 + c * 29) % 700 AS mx1, (page_id * 7 + c * 31) % 900 AS my1 FROM (SELECT DISTINCT page_id FROM clean), config),
mask AS (SELECT page_id, config_id, mx1, my1, mx1 + 100 + (page_id % 5) * 60 AS mx2, my1 + 80 + (page_id % 7) * 40 AS my2 FROM page),
pairs AS (SELECT c.page_id, a.config_id, c.elem_id, a.adv_id,
  greatest(0, least(c.x + c.w / 2.0, a.x + a.w / 2.0) - greatest(c.x - c.w / 2.0, a.x - a.w / 2.0)) * greatest(0, least(c.y + c.h / 2.0, a.y + a.h / 2.0) - greatest(c.y - c.h / 2.0, a.y - a.h / 2.0)) AS inter,
  c.w * c.h + a.w * a.h AS areas FROM clean c JOIN adv a USING (page_id)),
ious AS (SELECT page_id, config_id, elem_id, adv_id, CAST(inter AS DOUBLE) / (CAST(areas AS DOUBLE) - CAST(inter AS DOUBLE)) AS iou FROM pairs),
best0 AS (SELECT *, row_number() OVER (PARTITION BY page_id, config_id, elem_id ORDER BY iou DESC, adv_id) AS rn FROM ious),
best AS (SELECT c.page_id, f.config_id, c.elem_id, coalesce(b.iou, 0) AS iou, CASE WHEN coalesce(b.iou, 0) > 0 THEN b.adv_id ELSE -1 END AS adv_id
  FROM clean c CROSS JOIN config f LEFT JOIN best0 b ON b.rn = 1 AND b.page_id = c.page_id AND b.config_id = f.config_id AND b.elem_id = c.elem_id)
"""
