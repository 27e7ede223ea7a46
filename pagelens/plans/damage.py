"""Queries over structural damage: matching, block loss, mask coverage, detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection, masks, matching, page_metrics
from ..sources import fixtures as fx
from .registry import query


def match_of(spark: SparkSession, sf: str, similar: bool = False) -> DataFrame:
    """Matches by overlap; with ``similar`` also the matched texts and their similarity."""
    m = matching.best_match(fx.clean_elements(spark, sf), fx.perturbed_elements(spark, sf), fx.page_configs(spark, sf), texts=similar)
    return matching.with_similarity(m) if similar else m


def _r(*columns: str) -> list:
    return [F.round(c, 6).alias(c) for c in columns]


@query("join01_best_match", f"WITH {fx.CTES} SELECT page_id, config_id, elem_id, adv_id, round(iou, 6) AS iou FROM best")
def join01(spark: SparkSession, sf: str) -> DataFrame:
    return match_of(spark, sf).select("page_id", "config_id", "elem_id", "adv_id", *_r("iou"))


@query("join02_lost_boxes", f"WITH {fx.CTES} SELECT config_id, page_id, elem_id FROM best WHERE iou < 0.1")
def join02(spark: SparkSession, sf: str) -> DataFrame:
    lost = matching.unmatched(fx.clean_elements(spark, sf), fx.perturbed_elements(spark, sf), fx.page_configs(spark, sf))
    return lost.select("config_id", "page_id", "elem_id")


@query("join03_eir_detection", f"WITH {fx.CTES} SELECT page_id, config_id, round(avg(CASE WHEN iou < 0.1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS eir_det FROM best GROUP BY ALL")
def join03(spark: SparkSession, sf: str) -> DataFrame:
    return matching.block_loss(match_of(spark, sf), similar=None).select("page_id", "config_id", F.round("b_slr", 6).alias("eir_det"))


@query("agg01_block_loss_iou", f"""WITH {fx.CTES}, per AS (SELECT page_id, config_id, avg(CASE WHEN iou < 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS b FROM best GROUP BY ALL)
SELECT config_id, round(avg(b), 6) AS mean_b_slr, count(*) AS n_pages FROM per GROUP BY config_id""")
def agg01_iou(spark: SparkSession, sf: str) -> DataFrame:
    loss = matching.block_loss(match_of(spark, sf), similar=None)
    return matching.config_means(loss, "b_slr").select("config_id", *_r("mean_b_slr"), "n_pages")


@query("agg01_block_loss")
def agg01(spark: SparkSession, sf: str) -> DataFrame:
    return matching.block_loss(match_of(spark, sf, True))


@query("agg02_decomposed_loss")
def agg02(spark: SparkSession, sf: str) -> DataFrame:
    return page_metrics.decomposed_loss(fx.clean_elements(spark, sf), fx.perturbed_elements(spark, sf), fx.page_configs(spark, sf))


@query("agg03_text_ablation")
def agg03(spark: SparkSession, sf: str) -> DataFrame:
    return matching.text_ablation(match_of(spark, sf, True))


@query("agg04_splash", f"""WITH {fx.CTES}, r AS (SELECT b.page_id, b.config_id, iou < 0.1 AS lost, NOT (x BETWEEN mx1 - 20 AND mx2 + 19 AND y BETWEEN my1 - 20 AND my2 + 19) AS far
  FROM best b JOIN clean c USING (page_id, elem_id) JOIN mask m ON m.page_id = b.page_id AND m.config_id = b.config_id)
SELECT page_id, config_id, round(coalesce(count(*) FILTER (lost AND far) / nullif(count(*) FILTER (lost), 0)::DOUBLE, 0), 6) AS splash, count(*) FILTER (lost) AS n_lost FROM r GROUP BY ALL""")
def agg04(spark: SparkSession, sf: str) -> DataFrame:
    return matching.splash(match_of(spark, sf), fx.page_configs(spark, sf)).select("page_id", "config_id", *_r("splash"), "n_lost")


_SHIFT = "greatest(0, x - CAST(floor(w / 2.0) AS BIGINT)) AS bx1, greatest(0, y - CAST(floor(h / 2.0) AS BIGINT)) AS by1"


@query("agg05_mask_metrics", f"""WITH {fx.CTES}, b AS (SELECT page_id, x, y, w, h, {_SHIFT} FROM clean),
r AS (SELECT b.page_id, config_id, (least(mx2, 1000) - mx1) * (least(my2, 1400) - my1) / 1400000.0::DOUBLE AS tor,
  least(least(1000, round_even(x + w / 2.0, 0)), mx2) > greatest(greatest(0, round_even(x - w / 2.0, 0)), mx1) AND least(least(1400, round_even(y + h / 2.0, 0)), my2) > greatest(greatest(0, round_even(y - h / 2.0, 0)), my1) AS touched,
  greatest(0, least(least(1000, bx1 + w), mx2) - greatest(bx1, mx1)) * greatest(0, least(least(1400, by1 + h), my2) - greatest(by1, my1)) >= 1 AS hit
  FROM b JOIN mask USING (page_id))
SELECT page_id, config_id, round(min(tor), 6) AS tor, round(avg(CASE WHEN touched THEN 1.0::DOUBLE ELSE 0 END), 6) AS boc, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS eir FROM r GROUP BY ALL""")
def agg05(spark: SparkSession, sf: str) -> DataFrame:
    return matching.mask_metrics(fx.clean_elements(spark, sf), fx.page_configs(spark, sf)).select("page_id", "config_id", *_r("tor", "boc", "eir"))


def _content(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.clean_elements(spark, sf)
    box = {"x1": "x - w / 2.0", "y1": "y - h / 2.0", "x2": "x + w / 2.0", "y2": "y + h / 2.0"}
    return e.select("page_id", *(F.bround(F.expr(v)).cast("int").alias(k) for k, v in box.items()))


def _content_mask(spark: SparkSession, sf: str) -> DataFrame:
    return masks.union(masks.clipped(_content(spark, sf), ["page_id"]), ["page_id"])


def _probe_mask(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.page_configs(spark, sf)
    return masks.clipped(m.select("page_id", "config_id", F.col("mx1").alias("x1"), F.col("my1").alias("y1"), F.col("mx2").alias("x2"), F.col("my2").alias("y2")), ["page_id", "config_id"])


_CONTENT = """cbox AS (SELECT page_id, CAST(greatest(0, least(round_even(x - w / 2.0, 0), 1000)) AS INT) AS x0, CAST(greatest(0, least(round_even(x + w / 2.0, 0), 1000)) AS INT) AS x1,
  CAST(greatest(0, least(round_even(y - h / 2.0, 0), 1400)) AS INT) AS a, CAST(greatest(0, least(round_even(y + h / 2.0, 0), 1400)) AS INT) AS b FROM clean),
cut AS (SELECT DISTINCT page_id, unnest([a, b]) AS y FROM cbox WHERE x0 < x1 AND a < b),
strip AS (SELECT page_id, y AS y0, lead(y) OVER (PARTITION BY page_id ORDER BY y) AS y1 FROM cut),
line AS (SELECT c.page_id, x0, x1, y0, y1 FROM cbox c JOIN strip s ON s.page_id = c.page_id AND y0 >= a AND y1 <= b WHERE x0 < x1),
opened AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY page_id, y0 ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS o FROM line),
isl AS (SELECT *, sum(o) OVER (PARTITION BY page_id, y0 ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS i FROM opened),
crun AS (SELECT page_id, y0, max(y1) AS y1, min(x0) AS x0, max(x1) AS x1 FROM isl GROUP BY page_id, y0, i)"""


@query("img01_content_area", f"WITH {fx.CTES}, {_CONTENT} SELECT page_id, CAST(sum((x1 - x0) * (y1 - y0)) AS BIGINT) AS pixels FROM crun GROUP BY page_id")
def img01(spark: SparkSession, sf: str) -> DataFrame:
    return masks.pixels(_content_mask(spark, sf), ["page_id"])


@query("agg06_content_coverage", f"""WITH {fx.CTES}, {_CONTENT},
lap AS (SELECT c.page_id, config_id, sum(greatest(0, least(x1, mx2) - greatest(x0, mx1)) * greatest(0, least(y1, my2) - greatest(y0, my1))) AS inter FROM crun c JOIN mask m ON c.page_id = m.page_id GROUP BY ALL),
tot AS (SELECT page_id, sum((x1 - x0) * (y1 - y0)) AS px FROM crun GROUP BY page_id)
SELECT page_id, p.config_id, round(coalesce(inter, 0)::DOUBLE / px, 6) AS acr FROM page p JOIN tot USING (page_id) LEFT JOIN lap USING (page_id, config_id)""")
def agg06(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["page_id", "config_id"]
    content = _content_mask(spark, sf).join(fx.page_configs(spark, sf).select(*keys), "page_id")
    return masks.coverage(_probe_mask(spark, sf), content, keys).select(*keys, F.round("ratio", 6).alias("acr"))


def _ring(x1: str, y1: str, x2: str, y2: str) -> str:
    """Union area of clipped boxes in SQL, by cells between all neighbouring edges of a page."""
    return f"SELECT page_id, greatest(0, least({x1}, 1000)) AS x0, greatest(0, least({x2}, 1000)) AS x1, greatest(0, least({y1}, 1400)) AS y0, greatest(0, least({y2}, 1400)) AS y1 FROM ib"


@query("agg07_boundary_overlap", f"""WITH {fx.CTES}, ib AS (SELECT page_id, CAST(round_even(x - w / 2.0, 0) AS INT) AS bx1, CAST(round_even(y - h / 2.0, 0) AS INT) AS by1, CAST(round_even(x + w / 2.0, 0) AS INT) AS bx2, CAST(round_even(y + h / 2.0, 0) AS INT) AS by2 FROM clean),
rect AS (SELECT *, 1 AS keep FROM ({_ring('bx1 - 5', 'by1 - 5', 'bx2 + 5', 'by2 + 5')}) WHERE x0 < x1 AND y0 < y1 UNION ALL SELECT *, 0 FROM ({_ring('bx1 + 5', 'by1 + 5', 'bx2 - 5', 'by2 - 5')}) WHERE x0 < x1 AND y0 < y1),
xs AS (SELECT page_id, x AS xa, lead(x) OVER (PARTITION BY page_id ORDER BY x) AS xb FROM (SELECT DISTINCT page_id, unnest([x0, x1]) AS x FROM rect)),
ys AS (SELECT page_id, y AS ya, lead(y) OVER (PARTITION BY page_id ORDER BY y) AS yb FROM (SELECT DISTINCT page_id, unnest([y0, y1]) AS y FROM rect)),
cell AS (SELECT r.page_id, xa, xb, ya, yb FROM rect r JOIN xs ON xs.page_id = r.page_id AND xa >= x0 AND xb <= x1 JOIN ys ON ys.page_id = r.page_id AND ya >= y0 AND yb <= y1 GROUP BY ALL HAVING min(keep) = 1),
tot AS (SELECT page_id, sum((xb - xa) * (yb - ya)) AS px FROM cell GROUP BY page_id),
lap AS (SELECT c.page_id, config_id, sum(greatest(0, least(xb, mx2) - greatest(xa, mx1)) * greatest(0, least(yb, my2) - greatest(ya, my1))) AS inter FROM cell c JOIN mask m ON m.page_id = c.page_id GROUP BY ALL)
SELECT page_id, config_id, round(coalesce(inter, 0)::DOUBLE / px, 6) AS bpo FROM page JOIN tot USING (page_id) LEFT JOIN lap USING (page_id, config_id)""")
def agg07(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["page_id", "config_id"]
    band = masks.outline_bands(_content(spark, sf), ["page_id"]).join(fx.page_configs(spark, sf).select(*keys), "page_id")
    return masks.coverage(_probe_mask(spark, sf), band, keys).select(*keys, F.round("ratio", 6).alias("bpo"))


@query("geo13_mask_box", f"WITH {fx.CTES}, {_CONTENT} SELECT page_id, CAST(min(x0) AS BIGINT) AS x1, CAST(min(y0) AS BIGINT) AS y1, CAST(max(x1) AS BIGINT) AS x2, CAST(max(y1) AS BIGINT) AS y2 FROM crun GROUP BY page_id")
def geo13(spark: SparkSession, sf: str) -> DataFrame:
    return masks.mask_box(_content_mask(spark, sf), ["page_id"]).select("page_id", *(F.col(c).cast("long").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("agg09_layout_entropy", f"""WITH {fx.CTES}, per AS (SELECT page_id, type, sum(greatest(1.0::DOUBLE, (w * h)::DOUBLE)) AS a, count(*)::DOUBLE AS n FROM clean GROUP BY ALL),
p AS (SELECT page_id, a / sum(a) OVER (PARTITION BY page_id) AS pa, n / sum(n) OVER (PARTITION BY page_id) AS pn FROM per)
SELECT page_id, round(sum(-pa * log2(pa)), 6) + 0.0 AS by_area, round(sum(-pn * log2(pn)), 6) + 0.0 AS by_count FROM p GROUP BY page_id""")
def agg09(spark: SparkSession, sf: str) -> DataFrame:
    a = fx.clean_elements(spark, sf).select("page_id", F.col("type").alias("category"), (F.col("w") * F.col("h")).cast("double").alias("area"))
    by_area, by_count = masks.layout_entropy(a, ["page_id"]), masks.layout_entropy(a, ["page_id"], by_area=False)
    return by_area.join(by_count.withColumnRenamed("entropy", "n"), "page_id").select("page_id", (F.round("entropy", 6) + 0.0).alias("by_area"), (F.round("n", 6) + 0.0).alias("by_count"))


@query("join04_greedy_cer")
def join04(spark: SparkSession, sf: str) -> DataFrame:
    return matching.greedy_cer(fx.clean_elements(spark, sf), fx.perturbed_elements(spark, sf), fx.page_configs(spark, sf))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return fx.perturbed_elements(spark, sf).withColumn("score", F.lit(1.0))


@query("agg25_page_map")
def agg25(spark: SparkSession, sf: str) -> DataFrame:
    return detection.page_map(fx.clean_elements(spark, sf), _scored(spark, sf), fx.page_configs(spark, sf))


_LABELS = ["Text", "Page-header", "weird", "SECTION-HEADER", "formula", "Table", "abandon", "TABLE", "Picture", "seal"]


@query("prj23_canonical_labels", f"""WITH l AS (SELECT o_orderkey, [{', '.join(f"'{x}'" for x in _LABELS)}][CAST(o_orderkey % 10 AS INT) + 1] AS label FROM orders),
m AS (SELECT label, CASE label WHEN 'Text' THEN 'text' WHEN 'weird' THEN 'text' WHEN 'SECTION-HEADER' THEN 'text' WHEN 'formula' THEN 'equation' WHEN 'Table' THEN 'table' WHEN 'TABLE' THEN 'table' WHEN 'Picture' THEN 'figure' END AS canonical FROM l)
SELECT label, canonical, count(*) AS n FROM m GROUP BY ALL""")
def prj23(spark: SparkSession, sf: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("o_orderkey") % 10).cast("int") + 1)
    return fx.table(spark, sf, "orders").select(label.alias("label")).withColumn("canonical", detection.canonical_label(F.col("label"))).groupBy("label", "canonical").agg(F.count(F.lit(1)).alias("n"))


@query("join15_occlusion", f"""WITH {fx.CTES}, b AS (SELECT page_id, elem_id, w, h, {_SHIFT} FROM clean),
r AS (SELECT page_id, elem_id, config_id, greatest(0, least(least(1000, bx1 + w), mx2) - greatest(bx1, mx1)) * greatest(0, least(least(1400, by1 + h), my2) - greatest(by1, my1)) AS cover,
  greatest(0, least(1000, bx1 + w) - bx1) * greatest(0, least(1400, by1 + h) - by1) AS box FROM b JOIN mask USING (page_id))
SELECT config_id, count(*) FILTER (cover >= 1) AS touched, count(*) FILTER (box > 0 AND cover / box::DOUBLE >= 0.3) AS occluded FROM r GROUP BY config_id""")
def join15(spark: SparkSession, sf: str) -> DataFrame:
    rows = fx.clean_elements(spark, sf).join(fx.page_configs(spark, sf), "page_id")
    cover, box = matching.mask_cover(*(F.col(n) for n in ("x", "y", "w", "h")))
    return rows.groupBy("config_id").agg(F.count_if(cover >= 1).alias("touched"), F.count_if((box > 0) & (F.try_divide(cover.cast("double"), box.cast("double")) >= 0.3)).alias("occluded"))


@query("prj05_metric_rows")
def prj05(spark: SparkSession, sf: str) -> DataFrame:
    return page_metrics.metric_rows(fx.clean_elements(spark, sf), fx.perturbed_elements(spark, sf), fx.page_configs(spark, sf))
