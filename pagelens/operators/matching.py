"""Matching of clean against perturbed blocks within a page, and the loss metrics built on it.

Clean rows: page_id, elem_id, x, y, w, h, type, text. Perturbed rows add
config_id and adv_id. Every join carries the page, so it is an equi-join with
a residual and never a Cartesian product; ties go to the lower adv_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_iou, centre_box, shifted_box
from ..functions.text import cer, strip, text_similarity
from ..sources.fixtures import PAGE_H, PAGE_W

IOU, SIMILAR, OCCLUDED = 0.1, 0.5, 0.3


def iou_pairs(clean: DataFrame, adv: DataFrame) -> DataFrame:
    c, a = clean.alias("c"), adv.alias("a")
    box = lambda s: centre_box(*(F.col(f"{s}.{n}") for n in ("x", "y", "w", "h")))
    return c.join(a, "page_id").select("page_id", "config_id", "elem_id", "adv_id", box_iou(box("c"), box("a")).alias("iou"))


def best_match(clean: DataFrame, adv: DataFrame, pages: DataFrame, texts: bool = True) -> DataFrame:
    """Per (page, config, clean element) the perturbed element of the largest IoU; adv_id -1 and IoU 0 if none overlaps.

    ``pages(page_id, config_id)`` supplies the configs under which a page has
    no perturbed element at all; n_adv counts those it has. A page's perturbed
    boxes travel as one array of numbers beside each clean element, so the
    search makes no row for a pair; texts and types (``texts``) are joined to
    the one match afterwards.
    """
    box = centre_box(*(F.col(n) for n in ("x", "y", "w", "h")))
    boxes = adv.groupBy("page_id", "config_id").agg(F.collect_list(F.struct("adv_id", *(c.alias(n) for c, n in zip(box, ("x1", "y1", "x2", "y2"), strict=True)))).alias("_adv"))
    rows = clean.join(pages.select("page_id", "config_id").join(boxes, ["page_id", "config_id"], "left"), "page_id")
    laps = F.transform("_adv", lambda a: F.struct(box_iou(box, (a.x1, a.y1, a.x2, a.y2)).alias("iou"), (-a.adv_id).alias("order")))
    rows = rows.withColumn("_top", F.array_max(laps))
    found = F.coalesce(F.col("_top.iou") > 0, F.lit(False))
    best = rows.select(*clean.columns, "config_id", F.coalesce(F.size("_adv"), F.lit(0)).cast("long").alias("n_adv"), F.when(found, F.col("_top.iou")).otherwise(F.lit(0.0)).alias("iou"), F.when(found, -F.col("_top.order")).otherwise(F.lit(-1)).alias("adv_id"))
    if not texts:
        return best
    said = adv.select("page_id", "config_id", "adv_id", F.col("text").alias("adv_text"), F.col("type").alias("adv_type"))
    return best.join(said, ["page_id", "config_id", "adv_id"], "left")


def unmatched(clean: DataFrame, adv: DataFrame, pages: DataFrame, iou: float = IOU) -> DataFrame:
    """Clean elements that no perturbed element reaches at ``iou``."""
    return best_match(clean, adv, pages, texts=False).filter(F.col("iou") < iou).select(*clean.columns, "config_id")


def with_similarity(match: DataFrame) -> DataFrame:
    """Adds ``similarity`` of a match's texts, null where there is none to compare; equal and blank texts are settled without Python."""
    compared = (F.col("adv_id") >= 0) & (strip(F.col("text")) != "")
    a, b = F.lower(strip(F.col("text"))), F.lower(strip(F.col("adv_text")))
    differ = compared & (b != "") & (a != b)
    found = text_similarity(F.when(differ, F.col("text")), F.when(differ, F.col("adv_text")))
    return match.withColumn("similarity", F.when(compared, F.when(b == "", F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(found)))


def _lost(iou: float, similar: float | None) -> Column:
    missed = F.col("iou") < iou
    return missed if similar is None else missed | ((strip(F.col("text")) != "") & (F.coalesce("similarity", F.lit(0.0)) < similar))


def block_loss(match: DataFrame, iou: float = IOU, similar: float | None = SIMILAR) -> DataFrame:
    """b_slr per (page, config): the share of clean blocks lost; ``similar=None`` judges by overlap only."""
    return match.groupBy("page_id", "config_id").agg(F.avg(_lost(iou, similar).cast("double")).alias("b_slr"), F.count(F.lit(1)).alias("n_blocks"))


def mask_cover(x: Column, y: Column, w: Column, h: Column, page_w: int = PAGE_W, page_h: int = PAGE_H) -> tuple[Column, Column]:
    """Pixels of an element's box under the page's rectangle (mx1, my1, mx2, my2), and of the box."""
    x1, y1, x2, y2 = shifted_box(x, y, w, h, page_w, page_h)
    zero = F.lit(0)
    cover = F.greatest(zero, F.least(x2, "mx2", F.lit(page_w)) - F.greatest(x1, "mx1")) * F.greatest(zero, F.least(y2, "my2", F.lit(page_h)) - F.greatest(y1, "my1"))
    return cover, F.greatest(zero, x2 - x1) * F.greatest(zero, y2 - y1)


def decomposed_loss(match: DataFrame, masks: DataFrame, iou: float = IOU, similar: float = SIMILAR, occluded: float = OCCLUDED) -> DataFrame:
    """Lost blocks by pathway: occluded, merged, retyped, degraded; b_slr is the sum of slr_miss and slr_topo."""
    rows = match.join(masks, ["page_id", "config_id"])
    cover, box = mask_cover(*(F.col(n) for n in ("x", "y", "w", "h")))
    under = F.coalesce(F.try_divide(cover.cast("double"), box.cast("double")), F.lit(0.0)) >= occluded
    matched = F.col("iou") >= iou
    shares = rows.filter(matched).groupBy("page_id", "config_id", "adv_id").agg(F.count(F.lit(1)).alias("sharing"))
    rows = rows.join(shares, ["page_id", "config_id", "adv_id"], "left")
    retyped = (F.col("type") != "") & (F.coalesce("adv_type", F.lit("")) != "") & (F.col("type") != F.col("adv_type"))
    path = F.when(~_lost(iou, similar), "intact").when(under & (box > 0), "miss").when(matched & (F.col("sharing") > 1), "merge").when(matched & retyped, "misclass").otherwise("degraded")
    rows = rows.withColumn("path", path)
    count = {p: F.count_if(F.col("path") == p) for p in ("miss", "merge", "misclass", "degraded", "intact")}
    total = F.count(F.lit(1))
    topo = count["merge"] + count["misclass"] + count["degraded"]
    return rows.groupBy("page_id", "config_id").agg(
        (count["miss"] / total).alias("slr_miss"), (topo / total).alias("slr_topo"), ((count["miss"] + topo) / total).alias("b_slr"),
        *(c.alias(f"n_{p}") for p, c in count.items()), total.alias("n_total"),
    )


def text_ablation(match: DataFrame, iou: float = IOU, similar: float = SIMILAR) -> DataFrame:
    """Error rates over text-bearing blocks per (page, config); an overlooked block counts as CER 1."""
    worded = strip(F.col("text")) != ""
    near = worded & (F.col("iou") >= iou)
    rate = F.when(F.col("adv_id") >= 0, cer(F.col("text"), F.col("adv_text"))).otherwise(F.lit(1.0))
    none = F.max("n_adv") == 0
    degraded = F.count_if(near & (F.col("similarity") < similar))
    by_default = lambda c, d: F.coalesce(c, F.when(none, F.lit(0.0)).otherwise(F.lit(d)))
    return match.groupBy("page_id", "config_id").agg(
        by_default(F.avg(F.when(near, F.col("similarity"))), 1.0).alias("text_sim_mean"), by_default(F.min(F.when(near, F.col("similarity"))), 1.0).alias("text_sim_min"),
        F.coalesce(F.avg(F.when(worded, rate)), F.lit(1.0)).alias("cer_mean"), F.count_if(worded).alias("n_matched"),
        degraded.alias("n_text_degraded"), (degraded / F.count(F.lit(1))).alias("b_slr_text_only"),
    )


def splash(match: DataFrame, masks: DataFrame, margin: int = 20, iou: float = IOU) -> DataFrame:
    """Share of blocks lost by overlap whose centre lies beyond the mask's box and its margin."""
    far = ~F.col("x").between(F.col("mx1") - margin, F.col("mx2") - 1 + margin) | ~F.col("y").between(F.col("my1") - margin, F.col("my2") - 1 + margin)
    lost = F.col("iou") < iou
    rows = match.join(masks, ["page_id", "config_id"])
    return rows.groupBy("page_id", "config_id").agg(F.coalesce(F.try_divide(F.count_if(lost & far).cast("double"), F.count_if(lost).cast("double")), F.lit(0.0)).alias("splash"), F.count_if(lost).alias("n_lost"))


def mask_metrics(clean: DataFrame, masks: DataFrame, page_w: int = PAGE_W, page_h: int = PAGE_H) -> DataFrame:
    """Per (page, config): tor (page share under the mask), boc and eir (shares of blocks it touches)."""
    rows = clean.join(masks, "page_id")
    cover, _ = mask_cover(*(F.col(n) for n in ("x", "y", "w", "h")), page_w, page_h)
    mask = (F.least("mx2", F.lit(page_w)) - F.greatest("mx1", F.lit(0))) * (F.least("my2", F.lit(page_h)) - F.greatest("my1", F.lit(0)))
    b = [F.greatest(F.lit(0), F.bround(F.col("x") - F.col("w") / 2.0)), F.greatest(F.lit(0), F.bround(F.col("y") - F.col("h") / 2.0)), F.least(F.lit(page_w), F.bround(F.col("x") + F.col("w") / 2.0)), F.least(F.lit(page_h), F.bround(F.col("y") + F.col("h") / 2.0))]
    touched = (F.least(b[2], "mx2") > F.greatest(b[0], "mx1")) & (F.least(b[3], "my2") > F.greatest(b[1], "my1"))
    return rows.groupBy("page_id", "config_id").agg(F.first(F.greatest(F.lit(0), mask) / float(page_w * page_h)).alias("tor"), F.avg(touched.cast("double")).alias("boc"), F.avg((cover >= 1).cast("double")).alias("eir"))


def struct_columns(lists: pa.ListArray, names: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(starts of the rows and the end, numbers) of an array-of-structs column; a null row is empty."""
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy()
    flat = lists.flatten()
    fields = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
    return np.concatenate([[0], np.cumsum(sizes)]), [fields[n].to_numpy(zero_copy_only=False) for n in names]


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of boxes (x, y, w, h by centre and size), one row for each of ``a``; 0 where a union is empty."""
    low = np.maximum((a[:, :2] - a[:, 2:] / 2)[:, None], b[:, :2] - b[:, 2:] / 2)
    high = np.minimum((a[:, :2] + a[:, 2:] / 2)[:, None], b[:, :2] + b[:, 2:] / 2)
    inter = np.maximum(high - low, 0).prod(2)
    whole = a[:, 2:].prod(1)[:, None] + b[:, 2:].prod(1) - inter
    return np.divide(inter, whole, out=np.zeros_like(inter), where=whole > 0)


def greedy_picks(overlaps: np.ndarray) -> np.ndarray:
    """For each row in order the free column of the largest positive overlap (the first of ties), which is then taken, else -1."""
    free, picks = np.ones(overlaps.shape[1], bool), np.full(len(overlaps), -1)
    for i, row in enumerate(overlaps):
        left = np.where(free, row, 0.0)
        if len(left) and left.max() > 0:
            picks[i] = left.argmax()
            free[picks[i]] = False
    return picks


def greedy_matches(clean: DataFrame, adv: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, config, elem_id, adv_id): worded clean blocks in order, each with the best perturbed block still free, or null.

    The order decides, so a page's boxes are one fold over arrays of numbers;
    texts stay out of it.
    """
    item = lambda order: F.array_sort(F.collect_list(F.struct(order, *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")))))
    worded = clean.filter(strip(F.col("text")) != "").groupBy("page_id").agg(item("elem_id").alias("clean"))
    rows = pages.select("page_id", "config_id").join(worded, "page_id").join(adv.groupBy("page_id", "config_id").agg(item("adv_id").alias("adv")), ["page_id", "config_id"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, (elem, *a) = struct_columns(batch.column("clean"), ("elem_id", "x", "y", "w", "h"))
            to, (other, *b) = struct_columns(batch.column("adv"), ("adv_id", "x", "y", "w", "h"))
            a, b = np.stack(a, 1), np.stack(b, 1)
            picks = [greedy_picks(iou_matrix(a[at[i] : at[i + 1]], b[to[i] : to[i + 1]])) for i in range(batch.num_rows)]
            adv_id = [np.where(p >= 0, other[lo + np.maximum(p, 0)] if len(other) > lo else 0, 0) for p, lo in zip(picks, to, strict=False)]
            row = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(at)))
            taken = np.concatenate(picks) if picks else np.zeros(0, np.int64)
            ids = pa.array(np.concatenate(adv_id) if adv_id else np.zeros(0, np.int64), pa.int64(), mask=taken < 0)
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(row), batch.column("config_id").take(row), pa.array(elem, pa.int64()), ids], names=["page_id", "config_id", "elem_id", "adv_id"])

    return rows.select("page_id", "config_id", "clean", "adv").mapInArrow(run, "page_id long, config_id string, elem_id long, adv_id long")


def greedy_cer(clean: DataFrame, adv: DataFrame, pages: DataFrame) -> DataFrame:
    """delta_cer per (page, config): mean error rate over :func:`greedy_matches`, a block left alone counting 1.

    0 for a page without blocks, 1 where nothing is worded or nothing was found.
    """
    picks = greedy_matches(clean, adv, pages).join(clean.select("page_id", "elem_id", "text"), ["page_id", "elem_id"])
    picks = picks.join(adv.select("page_id", "config_id", "adv_id", F.col("text").alias("adv_text")), ["page_id", "config_id", "adv_id"], "left")
    rate = F.when(F.col("adv_id").isNull(), F.lit(1.0)).otherwise(cer(F.col("text"), F.col("adv_text")))
    rates = picks.groupBy("page_id", "config_id").agg(F.avg(rate).alias("rate"))
    n_clean, n_adv = clean.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_clean")), adv.groupBy("page_id", "config_id").agg(F.count(F.lit(1)).alias("n_adv"))
    rows = pages.select("page_id", "config_id").join(n_clean, "page_id", "left").join(n_adv, ["page_id", "config_id"], "left").join(rates, ["page_id", "config_id"], "left")
    value = F.when(F.col("n_clean").isNull(), F.lit(0.0)).when(F.col("n_adv").isNull(), F.lit(1.0)).otherwise(F.coalesce("rate", F.lit(1.0)))
    return rows.select("page_id", "config_id", value.alias("delta_cer"))


def config_means(metrics: DataFrame, *columns: str) -> DataFrame:
    return metrics.groupBy("config_id").agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), F.count(F.lit(1)).alias("n_pages"))



def metric_rows(clean: DataFrame, adv: DataFrame, masks: DataFrame) -> DataFrame:
    """The metric row of every (page, config): all losses of this module side by side, pages without clean blocks left out."""
    keys = ["page_id", "config_id"]
    match = with_similarity(best_match(clean, adv, masks))
    parts = [mask_metrics(clean, masks), decomposed_loss(match, masks), text_ablation(match), splash(match, masks), greedy_cer(clean, adv, masks)]
    by_overlap = block_loss(match, similar=None).select(*keys, F.col("b_slr").alias("eir_det"))
    rows = masks.select(*keys).join(clean.select("page_id").distinct(), "page_id", "left_semi")
    for part in (*parts, by_overlap):
        rows = rows.join(part, keys, "left")
    return rows.withColumn("b_slr_per_tor", F.try_divide("b_slr", "tor"))
