"""Data-quality audits: anomalies as rows, gates as boolean columns of one aggregate row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bbox_fault
from ..functions.text import text_related


def anomalies(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """(keys..., reason): one row per failed check; a null check counts as failed."""
    faults = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items()]))
    return df.select(*keys, F.explode(faults).alias("reason"))


def parse_checks() -> dict[str, Column]:
    """Checks of a parse record (page_id, parser_status, page_text, blocks, width, height)."""
    ok = F.col("parser_status") == "success"
    blank = F.coalesce(F.trim("page_text"), F.lit("")) == ""
    boxes = F.transform("blocks", lambda b: bbox_fault(b.bbox, F.col("width").cast("double"), F.col("height").cast("double")))
    ids = F.transform("blocks", lambda b: b.block_id)
    joined = F.array_join(F.transform("blocks", lambda b: b.text), " ")
    return {
        "unknown_status": ~F.col("parser_status").isin("success", "empty", "failed"), "empty_text": ok & blank, "no_blocks": ok & (F.size("blocks") == 0),
        "bad_bbox": F.exists(boxes, lambda f: f.isNotNull() & (f != "out_of_page")), "out_of_page": F.exists(boxes, lambda f: F.coalesce(f == "out_of_page", F.lit(False))),
        "duplicate_block": F.size(F.array_distinct(ids)) < F.size(ids), "unrelated_text": ok & ~blank & ~text_related(F.col("page_text"), joined),
    }


def parse_audit(records: DataFrame, by: list[str]) -> DataFrame:
    """Counts and means per group, over success and empty pages where means are of text."""
    ok, some = F.col("parser_status") == "success", F.coalesce(F.trim("page_text"), F.lit("")) != ""
    usable = F.col("parser_status").isin("success", "empty")
    zero = F.lit(0.0)
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("success"), F.count_if(F.col("parser_status") == "empty").alias("empty"), F.count_if(F.col("parser_status") == "failed").alias("failed"),
        F.count_if(~some).alias("empty_text"), F.coalesce(F.avg(F.when(usable, F.length("page_text"))), zero).alias("mean_chars"), F.coalesce(F.median(F.when(usable, F.size("blocks").cast("double"))), zero).alias("median_blocks"),
        (F.count(F.lit(1)) - F.count_distinct("page_id")).alias("duplicates"),
    )


def ready_for_qa(audit: DataFrame, both_success: Column, both_text: Column, bad_boxes: Column) -> DataFrame:
    """Adds ``reasons`` against use; none means ready."""
    reasons = F.array_compact(F.array(
        F.when(both_success < 15, "both_success_pages"), F.when(both_text < 15, "both_non_empty_text_pages"),
        F.when(bad_boxes > F.greatest(F.lit(5), F.col("success")), "invalid_bbox_count"), F.when(F.col("mean_chars") < 100, "average_page_text_length"),
    ))
    return audit.withColumn("reasons", reasons).withColumn("ready", F.size("reasons") == 0)


def perturbed_readiness(audit: DataFrame, expected: int) -> DataFrame:
    reasons = F.array_compact(F.array(
        F.when(F.col("rows") != expected, "row_count"), F.when(F.col("success") < 15, "success_pages"), F.when(F.col("failed") > 2, "failed_pages"),
        F.when(F.col("empty") > 5, "empty_pages"), F.when(F.col("empty_text") >= expected, "all_empty_text"), F.when(F.col("duplicates") != 0, "duplicates"),
    ))
    return audit.withColumn("reasons", reasons).withColumn("ready", F.size("reasons") == 0)


def pipeline_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """both_success, only_a, only_b, both_failed over the pages of two record sets."""
    mark = lambda d, n: d.groupBy("page_id").agg(F.bool_or(F.col("parser_status") == "success").alias(n))
    rows = mark(a, "a").join(mark(b, "b"), "page_id", "full_outer").select(F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    return rows.agg(F.count_if(F.col("a") & F.col("b")).alias("both_success"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"), F.count_if(~F.col("a") & ~F.col("b")).alias("both_failed"))


def tor_mismatch(tor: Column, area: Column, w: Column, h: Column) -> Column:
    """The stated page share doesn't follow from the mask's area: off by over 1e-5 and over 1 %."""
    real = F.try_divide(area.cast("double"), (w * h).cast("double"))
    gap = F.abs(tor - real)
    return F.when((w <= 0) | (h <= 0) | real.isNull() | tor.isNull(), True).when(gap <= 1e-5, False).otherwise(F.coalesce(F.try_divide(gap, real) > 0.01, F.lit(True)))


def perturbation_audit(meta: DataFrame, expected: int, conditions: tuple[str, ...]) -> DataFrame:
    """One row of gate columns over (page_id, condition, tor, mask_area, width, height), and ``ready`` for all of them."""
    mean = {c: F.avg(F.when(F.col("condition") == c, F.col("tor"))) for c in conditions}
    counts = [F.count_if(F.col("condition") == c) == expected for c in conditions]
    per_key = F.count(F.lit(1)).over(Window.partitionBy("page_id", "condition"))
    rows = meta.withColumn("n", per_key)
    gap = F.coalesce(F.abs(mean["area_matched_erasure"] - mean["structural_probe"]) / mean["structural_probe"], F.lit(1.0))
    one = rows.agg(
        *[c.alias(f"rows_{n}") for c, n in zip(counts, conditions, strict=True)], (F.count_if(F.col("n") > 1) == 0).alias("unique"),
        (F.count_if(~F.col("condition").isin(*conditions)) == 0).alias("known_conditions"), (F.count_if(tor_mismatch(F.col("tor"), F.col("mask_area"), F.col("width"), F.col("height"))) == 0).alias("tor_matches"),
        (gap <= 0.2).alias("areas_matched"), F.coalesce(mean["large_area_erasure"].between(0.15, 0.25), F.lit(False)).alias("large_area"),
    )
    gates = [F.col(c) for c in one.columns]
    return one.withColumn("ready", F.forall(F.array(*gates), lambda g: g))


def qa_verdict(counts: DataFrame, serious: list[str], mild: list[str]) -> DataFrame:
    """YES without findings, NO with serious ones, else BORDERLINE."""
    total = lambda names: sum((F.col(n) for n in names), F.lit(0))
    return counts.withColumn("verdict", F.when(total(serious) > 0, "NO").when(total(mild) > 0, "BORDERLINE").otherwise("YES"))


def metric_audit(rates: DataFrame, columns: list[str], expected_rows: int) -> DataFrame:
    """Row count as expected, rates within [0, 1], negative drops counted."""
    inside = [F.count_if(~F.col(c).between(0, 1) | F.col(c).isNull()).alias(f"bad_{c}") for c in columns]
    return rates.agg((F.count(F.lit(1)) == expected_rows).alias("rows_ok"), *inside, F.count_if(F.col("drop") < 0).alias("negative_drops"))


def monotone_recall(metrics: DataFrame, ks: tuple[int, ...], tolerance: float = 0.05) -> DataFrame:
    """(keys, ok): success at a larger k isn't below that at a smaller one by more than the tolerance."""
    ok = [F.col(f"recall_{b}") >= F.col(f"recall_{a}") - tolerance for a, b in zip(ks, ks[1:], strict=False)]
    return metrics.withColumn("monotone", F.forall(F.array(*ok), lambda x: x))


def manifest_faults(manifest: DataFrame, required: list[str]) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    return manifest.agg(*[F.count_if(blank(c)).alias(f"missing_{c}") for c in required], (F.count(F.lit(1)) - F.count_distinct("page_id")).alias("duplicate_pages"))
