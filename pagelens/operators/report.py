"""The headline report: channel shares, coupling, faithfulness, gradients by pathway, anchors and efficiency, from metric rows.

``metrics`` has config_id and numbers tor, acr, bpo, boc, eir, slr_miss,
slr_topo, b_slr, b_slr_iou_only, b_slr_text_only, cer, delta_map; a missing
number is null. Everything but the efficiency is of means by config.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stats import finite, mean_of_ratios, r_squared, spearman, steady_mean

LEVELS, PATHWAYS = ("tor", "acr", "bpo", "boc", "eir"), ("slr_miss", "slr_topo")
CHANNELS = {"composite": "b_slr", "iou_only": "b_slr_iou_only", "text_only": "b_slr_text_only"}
COLUMNS = (*LEVELS, *PATHWAYS, *CHANNELS.values(), "cer", "delta_map")
#: Configs of about equal covered share, the ends of the targeted series, and the large erasures.
ANCHORS, ENDPOINTS, ERASURES = ("A05", "A06", "A09", "A10", "A08", "A19"), ("NT01", "NT07"), ("A08", "A19")
#: The configs of the efficiency comparison, as (numerator, config).
EFFICIENCY = (("cer", "A10"), ("cer", "A19"), ("cer", "A08"), ("cer", "NT07"), ("b_slr", "A10"), ("b_slr", "A19"))
FOLDS = (("A10", "A19"), ("A10", "A08"), ("NT07", "A19"))


def fitted_pairs() -> list[tuple[str, str, str, str]]:
    """(section, name, x, y) of every straight-line fit in the report."""
    pairs = [("coupling", "iou_vs_composite", "b_slr_iou_only", "b_slr"), ("coupling", "text_vs_composite", "b_slr_text_only", "b_slr")]
    pairs += [("faithfulness", "b_slr_to_cer", "b_slr", "cer"), ("faithfulness", "b_slr_to_delta_map", "b_slr", "delta_map"), ("footprint", "tor_to_cer", "tor", "cer")]
    pairs += [("pathway", f"{g}_to_{p}", g, p) for p in PATHWAYS for g in LEVELS]
    return pairs + [("channel", f"{g}_to_{k}", g, c) for k, c in CHANNELS.items() for g in LEVELS]


RANKED = [("coupling", "rho_iou_text", "b_slr_iou_only", "b_slr_text_only"), ("faithfulness", "rho_b_slr_cer", "b_slr", "cer"), ("faithfulness", "rho_b_slr_delta_map", "b_slr", "delta_map")]


def config_table(metrics: DataFrame) -> DataFrame:
    """Means of all columns by config; nulls and NaN are left out. Where they are ranked, equal ones tie."""
    ranked = {c for _, _, *xy in RANKED for c in xy}
    return metrics.groupBy("config_id").agg(F.count(F.lit(1)).alias("n_rows"), *((steady_mean(c) if c in ranked else F.avg(finite(c))).alias(c) for c in COLUMNS))


def _long(table: DataFrame, pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """One row for each config and pair, so that all fits are one aggregation."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), F.col(x).alias("x"), F.col(y).alias("y")) for s, n, x, y in pairs]))
    return table.select(each.alias("p")).select("p.*")


def _named(table: DataFrame, section: str, values: dict[str, Column]) -> DataFrame:
    """One row's columns as (section, name, value) rows."""
    cells = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in values.items()])
    return table.select(F.explode(cells).alias("v")).select("v.*")


def headline(metrics: DataFrame) -> DataFrame:
    """(section, name, value) rows; a figure without enough data is null."""
    table = config_table(metrics)
    of = lambda c, config: F.max(F.when(F.col("config_id") == config, F.col(c)))
    picks = {f"{c}_{config}": of(c, config) for config in dict.fromkeys((*ANCHORS, *ENDPOINTS)) for c in ("cer", "b_slr", "tor")} | {f"delta_map_{c}": of("delta_map", c) for c in ERASURES}
    share = F.try_divide(F.avg("b_slr_text_only"), F.when(F.avg("b_slr") > 0, F.avg("b_slr")))
    one = table.agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_configs"), *(F.avg(c).alias(f"mean_{k}") for k, c in CHANNELS.items()), share.alias("text_share"), *(c.alias(n) for n, c in picks.items()))
    out = _named(one, "overview", {c: F.col(c) for c in ("n_rows", "n_configs", *(f"mean_{k}" for k in CHANNELS), "text_share")}).unionByName(_named(one, "config", {n: F.col(n) for n in picks}))
    out = out.unionByName(r_squared(_long(table, fitted_pairs()), "x", "y", ["section", "name"]).select("section", "name", F.col("r2").alias("value")))
    ranks = spearman(_long(table, RANKED), "x", "y", ["section", "name"], least=3)
    out = out.unionByName(ranks.select("section", "name", F.col("r").alias("value")))
    parts = [mean_of_ratios(metrics, c, "tor", ["config_id"]).select(F.lit(c).alias("of"), "config_id", "efficiency") for c in ("cer", "b_slr")]
    per = parts[0].unionByName(parts[1])
    pick = lambda c, config: F.max(F.when((F.col("of") == c) & (F.col("config_id") == config), F.col("efficiency")))
    row = per.agg(*(pick(c, k).alias(f"{c}_{k}") for c, k in EFFICIENCY))
    folds = {f"fold_{a}_{b}": F.try_divide(F.col(f"cer_{a}"), F.when(F.col(f"cer_{b}") > 0, F.col(f"cer_{b}"))) for a, b in FOLDS}
    return out.unionByName(_named(row, "efficiency", {f"{c}_{k}": F.col(f"{c}_{k}") for c, k in EFFICIENCY} | folds))
