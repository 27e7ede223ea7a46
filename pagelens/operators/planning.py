"""Perturbation planning: config tables, sweeps, greedy set cover, policies, layout context."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import centre_box, gap
from .matching import struct_columns

STEP = "struct<probe_type:string,params:map<string,double>,target_strategy:string,target_location:array<int>,reason:string>"
#: Corruption types and the setting at each severity.
CORRUPTIONS = {"gaussian_noise": (8, 16, 24), "gaussian_blur": (3, 5, 9), "jpeg_compression": (70, 45, 25), "brightness_shift": (22, 45, 70)}
EIR_TARGETS, EIR_PROBE = (0.05, 0.10, 0.20, 0.40, 0.60, 0.80, 1.00), {"r": 70.0, "alpha": 0.55}
DELTAS, IOU_LEVELS, SENSITIVITY_PAGES = (3, 5, 7, 10), (0.05, 0.1, 0.2, 0.3), 200
TARGETS = ("anchor", "content", "random", "bridge")
#: The anchor configs, (config, probe, target, parameters).
ANCHORS = (
    ("A01", "P1", "anchor", {"w": 1, "l_ratio": 1.0}), ("A02", "P1", "anchor", {"w": 8, "l_ratio": 1.0}),
    ("A03", "P2", "anchor", {"w": 1, "l_ratio": 1.0}), ("A04", "P2", "anchor", {"w": 8, "l_ratio": 1.0}),
    ("A05", "P3", "anchor", {"r": 60, "alpha": 0.3}), ("A06", "P3", "anchor", {"r": 60, "alpha": 1.0}),
    ("A07", "P4", "content", {"area_ratio": 0.05, "beta": 0.3}), ("A08", "P4", "content", {"area_ratio": 0.20, "beta": 1.0}),
    ("A09", "P5", "bridge", {"w": 1, "l_ratio": 0.5}), ("A10", "P5", "bridge", {"w": 3, "l_ratio": 0.5}),
    ("A11", "P6", "anchor", {"alpha": 0.1, "w": 5}), ("A12", "P6", "anchor", {"alpha": 0.3, "w": 5}),
    ("A13", "P1", "content", {"w": 3, "l_ratio": 1.0}), ("A14", "P1", "random", {"w": 3, "l_ratio": 1.0}),
    ("A15", "P3", "content", {"r": 60, "alpha": 0.5}), ("A16", "P3", "random", {"r": 60, "alpha": 0.5}),
    ("A17", "P5", "content", {"w": 2, "l_ratio": 0.5}), ("A18", "P5", "random", {"w": 2, "l_ratio": 0.5}),
    ("A19", "P4", "bridge", {"area_ratio": 0.20, "beta": 1.0}), ("A20", "P5", "content", {"w": 3, "l_ratio": 0.5}),
    ("A21", "P3", "anchor", {"r": 60, "alpha": 0.5}), ("A22", "P1", "anchor", {"w": 3, "l_ratio": 1.0}),
)
#: Sweep ranges, (config, pair group, probe, target, ranges); integer bounds draw integers. Configs of a pair group draw alike.
SWEEPS = (
    ("S01", "p1", "P1", "anchor", {"w": (1, 10)}), ("S02", "s02", "P2", "anchor", {"w": (1, 10)}),
    ("S03", "p3", "P3", "anchor", {"r": (30, 90), "alpha": (0.2, 1.0)}), ("S04", "s04", "P4", "content", {"area_ratio": (0.03, 0.25), "beta": (0.2, 1.0)}),
    ("S05", "s05", "P5", "bridge", {"w": (1, 5), "l_ratio": (0.2, 0.8)}), ("S06", "s06", "P6", "anchor", {"alpha": (0.05, 0.4), "w": (2, 10)}),
    ("S07", "s07", "P8", "random", {"n_points": (10, 100), "r": (1, 4), "sigma": (10, 50)}), ("S08", "s08", "P9", "anchor", {"r_base": (30, 80), "epsilon": (0.1, 0.5), "alpha": (0.3, 0.7)}),
    ("S09", "s09", "P10", "anchor", {"theta": (20, 70), "w": (1, 6)}), ("S10", "p1", "P1", "content", {"w": (1, 10)}),
    ("S11", "p1", "P1", "random", {"w": (1, 10)}), ("S12", "p3", "P3", "content", {"r": (30, 90), "alpha": (0.2, 1.0)}),
    ("S13", "p3", "P3", "random", {"r": (30, 90), "alpha": (0.2, 1.0)}),
)
#: Parameter ranges of the random policy.
RANGES = {
    "P1": {"w": (1, 10), "l_ratio": (0.5, 1.0)}, "P2": {"w": (1, 10), "l_ratio": (0.5, 1.0)}, "P3": {"r": (30, 90), "alpha": (0.2, 1.0)},
    "P4": {"area_ratio": (0.03, 0.25), "beta": (0.2, 1.0)}, "P5": {"w": (1, 5), "l_ratio": (0.2, 0.8)}, "P6": {"alpha": (0.05, 0.4), "w": (2, 10)},
    "P8": {"n_points": (10, 100), "r": (1, 4), "sigma": (10, 50)}, "P9": {"r_base": (30, 80), "epsilon": (0.1, 0.5), "alpha": (0.3, 0.7)}, "P10": {"theta": (20, 70), "w": (1, 6)},
}
PROBES = tuple(RANGES)


def corruption_grid(spark: SparkSession) -> DataFrame:
    rows = [(f"G{3 * i + j + 1:02d}", kind, j + 1, float(v)) for i, (kind, levels) in enumerate(CORRUPTIONS.items()) for j, v in enumerate(levels)]
    return spark.createDataFrame(rows, "config_id string, corruption string, severity int, setting double")


def anchor_configs(spark: SparkSession) -> DataFrame:
    rows = [(c, p, t, {k: float(v) for k, v in params.items()}) for c, p, t, params in ANCHORS]
    return spark.createDataFrame(rows, "config_id string, probe_type string, target_strategy string, params map<string,double>")


def eir_configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"NT{i + 1:02d}", t) for i, t in enumerate(EIR_TARGETS)], "config_id string, target_eir double")


def sweep_configs(spark: SparkSession) -> DataFrame:
    """(config_id, pair_group, probe_type, target_strategy, param, lo, hi, is_int)."""
    rows = [(c, g, p, t, n, float(lo), float(hi), isinstance(lo, int)) for c, g, p, t, ranges in SWEEPS for n, (lo, hi) in ranges.items()]
    return spark.createDataFrame(rows, "config_id string, pair_group string, probe_type string, target_strategy string, param string, lo double, hi double, is_int boolean")


def sensitivity_grid(spark: SparkSession) -> DataFrame:
    rows = [("delta", "delta", float(d)) for d in DELTAS] + [("iou", "iou_threshold", t) for t in IOU_LEVELS]
    return spark.createDataFrame(rows, "analysis string, param_name string, param_value double")


def hash_uniform(*parts: Column) -> Column:
    """[0, 1) from the md5 of the joined parts: depends on keys alone, so a resumed run draws the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(2.0**52)


def sample_sweeps(pages: DataFrame, sweeps: DataFrame, seed: str = "42") -> DataFrame:
    """(page_id, config_id, param, value): integer ranges include both ends; the draw hangs on the pair group, not the config."""
    rows = pages.crossJoin(F.broadcast(sweeps))  # the literal sweep table
    u = hash_uniform(F.lit(seed), F.col("pair_group"), F.col("page_id").cast("string"), F.col("param"))
    value = F.when(F.col("is_int"), F.floor(F.col("lo") + u * (F.col("hi") - F.col("lo") + 1)).cast("double")).otherwise(F.col("lo") + u * (F.col("hi") - F.col("lo")))
    return rows.select("page_id", "config_id", "param", value.alias("value"))


def draw(seed: str, name: str, lo: float, hi: float, *more: Column) -> Column:
    """A number of the page in [lo, hi), or between whole numbers with both ends, by :func:`hash_uniform`."""
    u = hash_uniform(F.lit(seed), F.col("page_id").cast("string"), F.lit(name), *more)
    return F.floor(lo + u * (hi - lo + 1)).cast("double") if isinstance(lo, int) else lo + u * (hi - lo)


def choice(seed: str, name: str, values: tuple[str, ...], *more: Column) -> Column:
    u = hash_uniform(F.lit(seed), F.col("page_id").cast("string"), F.lit(name), *more)
    return F.element_at(F.array(*map(F.lit, values)), F.floor(u * len(values)).cast("int") + 1)


def step_of(probe: str | Column, params: dict[str, Column] | Column, strategy: str | Column, reason: str, x: Column | None = None, y: Column | None = None) -> Column:
    """A plan step; without a place the target strategy finds one."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    params = params if isinstance(params, Column) else F.create_map(*[c for n, v in params.items() for c in (F.lit(n), v)])
    place = F.lit(None) if x is None else F.when(x.isNotNull() & y.isNotNull(), F.array(x.cast("int"), y.cast("int")))
    fields = {"probe_type": as_column(probe), "params": params.cast("map<string,double>"), "target_strategy": as_column(strategy), "target_location": place.cast("array<int>"), "reason": F.lit(reason)}
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def random_policy(pages: DataFrame, seed: str = "42") -> DataFrame:
    """(page_id, steps): one to three uniform steps a page, parameters from the probe's ranges, places left to the strategy."""
    n = F.floor(hash_uniform(F.lit(seed), F.col("page_id").cast("string"), F.lit("n")) * 3).cast("int")
    rows = pages.select("page_id", F.explode(F.sequence(F.lit(0), n)).alias("step_no"))
    no = F.col("step_no").cast("string")
    rows = rows.withColumn("probe", choice(seed, "probe", PROBES, no)).withColumn("target", choice(seed, "target", TARGETS, no))
    params = F.create_map().cast("map<string,double>")
    for probe, ranges in RANGES.items():
        params = F.when(F.col("probe") == probe, F.create_map(*[x for n, (lo, hi) in ranges.items() for x in (F.lit(n), draw(seed, n, lo, hi, no))])).otherwise(params)
    steps = F.array_sort(F.collect_list(F.struct("step_no", step_of(F.col("probe"), params, F.col("target"), "random").alias("step"))), lambda a, b: a.step_no - b.step_no)
    return rows.groupBy("page_id").agg(F.transform(steps, lambda s: s.step).alias("steps"))


def vulnerable_gaps(elements: DataFrame, most: float = 80, n: int = 10) -> DataFrame:
    """(page_id, rank, i, j, width, direction, cx, cy): the narrowest free strips between two blocks of a page."""
    a, b = elements.alias("a"), elements.alias("b")
    box = lambda s: centre_box(*(F.col(f"{s}.{c}") for c in ("x", "y", "w", "h")))
    pairs = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.elem_id") < F.col("b.elem_id")))
    rows = pairs.select(F.col("a.page_id").alias("page_id"), F.col("a.elem_id").alias("i"), F.col("b.elem_id").alias("j"), gap(box("a"), box("b")).alias("g"))
    rows = rows.filter("g.width > 0 and g.width < {}".format(most)).select("page_id", "i", "j", "g.*")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("width", "i", "j"))).filter(F.col("rank") <= n)


def bridge_pair(elements: DataFrame) -> DataFrame:
    """(page_id, i, j, cx, cy, fallback): middle of the closest pair of block centres; the page's middle under two blocks."""
    from ..sources.fixtures import PAGE_H, PAGE_W

    a, b = elements.alias("a"), elements.alias("b")
    pairs = a.join(b, (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.elem_id") < F.col("b.elem_id")))
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    mid = lambda c: F.floor((F.col(f"a.{c}") + F.col(f"b.{c}")) / 2).alias(f"c{c}")
    best = pairs.groupBy(F.col("a.page_id").alias("page_id")).agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), F.col("a.elem_id").alias("i"), F.col("b.elem_id").alias("j"), mid("x"), mid("y"))).alias("p"))
    rows = elements.select("page_id").distinct().join(best, "page_id", "left")
    return rows.select("page_id", "p.i", "p.j", F.coalesce("p.cx", F.lit(PAGE_W // 2)).alias("cx"), F.coalesce("p.cy", F.lit(PAGE_H // 2)).alias("cy"), F.col("p").isNull().alias("fallback"))


def nearest_block(targets: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., elem_id): block of the page with the centre nearest to (cx, cy), else the first block; null without blocks."""
    rows = targets.select(*keys, "cx", "cy").join(blocks.select("page_id", "elem_id", "x", "y"), "page_id", "left")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    best = rows.groupBy(*keys).agg(F.min(F.struct(F.coalesce(dx * dx + dy * dy, F.lit(0)).alias("d"), F.col("elem_id").alias("e"))).alias("b"))
    return best.select(*keys, F.col("b.e").alias("elem_id"))


def layout_context(elements: DataFrame, page_w: int) -> DataFrame:
    """Per page: n_blocks, has_table, has_figure, multi_column (four blocks, two centres well left and two well right)."""
    x = F.col("x")
    left, right = F.count_if(x < 0.45 * page_w) >= 2, F.count_if(x > 0.55 * page_w) >= 2
    return elements.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.bool_or(F.lower("type") == "table").alias("has_table"), F.bool_or(F.lower("type") == "figure").alias("has_figure"), ((F.count(F.lit(1)) >= 4) & left & right).alias("multi_column"))


def first_tables(elements: DataFrame) -> DataFrame:
    """(page_id, table_x, table_y): middle of the right edge of a page's first table."""
    t = elements.filter(F.lower("type") == "table")
    right, y1, y2 = F.floor(F.col("x") + F.col("w") / 2.0), F.floor(F.col("y") - F.col("h") / 2.0), F.floor(F.col("y") + F.col("h") / 2.0)
    return t.groupBy("page_id").agg(F.min_by(F.struct(right.alias("x"), F.floor((y1 + y2) / 2).alias("y")), "elem_id").alias("t")).select("page_id", F.col("t.x").alias("table_x"), F.col("t.y").alias("table_y"))


def rule_policy(context: DataFrame, gaps: DataFrame, tables: DataFrame, seed: str = "42") -> DataFrame:
    """(page_id, steps): at most two steps, by the narrowest gap, then columns, then a table; else one random step.

    Gaps under 15 get a bridge, under 40 a crease along their direction; draws
    hash (seed, page).
    """
    first = gaps.filter("rank = 1").select("page_id", F.col("width").alias("gap"), "direction", "cx", "cy")
    rows = context.join(first, "page_id", "left").join(tables, "page_id", "left")
    gap, at = F.col("gap"), (F.col("cx"), F.col("cy"))
    # The reasons a plan carries.
    bridge = step_of("P5", {"w": F.greatest(F.lit(1.0), gap * 0.4), "l_ratio": draw(seed, "bridge", 0.3, 0.6)}, "bridge", "Exploit narrow structural gap", *at)
    crease = lambda p, reason: step_of(p, {"w": draw(seed, "crease", 2.0, 5.0), "l_ratio": F.lit(1.0)}, "anchor", reason, *at)
    columns = step_of("P2", {"w": draw(seed, "columns", 2.0, 6.0), "l_ratio": F.lit(1.0)}, "anchor", "Multi-column bridge attack")
    stamp = step_of("P3", {"r": draw(seed, "stamp_r", 40.0, 70.0), "alpha": draw(seed, "stamp_alpha", 0.4, 0.8)}, "anchor", "Stamp on table boundary", F.col("table_x"), F.col("table_y"))
    other = step_of(choice(seed, "fallback", ("P1", "P5", "P6")), {"w": draw(seed, "fallback_w", 2.0, 5.0), "l_ratio": draw(seed, "fallback_l", 0.5, 1.0)}, "anchor", "Fallback")
    near = F.when(gap < 15, bridge).when((gap < 40) & (F.col("direction") == "vertical"), crease("P1", "Crease through vertical gap")).when(gap < 40, crease("P2", "Crease through horizontal gap"))
    steps = F.slice(F.array_compact(F.array(near, F.when(F.col("multi_column"), columns), F.when(F.col("table_x").isNotNull(), stamp))), 1, 2)
    return rows.select("page_id", F.when(F.size(steps) > 0, steps).otherwise(F.array(other)).alias("steps"))


def sampled_targets(rects: DataFrame, pages: DataFrame, keys: list[str], page_w: int, page_h: int, seed: str = "42") -> DataFrame:
    """(keys..., x, y): a uniform pixel of each page's mask, given as disjoint rectangles; the page's middle for an empty mask.

    Rectangles are laid end to end by their areas; a hashed number of the page
    picks the pixel, so nothing is painted and a rerun draws the same.
    """
    size = (F.col("x1") - F.col("x0")).cast("long") * (F.col("y1") - F.col("y0"))
    line = Window.partitionBy(*keys).orderBy("y0", "x0")
    laid = rects.withColumn("_end", F.sum(size).over(line)).withColumn("_all", F.sum(size).over(Window.partitionBy(*keys)))
    u = hash_uniform(F.lit(seed), *(F.col(k).cast("string") for k in keys), F.lit("place"))
    laid = laid.withColumn("_at", F.floor(u * F.col("_all"))).withColumn("_in", F.col("_at") - (F.col("_end") - size))
    width = F.col("x1") - F.col("x0")
    hit = laid.filter((F.col("_in") >= 0) & (F.col("_at") < F.col("_end"))).select(*keys, (F.col("x0") + F.pmod("_in", width)).alias("x"), (F.col("y0") + F.floor(F.col("_in") / width)).alias("y"))
    rows = pages.select(*keys).join(hit, keys, "left")
    return rows.select(*keys, F.coalesce("x", F.lit(page_w // 2)).alias("x"), F.coalesce("y", F.lit(page_h // 2)).alias("y"))


def random_targets(pages: DataFrame, keys: list[str], page_w: int, page_h: int, seed: str = "42") -> DataFrame:
    u = lambda axis: hash_uniform(F.lit(seed), *(F.col(k).cast("string") for k in keys), F.lit(axis))
    return pages.select(*keys, F.floor(u("x") * page_w).alias("x"), F.floor(u("y") * page_h).alias("y"))


def targets(elements: DataFrame, page_w: int, page_h: int, seed: str = "42") -> DataFrame:
    """(page_id, target_strategy, x, y): a page's place under each strategy; the middle of the page where a mask is empty."""
    from . import masks

    box = {"x1": "x - w / 2.0", "y1": "y - h / 2.0", "x2": "x + w / 2.0", "y2": "y + h / 2.0"}
    boxes = elements.select("page_id", *(F.bround(F.expr(v)).cast("int").alias(k) for k, v in box.items()))
    pages, keys = elements.select("page_id").distinct(), ["page_id"]
    content = masks.union(masks.clipped(boxes, keys, page_w, page_h), keys)
    found = {
        "anchor": sampled_targets(masks.outline_bands(boxes, keys, 5, page_w, page_h), pages, keys, page_w, page_h, seed), "content": sampled_targets(content, pages, keys, page_w, page_h, seed),
        "random": random_targets(pages, keys, page_w, page_h, seed), "bridge": bridge_pair(elements).select("page_id", F.col("cx").alias("x"), F.col("cy").alias("y")),
    }
    sides = [df.select("page_id", F.lit(name).alias("target_strategy"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")) for name, df in found.items()]
    return sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3])


def phase_plans(pages: DataFrame, configs: DataFrame, places: DataFrame, done: DataFrame | None = None, static: DataFrame | None = None) -> DataFrame:
    """(page_id, config_id, steps) of every page under every config that isn't done yet.

    ``configs`` is a literal table (config_id, probe_type, target_strategy,
    params), ``places`` comes from :func:`targets`, ``done`` holds finished
    (page_id, config_id) and ``static`` recorded steps that win over the template.
    """
    rows = pages.select("page_id").crossJoin(F.broadcast(configs))  # a literal config table
    if done is not None:
        rows = rows.join(done.select("page_id", "config_id"), ["page_id", "config_id"], "left_anti")
    rows = rows.join(places, ["page_id", "target_strategy"], "left")
    made = F.array(step_of(F.col("probe_type"), F.col("params"), F.col("target_strategy"), "config", F.col("x"), F.col("y")))
    rows = rows.select("page_id", "config_id", made.alias("steps"))
    if static is None:
        return rows
    return rows.join(static.select("page_id", "config_id", F.col("steps").alias("_own")), ["page_id", "config_id"], "left").select("page_id", "config_id", F.coalesce("_own", "steps").alias("steps"))


def targeted_plans(elements: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """(page_id, config_id, steps) of the targeted configs: the fixed stamp at each greedy position, at the page's middle where there is none."""
    params = F.create_map(*[c for n, v in EIR_PROBE.items() for c in (F.lit(n), F.lit(v))])
    stamp = lambda x, y: step_of("P3", params, "anchor", "targeted", x, y)
    out = None
    for i, share in enumerate(EIR_TARGETS):
        found = greedy_cover(elements, share, int(EIR_PROBE["r"]), page_w, page_h).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("probe_no", "cx", "cy"))).alias("at"))
        rows = elements.select("page_id").distinct().join(found, "page_id", "left")
        middle = F.array(stamp(F.lit(page_w // 2), F.lit(page_h // 2)))
        part = rows.select("page_id", F.lit(f"NT{i + 1:02d}").alias("config_id"), F.coalesce(F.transform("at", lambda a: stamp(a.cx, a.cy)), middle).alias("steps"))
        out = part if out is None else out.unionByName(part)
    return out


def area_matched_ratio(tor: Column, h: Column, w: Column) -> Column:
    side = F.least(h, w)
    return F.greatest(F.lit(0.0002), F.least(F.lit(0.05), tor * h * w / (side * side)))


def reach_matrix(boxes: np.ndarray, radius: float, page_w: int, page_h: int) -> tuple[np.ndarray, np.ndarray]:
    """Probe centres, one a box (x, y, w, h), kept ``radius`` from the page's border; and which boxes each reaches (half sizes rounded down)."""
    room = np.asarray([page_w - radius, page_h - radius])
    centres = np.maximum(radius, np.minimum(boxes[:, :2], room))
    away = np.maximum(np.abs(centres[:, None] - boxes[:, :2]) - boxes[:, 2:] // 2, 0)
    return centres, (away.astype(float) ** 2).sum(2) < radius * radius


def cover_steps(boxes: np.ndarray, share: float, radius: int, most: int, page_w: int, page_h: int) -> list[tuple[int, int, int]]:
    """(cx, cy, gained): centres picked one by one for the most boxes still free, the first of ties, until the share is reached."""
    if not len(boxes) or share <= 0:
        return []
    centres, reach = reach_matrix(boxes, radius, page_w, page_h)
    free, steps = np.ones(len(boxes), bool), []
    while len(steps) < most and (~free).sum() < max(1, round(len(boxes) * share)):
        gains = (reach & free).sum(1)
        best = int(gains.argmax())
        if not gains[best]:
            break
        free &= ~reach[best]
        steps.append((int(centres[best, 0]), int(centres[best, 1]), int(gains[best])))
    return steps


def greedy_cover(elements: DataFrame, share: float, radius: int, page_w: int, page_h: int, most: int = 30) -> DataFrame:
    """(page_id, probe_no, cx, cy, gained): probes until the wanted share of a page's blocks (at least one) is reached.

    Stops at no gain or at ``most`` probes, a limit of the feature; a share of
    0 picks none. Each pick hangs on those before, so a page is one fold.
    """
    pages = elements.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("elem_id", "x", "y", "w", "h"))).alias("b"))
    step = pa.list_(pa.struct([("cx", pa.int64()), ("cy", pa.int64()), ("gained", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, columns = struct_columns(batch.column("b"), ("x", "y", "w", "h"))
            boxes = np.stack(columns, 1)
            steps = [[dict(zip(("cx", "cy", "gained"), s, strict=True)) for s in cover_steps(boxes[lo:hi], share, radius, most, page_w, page_h)] for lo, hi in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(steps, step)], names=["page_id", "s"])

    rows = pages.mapInArrow(run, "page_id long, s array<struct<cx:long,cy:long,gained:int>>")
    return rows.select("page_id", F.posexplode("s").alias("probe_no", "s")).select("page_id", "probe_no", "s.*")


def best_config(metrics: DataFrame, default: str, most_tor: float = 0.03, parsers: int = 2) -> DataFrame:
    """The config with the best loss per covered share over at least two parsers, else the default."""
    per = metrics.groupBy("config_id").agg(F.avg("tor").alias("tor"), F.avg("b_slr").alias("b_slr"), F.avg("slr_topo").alias("topo"), F.avg("slr_miss").alias("miss"), F.count_distinct("parser").alias("parsers"))
    ok = per.filter((F.col("tor") > 0) & (F.col("tor") <= most_tor) & (F.col("parsers") >= parsers))
    scored = ok.withColumn("score", F.try_divide("b_slr", "tor") + 10 * F.col("topo") - 2 * F.col("miss"))
    best = scored.orderBy(F.desc("score"), "config_id").limit(1).select("config_id", "score")
    fallback = metrics.sparkSession.createDataFrame([(default, None)], "config_id string, score double")
    return best.unionByName(fallback).orderBy(F.col("score").isNull()).limit(1)
