"""Queries over geometry, parse records, planning, sources and audits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import audits, external, pages, parse_records, placing, planning, raster, report
from ..sources import files
from ..sources import fixtures as fx
from .damage import match_of
from .registry import query
from .text import LINES_SQL, sql_norm, sql_tokens

_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder the cluster shares; a temporary one only where none is set and the master is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _scratch:
            _scratch.append(tempfile.mkdtemp(prefix="pagelens-"))
        base = _scratch[0]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_EVENT_BOX = "CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 9 = 1 THEN [1.0::DOUBLE, 2.0] ELSE [(event_id % 50)::DOUBLE, (event_id % 30)::DOUBLE, (event_id % 50 + event_id % 13 - 3)::DOUBLE, (event_id % 30 + event_id % 11 - 1)::DOUBLE] END"
_SUPPORT = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE [(event_id % 40)::DOUBLE, (event_id % 20)::DOUBLE, (event_id % 40 + 12)::DOUBLE, (event_id % 20 + 9)::DOUBLE] END"


def boxed_events(spark: SparkSession, sf: str) -> DataFrame:
    e, d = F.col("event_id"), lambda c: c.cast("double")
    box = F.when(e % 9 == 0, None).when(e % 9 == 1, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(d(e % 50), d(e % 30), d(e % 50 + e % 13 - 3), d(e % 30 + e % 11 - 1)))
    support = F.when(e % 5 == 0, None).otherwise(F.array(d(e % 40), d(e % 20), d(e % 40 + 12), d(e % 20 + 9)))
    return fx.table(spark, sf, "events").select("event_id", box.alias("box"), support.alias("support"))


@query("geo03_06_boxes", f"""WITH b AS (SELECT event_id, {_EVENT_BOX} AS b, {_SUPPORT} AS s FROM events),
a AS (SELECT *, CASE WHEN len(b) >= 4 THEN greatest(0, b[3] - b[1]) * greatest(0, b[4] - b[2]) ELSE 0 END AS ab, CASE WHEN s IS NULL THEN 0 ELSE 108 END AS asup FROM b),
i AS (SELECT *, CASE WHEN ab > 0 AND asup > 0 THEN greatest(0, least(b[3], s[3]) - greatest(b[1], s[1])) * greatest(0, least(b[4], s[4]) - greatest(b[2], s[2])) ELSE 0 END AS inter FROM a),
r AS (SELECT *, coalesce(inter / nullif(ab + asup - inter, 0), 0)::DOUBLE AS iou, coalesce(inter / nullif(ab, 0), 0)::DOUBLE AS share FROM i)
SELECT event_id, ab::DOUBLE AS area, round(iou, 6) AS iou, round(share, 6) AS share, share <= 0.05 AND iou <= 0.01 AS non_overlap, ab > 0 AND (share < 0.05 OR iou < 0.01) AS in_subset, coalesce(len(b) >= 4 AND b[3] > b[1] AND b[4] > b[2], false) AS proper FROM r""")
def geo03(spark: SparkSession, sf: str) -> DataFrame:
    b, s = F.col("box"), F.col("support")
    return boxed_events(spark, sf).select(
        "event_id", geo.area(b).alias("area"), F.round(geo.array_iou(b, s), 6).alias("iou"), F.round(geo.overlap_ratio(b, s), 6).alias("share"),
        geo.is_non_overlap(b, s).alias("non_overlap"), geo.in_non_overlap_subset(b, s).alias("in_subset"), geo.normalize_bbox(b).isNotNull().alias("proper"),
    )


@query("geo08_faults", f"""WITH b AS (SELECT event_id, {_EVENT_BOX} AS b FROM events)
SELECT event_id, CASE WHEN b IS NULL OR len(b) < 4 THEN 'bad_shape' WHEN b[3] <= b[1] OR b[4] <= b[2] THEN 'bad_order' WHEN b[3] > 40 + 10 OR b[4] > 25 + 10 THEN 'out_of_page' END AS fault FROM b""")
def geo08(spark: SparkSession, sf: str) -> DataFrame:
    return boxed_events(spark, sf).select("event_id", geo.bbox_fault(F.col("box"), F.lit(40.0), F.lit(25.0)).alias("fault"))


@query("geo09_rescale", """WITH e AS (SELECT event_id, 500 + event_id % 900 AS w, 700 + event_id % 1100 AS h FROM events)
SELECT event_id, round(1024.0::DOUBLE / greatest(w, h), 9) AS scale, CAST(round_even(w * (1024.0::DOUBLE / greatest(w, h)), 0) AS INT) AS new_w, CAST(round_even(h * (1024.0::DOUBLE / greatest(w, h)), 0) AS INT) AS new_h FROM e""")
def geo09(spark: SparkSession, sf: str) -> DataFrame:
    s = geo.rescale(500 + F.col("event_id") % 900, 700 + F.col("event_id") % 1100)
    return fx.table(spark, sf, "events").select("event_id", s.alias("s")).select("event_id", F.round("s.scale", 9).alias("scale"), "s.new_w", "s.new_h")


_CB = "x - w / 2.0 AS x1, y - h / 2.0 AS y1, x + w / 2.0 AS x2, y + h / 2.0 AS y2"


@query("join07_vulnerable_gaps", f"""WITH {fx.CTES}, b AS (SELECT page_id, elem_id, {_CB} FROM clean),
p AS (SELECT a.page_id, a.elem_id AS i, b.elem_id AS j, greatest(a.y1, b.y1) - least(a.y2, b.y2) AS v, greatest(a.x1, b.x1) - least(a.x2, b.x2) AS g, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS side, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS tall FROM b a JOIN b ON a.page_id = b.page_id AND a.elem_id < b.elem_id),
q AS (SELECT page_id, i, j, CASE WHEN v > 0 AND side > 0 THEN v WHEN g > 0 AND tall > 0 THEN g END::DOUBLE AS width, CASE WHEN v > 0 AND side > 0 THEN 'vertical' WHEN g > 0 AND tall > 0 THEN 'horizontal' END AS direction FROM p)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY width, i, j) AS INT) AS rank, i, j, width, direction FROM q WHERE width > 0 AND width < 80 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY width, i, j) <= 10""")
def join07(spark: SparkSession, sf: str) -> DataFrame:
    return planning.vulnerable_gaps(fx.clean_elements(spark, sf)).select("page_id", "rank", "i", "j", "width", "direction")


@query("join06_bridge", f"""WITH {fx.CTES}, p AS (SELECT a.page_id, a.elem_id AS i, b.elem_id AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d, CAST(floor((a.x + b.x) / 2.0) AS BIGINT) AS cx, CAST(floor((a.y + b.y) / 2.0) AS BIGINT) AS cy FROM clean a JOIN clean b ON a.page_id = b.page_id AND a.elem_id < b.elem_id QUALIFY row_number() OVER (PARTITION BY a.page_id ORDER BY d, i, j) = 1)
SELECT c.page_id, coalesce(i, -1) AS i, coalesce(j, -1) AS j, coalesce(cx, 500) AS cx, coalesce(cy, 700) AS cy, i IS NULL AS fallback FROM (SELECT DISTINCT page_id FROM clean) c LEFT JOIN p USING (page_id)""")
def join06(spark: SparkSession, sf: str) -> DataFrame:
    return planning.bridge_pair(fx.clean_elements(spark, sf)).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("i", "j")})


@query("join16_nearest_block", f"""WITH {fx.CTES}, t AS (SELECT page_id, config_id, (mx1 + 10) AS cx, (my1 + 10) AS cy FROM mask)
SELECT page_id, config_id, elem_id FROM t JOIN clean USING (page_id) QUALIFY row_number() OVER (PARTITION BY page_id, config_id ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), elem_id) = 1""")
def join16(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.page_configs(spark, sf).select("page_id", "config_id", (F.col("mx1") + 10).alias("cx"), (F.col("my1") + 10).alias("cy"))
    return planning.nearest_block(t, fx.clean_elements(spark, sf), ["page_id", "config_id"])


@query("agg10_11_context", f"""WITH {fx.CTES} SELECT page_id, count(*) AS n_blocks, bool_or(type = 'table') AS has_table, bool_or(type = 'figure') AS has_figure, count(*) >= 4 AND count(*) FILTER (x < 450) >= 2 AND count(*) FILTER (x > 550) >= 2 AS multi_column FROM clean GROUP BY page_id""")
def agg10(spark: SparkSession, sf: str) -> DataFrame:
    return planning.layout_context(fx.clean_elements(spark, sf), fx.PAGE_W)


def _u(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"


def _draw(name: str, lo: float, hi: float, *more: str) -> str:
    u = _u("'42'", "CAST(page_id AS VARCHAR)", f"'{name}'", *more)
    return f"floor({lo} + {u} * {hi - lo + 1})::DOUBLE" if isinstance(lo, int) else f"({lo}::DOUBLE + {u} * {hi - lo}::DOUBLE)"


def _choice(name: str, values: tuple[str, ...], *more: str) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"[{listed}][CAST(floor({_u(chr(39) + '42' + chr(39), 'CAST(page_id AS VARCHAR)', chr(39) + name + chr(39), *more)} * {len(values)}) AS INT) + 1]"


#: Parameters any probe has; a step's row shows those it uses, the others null.
PARAMS = sorted({n for r in planning.RANGES.values() for n in r})


def plan_rows(plans: DataFrame) -> DataFrame:
    """One row a step, its parameters as columns; -1 for a place left to the strategy."""
    rows = plans.select("page_id", F.posexplode("steps").alias("step_no", "s"))
    return rows.select("page_id", "step_no", F.col("s.probe_type").alias("probe_type"), F.col("s.target_strategy").alias("target"), *(F.coalesce(F.try_element_at("s.target_location", F.lit(i)), F.lit(-1)).alias(n) for i, n in ((1, "at_x"), (2, "at_y"))), F.col("s.reason").alias("reason"), *(F.round(F.try_element_at("s.params", F.lit(n)), 6).alias(f"p_{n}") for n in PARAMS))


def _params(given: dict[str, str]) -> str:
    return ", ".join(f"{f'round({given[n]}, 6)' if n in given else 'NULL'}::DOUBLE AS p_{n}" for n in PARAMS)


def _rule(no: str, when: str, probe: str, target: str, at: tuple[str, str], reason: str, **given: str) -> str:
    return f"SELECT page_id, {no} AS k, {probe} AS probe_type, '{target}' AS target, {at[0]} AS at_x, {at[1]} AS at_y, '{reason}' AS reason, {_params(given)} FROM c WHERE {when}"


_NOWHERE, _GAP_AT = ("-1", "-1"), ("CAST(cx AS INT)", "CAST(cy AS INT)")
_GAPS = """gb AS (SELECT page_id, elem_id, x - w / 2.0 AS x1, y - h / 2.0 AS y1, x + w / 2.0 AS x2, y + h / 2.0 AS y2 FROM clean),
gp AS (SELECT a.page_id, a.elem_id AS i, b.elem_id AS j, greatest(a.y1, b.y1) - least(a.y2, b.y2) AS v, greatest(a.x1, b.x1) - least(a.x2, b.x2) AS g, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS side, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS tall,
  floor((greatest(a.x1, b.x1) + least(a.x2, b.x2)) / 2) AS mx, floor((greatest(a.y1, b.y1) + least(a.y2, b.y2)) / 2) AS my FROM gb a JOIN gb b ON a.page_id = b.page_id AND a.elem_id < b.elem_id),
gq AS (SELECT page_id, i, j, mx AS cx, my AS cy, CASE WHEN v > 0 AND side > 0 THEN v WHEN g > 0 AND tall > 0 THEN g END::DOUBLE AS width, CASE WHEN v > 0 AND side > 0 THEN 'vertical' WHEN g > 0 AND tall > 0 THEN 'horizontal' END AS direction FROM gp),
gaps AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY width, i, j) AS rank FROM gq WHERE width > 0 AND width < 80)"""
_CONTEXT = "ctx AS (SELECT page_id, count(*) AS n_blocks, bool_or(type = 'table') AS has_table, bool_or(type = 'figure') AS has_figure, count(*) >= 4 AND count(*) FILTER (x < 450) >= 2 AND count(*) FILTER (x > 550) >= 2 AS multi_column FROM clean GROUP BY page_id)"


@query("plan13_rule_policy", f"""WITH {fx.CTES}, {_GAPS}, {_CONTEXT},
tb AS (SELECT page_id, CAST(floor(x + w / 2.0) AS INT) AS tx, CAST(floor((floor(y - h / 2.0) + floor(y + h / 2.0)) / 2) AS INT) AS ty FROM clean WHERE type = 'table' QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY elem_id) = 1),
c AS (SELECT ctx.page_id, multi_column, width AS gap, direction, cx, cy, tx, ty FROM ctx LEFT JOIN gaps g ON g.page_id = ctx.page_id AND rank = 1 LEFT JOIN tb ON tb.page_id = ctx.page_id),
s AS ({_rule('1', 'gap < 15', "'P5'", 'bridge', _GAP_AT, 'Exploit narrow structural gap', w='greatest(1.0, gap * 0.4)', l_ratio=_draw('bridge', 0.3, 0.6))}
 UNION ALL {_rule('1', "gap >= 15 AND gap < 40 AND direction = 'vertical'", "'P1'", 'anchor', _GAP_AT, 'Crease through vertical gap', w=_draw('crease', 2.0, 5.0), l_ratio='1.0')}
 UNION ALL {_rule('1', "gap >= 15 AND gap < 40 AND direction <> 'vertical'", "'P2'", 'anchor', _GAP_AT, 'Crease through horizontal gap', w=_draw('crease', 2.0, 5.0), l_ratio='1.0')}
 UNION ALL {_rule('2', 'multi_column', "'P2'", 'anchor', _NOWHERE, 'Multi-column bridge attack', w=_draw('columns', 2.0, 6.0), l_ratio='1.0')}
 UNION ALL {_rule('3', 'tx IS NOT NULL', "'P3'", 'anchor', ('tx', 'ty'), 'Stamp on table boundary', r=_draw('stamp_r', 40.0, 70.0), alpha=_draw('stamp_alpha', 0.4, 0.8))}
 UNION ALL {_rule('4', 'NOT multi_column AND tx IS NULL AND coalesce(gap, 99) >= 40', _choice('fallback', ('P1', 'P5', 'P6')), 'anchor', _NOWHERE, 'Fallback', w=_draw('fallback_w', 2.0, 5.0), l_ratio=_draw('fallback_l', 0.5, 1.0))}),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS INT) AS step_no FROM s)
SELECT * EXCLUDE (k) FROM n WHERE step_no < 2""")
def plan13(spark: SparkSession, sf: str) -> DataFrame:
    e = fx.clean_elements(spark, sf)
    return plan_rows(planning.rule_policy(planning.layout_context(e, fx.PAGE_W), planning.vulnerable_gaps(e), planning.first_tables(e)))


_NO = "CAST(step_no AS VARCHAR)"


def _of_probe(name: str) -> str:
    """CASE over the probes that have the parameter, each with its own range."""
    whens = " ".join(f"WHEN '{p}' THEN {_draw(name, *r[name], _NO)}" for p, r in planning.RANGES.items() if name in r)
    return f"CASE probe_type {whens} END"


@query("plan12_random_policy", f"""WITH p AS (SELECT DISTINCT l_orderkey AS page_id FROM lineitem), n AS (SELECT page_id, unnest(range(0, CAST(floor({_u("'42'", 'CAST(page_id AS VARCHAR)', "'n'")} * 3) AS BIGINT) + 1)) AS step_no FROM p),
s AS (SELECT page_id, CAST(step_no AS INT) AS step_no, {_choice('probe', planning.PROBES, _NO)} AS probe_type, {_choice('target', planning.TARGETS, _NO)} AS target FROM n)
SELECT *, -1 AS at_x, -1 AS at_y, 'random' AS reason, {_params({n: _of_probe(n) for n in PARAMS})} FROM s""")
def plan12(spark: SparkSession, sf: str) -> DataFrame:
    return plan_rows(planning.random_policy(fx.clean_elements(spark, sf).select("page_id").distinct()))


@query("txt28_descriptions", f"""WITH {fx.CTES}, {_GAPS}, {_CONTEXT}, l AS (SELECT page_id, string_agg(format('  Block {{}}: {{}} [{{}}, {{}}, {{}}, {{}}]', elem_id, type, CAST(round_even(x - w / 2.0, 0) AS INT), CAST(round_even(y - h / 2.0, 0) AS INT), CAST(round_even(x + w / 2.0, 0) AS INT), CAST(round_even(y + h / 2.0, 0) AS INT)), chr(10) ORDER BY elem_id) AS b FROM clean GROUP BY 1),
yn AS (SELECT page_id, n_blocks, CASE WHEN multi_column THEN 'yes' ELSE 'no' END AS mc, CASE WHEN has_table THEN 'yes' ELSE 'no' END AS ht, CASE WHEN has_figure THEN 'yes' ELSE 'no' END AS hf FROM ctx),
gl AS (SELECT g.page_id, string_agg(format('{{}}. {{}}-{{}} at {{}},{{}} {{}}', rank, a.type, b.type, CAST(cx AS BIGINT), CAST(cy AS BIGINT), direction), chr(10) ORDER BY rank) AS t FROM gaps g JOIN clean a ON a.page_id = g.page_id AND a.elem_id = g.i JOIN clean b ON b.page_id = g.page_id AND b.elem_id = g.j WHERE rank <= 5 GROUP BY 1)
SELECT yn.page_id, md5(format('Image Size: 1000 x 1400 pixels' || chr(10) || 'Layout Blocks ({{}} total):' || chr(10) || '{{}}' || chr(10) || 'Multi-column layout: {{}}' || chr(10) || 'Has table: {{}}' || chr(10) || 'Has figure: {{}}', n_blocks, b, mc, ht, hf)) AS neutral, md5(coalesce(t, '')) AS gaps FROM yn JOIN l USING (page_id) LEFT JOIN gl USING (page_id)""")
def txt28(spark: SparkSession, sf: str) -> DataFrame:
    """Neutral descriptions whole; the gap lines without their widths, whose printed rounding differs between engines."""
    e = fx.clean_elements(spark, sf)
    context = planning.layout_context(e, fx.PAGE_W)
    told = pages.neutral_description(e, context, fx.PAGE_W, fx.PAGE_H).select("page_id", F.md5("description").alias("neutral"))
    gaps = pages.gap_description(planning.vulnerable_gaps(e), e)
    bare = F.regexp_replace(F.regexp_replace("description", "(?m)^  (\\d+)\\. Between (\\S+) and (\\S+): gap=\\d+px at \\((-?\\d+), (-?\\d+)\\), (\\w+)_gap$", "$1. $2-$3 at $4,$5 $6"), "\r", "")
    return told.join(gaps.select("page_id", bare.alias("g")), "page_id", "left").select("page_id", "neutral", F.md5(F.coalesce("g", F.lit(""))).alias("gaps"))


@query("img11_targets", f"""WITH {fx.CTES}, p AS (SELECT DISTINCT page_id FROM clean) SELECT page_id, CAST(floor({_u("'42'", 'CAST(page_id AS VARCHAR)', "'x'")} * 1000) AS BIGINT) AS rx, CAST(floor({_u("'42'", 'CAST(page_id AS VARCHAR)', "'y'")} * 1400) AS BIGINT) AS ry, true AS in_content, true AS in_band FROM p""")
def img11(spark: SparkSession, sf: str) -> DataFrame:
    """Random targets as they are; content and anchor targets by whether each lies in its mask."""
    from ..operators import masks
    from .damage import _content, _content_mask

    keys = ["page_id"]
    pages_ = fx.clean_elements(spark, sf).select("page_id").distinct()
    content, band = _content_mask(spark, sf), masks.outline_bands(_content(spark, sf), keys)

    def inside(mask: DataFrame, name: str) -> DataFrame:
        at = planning.sampled_targets(mask, pages_, keys, fx.PAGE_W, fx.PAGE_H)
        hit = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
        return at.join(mask, keys).groupBy(*keys).agg((F.count_if(hit) == 1).alias(name))

    rows = planning.random_targets(pages_, keys, fx.PAGE_W, fx.PAGE_H).select("page_id", F.col("x").alias("rx"), F.col("y").alias("ry"))
    return rows.join(inside(content, "in_content"), keys).join(inside(band, "in_band"), keys)


@query("plan08_phase_plans", f"""WITH {fx.CTES}, cfg(config_id, probe, target) AS (VALUES {', '.join(f"('{c}', '{p}', '{t}')" for c, p, t, _ in planning.ANCHORS)}), p AS (SELECT DISTINCT page_id FROM clean),
bp AS (SELECT a.page_id, CAST(floor((a.x + b.x) / 2.0) AS INT) AS cx, CAST(floor((a.y + b.y) / 2.0) AS INT) AS cy FROM clean a JOIN clean b ON a.page_id = b.page_id AND a.elem_id < b.elem_id QUALIFY row_number() OVER (PARTITION BY a.page_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), a.elem_id, b.elem_id) = 1)
SELECT page_id, config_id, probe, target, CASE target WHEN 'random' THEN CAST(floor({_u("'42'", 'CAST(page_id AS VARCHAR)', "'x'")} * 1000) AS INT) WHEN 'bridge' THEN coalesce(cx, 500) ELSE -1 END AS at_x,
 CASE target WHEN 'random' THEN CAST(floor({_u("'42'", 'CAST(page_id AS VARCHAR)', "'y'")} * 1400) AS INT) WHEN 'bridge' THEN coalesce(cy, 700) ELSE -1 END AS at_y FROM p CROSS JOIN cfg LEFT JOIN bp USING (page_id) WHERE NOT (page_id % 3 = 0 AND config_id = 'A05')""")
def plan08(spark: SparkSession, sf: str) -> DataFrame:
    """Every page under every anchor config but those done; places in masks are shown as -1 (img11_targets checks them)."""
    e = fx.clean_elements(spark, sf)
    all_pages = e.select("page_id").distinct()
    done = all_pages.filter("page_id % 3 = 0").withColumn("config_id", F.lit("A05"))
    rows = planning.phase_plans(all_pages, planning.anchor_configs(spark), planning.targets(e, fx.PAGE_W, fx.PAGE_H), done).withColumn("s", F.col("steps")[0])
    shown = lambda i: F.when(F.col("s.target_strategy").isin("random", "bridge"), F.col("s.target_location")[i]).otherwise(F.lit(-1))
    return rows.select("page_id", "config_id", F.col("s.probe_type").alias("probe"), F.col("s.target_strategy").alias("target"), shown(0).alias("at_x"), shown(1).alias("at_y"))


_REPORT = ["tor", "acr", "bpo", "boc", "eir", "slr_miss", "slr_topo", "b_slr", "b_slr_iou_only", "b_slr_text_only", "cer", "delta_map"]
_CONFIGS = [c for c, *_ in planning.ANCHORS] + ["NT01", "NT07"]


def report_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metric rows by integer rules: one an order, configs in turn."""
    k = F.col("o_orderkey")
    config = F.element_at(F.array(*map(F.lit, _CONFIGS)), (k % len(_CONFIGS)).cast("int") + 1)
    number = lambda i: ((k % len(_CONFIGS)) * (i * 7 + 3) % 17 + (k * (i + 2)) % 13 + 1) / 100.0
    return fx.table(spark, sf, "orders").select(config.alias("config_id"), *(number(i).alias(c) for i, c in enumerate(_REPORT)))


def _report_sql() -> str:
    n = len(_CONFIGS)
    numbers = ", ".join(f"((o_orderkey % {n}) * {i * 7 + 3} % 17 + (o_orderkey * {i + 2}) % 13 + 1) / 100.0::DOUBLE AS {c}" for i, c in enumerate(_REPORT))
    listed = ", ".join(f"'{c}'" for c in _CONFIGS)
    fits = " UNION ALL ".join(f"SELECT '{s}' AS section, '{m}' AS name, regr_r2({y}, {x})::DOUBLE AS value FROM cfg" for s, m, x, y in report.fitted_pairs())
    ranks = " UNION ALL ".join(f"SELECT '{s}', '{m}', (SELECT corr(a, b) FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS a, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2.0 AS b FROM cfg))" for s, m, x, y in report.RANKED)
    means = " UNION ALL ".join([*(f"SELECT 'overview', 'mean_{k}', avg({c}) FROM cfg" for k, c in report.CHANNELS.items()), "SELECT 'overview', 'text_share', avg(b_slr_text_only) / avg(b_slr) FROM cfg", "SELECT 'overview', 'n_configs', count(*) FROM cfg", "SELECT 'overview', 'n_rows', count(*) FROM m"])
    picks = " UNION ALL ".join([*(f"SELECT 'config', '{c}_{k}', (SELECT {c} FROM cfg WHERE config_id = '{k}')" for k in dict.fromkeys((*report.ANCHORS, *report.ENDPOINTS)) for c in ("cer", "b_slr", "tor")), *(f"SELECT 'config', 'delta_map_{k}', (SELECT delta_map FROM cfg WHERE config_id = '{k}')" for k in report.ERASURES)])
    eff = lambda c, k: f"(SELECT avg({c} / tor) FROM m WHERE config_id = '{k}')"
    ratios = " UNION ALL ".join([*(f"SELECT 'efficiency', '{c}_{k}', {eff(c, k)}" for c, k in report.EFFICIENCY), *(f"SELECT 'efficiency', 'fold_{a}_{b}', {eff('cer', a)} / {eff('cer', b)}" for a, b in report.FOLDS)])
    return f"""WITH m AS (SELECT [{listed}][CAST(o_orderkey % {n} AS INT) + 1] AS config_id, {numbers} FROM orders), cfg AS (SELECT config_id, {', '.join(f'avg({c}) AS {c}' for c in _REPORT)} FROM m GROUP BY 1),
r AS ({fits} UNION ALL {ranks} UNION ALL {means} UNION ALL {picks} UNION ALL {ratios}) SELECT section, name, round(value::DOUBLE, 6) AS value FROM r"""


@query("agg24_headline", _report_sql())
def agg24(spark: SparkSession, sf: str) -> DataFrame:
    return report.headline(report_metrics(spark, sf)).withColumn("value", F.round("value", 6))


@query("plan09_sweeps", f"""WITH s(config_id, g, param, lo, hi, is_int) AS (VALUES {', '.join(f"('{c}', '{g}', '{n}', {float(lo)}::DOUBLE, {float(hi)}::DOUBLE, {'true' if isinstance(lo, int) else 'false'})" for c, g, _, _, r in planning.SWEEPS for n, (lo, hi) in r.items())}),
p AS (SELECT o_orderkey AS page_id FROM orders), u AS (SELECT *, {_u("'42'", 'g', 'CAST(page_id AS VARCHAR)', 'param')} AS u FROM p, s)
SELECT page_id, config_id, param, round(CASE WHEN is_int THEN floor(lo + u * (hi - lo + 1)) ELSE lo + u * (hi - lo) END, 9) AS value FROM u""")
def plan09(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"))
    return planning.sample_sweeps(pages, planning.sweep_configs(spark)).withColumn("value", F.round("value", 9))


@query("plan01_05_configs", """SELECT 'anchor' AS phase, 22 AS n UNION ALL SELECT 'eir', 7 UNION ALL SELECT 'sweep', 13 UNION ALL SELECT 'global', 12 UNION ALL SELECT 'sensitivity', 8""")
def plan01(spark: SparkSession, sf: str) -> DataFrame:
    made = {"anchor": planning.anchor_configs(spark), "eir": planning.eir_configs(spark), "sweep": planning.sweep_configs(spark).select("config_id").distinct(), "global": planning.corruption_grid(spark), "sensitivity": planning.sensitivity_grid(spark)}
    out = None
    for name, df in made.items():
        row = df.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(name).alias("phase"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("plan06_greedy_cover")
def plan06(spark: SparkSession, sf: str) -> DataFrame:
    return planning.greedy_cover(fx.clean_elements(spark, sf), 0.6, 70, fx.PAGE_W, fx.PAGE_H)


@query("plan11_sensitivity", f"""WITH {fx.CTES}, t(v) AS (VALUES (0.05::DOUBLE), (0.1), (0.2), (0.3)) SELECT 'iou' AS analysis, v AS param_value, config_id, page_id, round(avg(CASE WHEN iou < v THEN 1.0::DOUBLE ELSE 0 END), 6) AS b_slr FROM best, t GROUP BY ALL""")
def plan11(spark: SparkSession, sf: str) -> DataFrame:
    grid = planning.sensitivity_grid(spark).filter("analysis = 'iou'").select("analysis", "param_value")
    rows = match_of(spark, sf).crossJoin(F.broadcast(grid))  # four thresholds on one match
    return rows.groupBy("analysis", "param_value", "config_id", "page_id").agg(F.round(F.avg((F.col("iou") < F.col("param_value")).cast("double")), 6).alias("b_slr"))


@query("plan15_area_ratio", "SELECT event_id, round(greatest(0.0002, least(0.05, value / 100 * 1400 * 1000 / (1000.0::DOUBLE * 1000))), 9) AS area_ratio FROM events")
def plan15(spark: SparkSession, sf: str) -> DataFrame:
    r = planning.area_matched_ratio(F.col("value") / 100, F.lit(1400.0), F.lit(1000.0))
    return fx.table(spark, sf, "events").select("event_id", F.round(r, 9).alias("area_ratio"))


@query("agg30_best_config", f"""WITH {fx.CTES}, l AS (SELECT page_id, config_id, avg(CASE WHEN iou < 0.1 THEN 1.0::DOUBLE ELSE 0 END) AS b FROM best GROUP BY ALL),
m AS (SELECT l.*, 0.01::DOUBLE + (page_id % 3) * 0.005 AS tor, page_id % 2 AS parser FROM l), c AS (SELECT config_id, avg(b) / avg(tor) AS score, count(DISTINCT parser) AS p FROM m GROUP BY 1)
SELECT config_id, round(score, 6) AS score FROM c WHERE p >= 2 ORDER BY score DESC, config_id LIMIT 1""")
def agg30(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.matching import block_loss

    m = block_loss(match_of(spark, sf), similar=None)
    m = m.select("config_id", (0.01 + (F.col("page_id") % 3) * 0.005).alias("tor"), "b_slr", F.lit(0.0).alias("slr_topo"), F.lit(0.0).alias("slr_miss"), (F.col("page_id") % 2).alias("parser"))
    return planning.best_config(m, "A10").withColumn("score", F.round("score", 6))


def raw_results(spark: SparkSession, sf: str) -> DataFrame:
    """Parser results of documents: one layout item a line, some without a proper box."""
    b = fx.blocks(spark, sf)
    box = F.when(F.col("pos") % 6 == 5, F.array(F.lit(1.0))).otherwise(F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))))
    item = F.struct(box.alias("bbox"), F.when(F.col("pos") % 4 == 0, F.lit(" ")).otherwise(F.lit("Text")).alias("type"), "text")
    by = b.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))).alias("s"))
    return by.select("page_id", F.lit("").alias("text"), F.transform("s", lambda s: s.item).alias("layout"), F.lit(None).cast(f"array<{parse_records.ITEM}>").alias("content_list"))


_BLOCKS = """l AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
k AS (SELECT page_id, pos, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS t, (pos - pos % 3) * 10 AS y, pos % 3 * 300 AS x, CASE WHEN pos % 4 = 0 THEN 'unknown' ELSE 'Text' END AS kind FROM l WHERE pos % 6 <> 5 AND regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, pos) AS n FROM k)"""


@query("prj10_blocks", f"WITH {_BLOCKS} SELECT page_id, 'b' || lpad(CAST(n AS VARCHAR), 4, '0') AS block_id, kind AS layout_type, md5(t) AS text_md5, CAST(n - 1 AS INT) AS reading_order FROM o")
def prj10(spark: SparkSession, sf: str) -> DataFrame:
    rows = parse_records.normalize_parse(raw_results(spark, sf)).select("page_id", F.explode("blocks").alias("b"))
    return rows.select("page_id", "b.block_id", "b.layout_type", F.md5("b.text").alias("text_md5"), "b.reading_order")


@query("prj09_parse_records", f"""WITH {_BLOCKS}, j AS (SELECT page_id, count(*) AS n, string_agg(t, chr(10) ORDER BY n) AS t FROM o GROUP BY 1)
SELECT d.doc_id AS page_id, md5(coalesce(t, '')) AS text_md5, CAST(coalesce(n, 0) AS INT) AS n_blocks, CASE WHEN n > 0 THEN 'success' ELSE 'empty' END AS parser_status FROM documents d LEFT JOIN j ON j.page_id = d.doc_id""")
def prj09(spark: SparkSession, sf: str) -> DataFrame:
    r = parse_records.normalize_parse(raw_results(spark, sf))
    return r.select("page_id", F.md5("page_text").alias("text_md5"), F.size("blocks").alias("n_blocks"), "parser_status")


@query("prj06_elements", """WITH l AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), k AS (SELECT * FROM l WHERE pos % 6 <> 5)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS id, CAST(pos % 3 * 300 + 140 AS INT) AS x, CAST((pos - pos % 3) * 10 + 12 AS INT) AS y, CAST(280 AS INT) AS w, CAST(24 AS INT) AS h, md5(substr(t, 1, 120)) AS text_md5 FROM k""")
def prj06(spark: SparkSession, sf: str) -> DataFrame:
    e = parse_records.elements(raw_results(spark, sf).withColumn("content_list", F.col("layout")))
    return e.select("page_id", F.col("id").cast("long").alias("id"), "x", "y", "w", "h", F.md5("text").alias("text_md5"))


@query("nest01_07_spans", """WITH l AS (SELECT doc_id AS page_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
SELECT page_id, CAST(count(*) AS INT) AS n_items, md5(coalesce(string_agg(t || ' ' || t, ' ' ORDER BY pos) FILTER (t <> ''), '')) AS text_md5, 2 * count(*) AS n_spans FROM l GROUP BY page_id""")
def nest01(spark: SparkSession, sf: str) -> DataFrame:
    span = F.struct(F.array(*map(F.lit, (0.0, 0.0, 10.0, 5.0))).alias("bbox"), F.col("text").alias("content"), F.lit("text").alias("type"))
    block = F.struct(F.array(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))).alias("bbox"), F.lit("text").alias("type"), F.array(F.struct(F.array(span, span).alias("spans"))).alias("lines"))
    rows = fx.blocks(spark, sf).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("s"))
    middle = rows.select("page_id", F.struct(F.array(F.struct(F.lit(0).alias("page_idx"), F.transform("s", lambda s: s.b).alias("para_blocks"))).alias("pdf_info")).alias("middle_json"))
    content = parse_records.content_of_middle(F.col("middle_json"))
    n = parse_records.spans(middle).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_spans"))
    return middle.select("page_id", F.size(content).alias("n_items"), F.md5(parse_records.full_text(content)).alias("text_md5")).join(n, "page_id", "left")


@query("geo14_span_assignment", f"""WITH {fx.CTES}, m AS (SELECT page_id, (mx1 + mx2) / 2.0 AS cx, (my1 + my2) / 2.0 AS cy, config_id FROM mask), b AS (SELECT page_id, elem_id, {_CB} FROM clean)
SELECT m.page_id, elem_id AS pos, config_id AS span FROM m JOIN b ON m.page_id = b.page_id AND cx BETWEEN x1 AND x2 AND cy BETWEEN y1 AND y2""")
def geo14(spark: SparkSession, sf: str) -> DataFrame:
    m = fx.page_configs(spark, sf).select("page_id", F.col("mx1").alias("x1"), F.col("my1").alias("y1"), F.col("mx2").alias("x2"), F.col("my2").alias("y2"), F.col("config_id").alias("text"))
    half = lambda c, s: F.col(c) / 2.0 * s
    b = fx.clean_elements(spark, sf).select("page_id", F.col("elem_id").alias("pos"), (F.col("x") + half("w", -1)).alias("x1"), (F.col("y") + half("h", -1)).alias("y1"), (F.col("x") + half("w", 1)).alias("x2"), (F.col("y") + half("h", 1)).alias("y2"))
    return parse_records.assign_spans(m, b)


@query("nest06_plans", """SELECT event_id, event_id % 3 <> 2 AS has_plan, CASE WHEN event_id % 3 <> 2 THEN 'P' || (event_id % 10 + 1) END AS probe FROM events""")
def nest06(spark: SparkSession, sf: str) -> DataFrame:
    step = F.concat(F.lit('[{"probe_type":"P'), (F.col("event_id") % 10 + 1).cast("string"), F.lit('","params":{"w":3.0},"target_strategy":"anchor"}]}'))
    js = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('```json\n{"attack_plan":'), step, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"plan":'), step)).otherwise("no plan")
    steps = parse_records.attack_plan(js)
    return fx.table(spark, sf, "events").select("event_id", (F.size(steps) > 0).alias("has_plan"), F.try_element_at(steps, F.lit(1)).probe_type.alias("probe"))


@query("nest03_json", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE -1 END AS k FROM events")
def nest03(spark: SparkSession, sf: str) -> DataFrame:
    """Answers bare, fenced, fenced with a language, and broken."""
    by = F.col("event_id") % 4
    said = F.when(by == 0, F.col("props")).when(by == 1, F.concat(F.lit("```\n"), "props", F.lit("\n```"))).when(by == 2, F.concat(F.lit(" ```JSON\n"), "props", F.lit("```  "))).otherwise(F.concat(F.lit("so: "), "props"))
    return fx.table(spark, sf, "events").select("event_id", F.coalesce(F.from_json(parse_records.strip_fences(said), "k long").k, F.lit(-1)).alias("k"))


_EV = "event_id long, user_id long, event_type string, value double"


@query("src01_03_jsonl_roundtrip", "SELECT event_id, user_id, event_type, value FROM events")
def src01(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    files.write_jsonl(fx.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), path)
    return files.read_jsonl(spark, path, _EV)


@query("src02_tolerant_jsonl", "SELECT CASE WHEN event_id % 10 = 0 THEN 'json_error' WHEN event_id % 10 = 1 THEN 'not_object' ELSE 'ok' END AS kind, count(*) AS n FROM events GROUP BY 1")
def src02(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "jsonl")
    e = fx.table(spark, sf, "events").select("event_id", F.to_json(F.struct("event_id", "user_id")).alias("value"))
    e.select(F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).when(F.col("event_id") % 10 == 1, F.lit("[1, 2]")).otherwise(F.col("value")).alias("value")).write.text(path)
    good, bad = files.read_jsonl_tolerant(spark, path, "event_id long, user_id long")
    return good.select(F.lit("ok").alias("kind")).unionByName(bad.select(F.col("error").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("src07_08_csv_roundtrip", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, CAST(NULL AS VARCHAR) AS absent FROM orders")
def src07(spark: SparkSession, sf: str) -> DataFrame:
    path, columns = scratch(spark, "csv"), ["o_orderkey", "o_orderpriority", "absent"]
    files.write_csv(fx.table(spark, sf, "orders"), path, columns)
    return files.read_csv(spark, path, columns)


@query("src16_unified_metrics", """SELECT CAST(o_orderkey AS VARCHAR) AS page_id, CASE WHEN o_orderkey % 2 = 0 THEN 'mineru' ELSE 'ppstructure' END AS pipeline, CASE WHEN o_orderkey % 3 = 0 THEN 'structural_probe' WHEN o_orderkey % 3 = 1 THEN 'large_area_erasure' ELSE '' END AS condition, CAST(o_orderkey % 7 AS DOUBLE) AS b_slr FROM orders""")
def src16(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch(spark, "metrics")
    o = fx.table(spark, sf, "orders").withColumn("config_id", F.when(F.col("o_orderkey") % 3 == 0, "A03").when(F.col("o_orderkey") % 3 == 1, "a08 ").otherwise("B1"))
    for i, (name, page, loss) in enumerate((("phase1", "page_id", "B_SLR"), ("ppstructure1", "image_id", "b-slr"))):
        part = o.filter(F.col("o_orderkey") % 2 == i).select(F.col("o_orderkey").alias(page), "config_id", (F.col("o_orderkey") % 7).alias("B-SLR" if i else "B_SLR"))
        part.write.option("header", True).csv(f"{root}/{name}")
    made = None
    for name in ("phase1", "ppstructure1"):
        rows = spark.read.option("header", True).csv(f"{root}/{name}")
        unified = files.unify_metrics(rows, F.lit(f"{name}.csv"))
        made = unified if made is None else made.unionByName(unified)
    return made.select("page_id", "pipeline", "condition", F.col("B_SLR").cast("double").alias("b_slr"))


@query("src11_coco", """SELECT o_orderkey AS image_id, CASE o_orderkey % 7 WHEN 1 THEN 'Text' WHEN 2 THEN 'Title' WHEN 3 THEN 'List' WHEN 4 THEN 'Table' WHEN 5 THEN 'Figure' WHEN 0 THEN NULL ELSE '6' END AS category, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 50)::DOUBLE * 20 END AS area FROM orders""")
def src11(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "coco")
    o = fx.table(spark, sf, "orders").withColumn("chunk", F.floor(F.col("o_orderkey") / 1000))
    image = F.struct(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".png")).alias("file_name"))
    note = F.struct(F.col("o_orderkey").alias("image_id"), (F.col("o_orderkey") % 7).cast("int").alias("category_id"), F.array(F.lit(1.0), F.lit(2.0), (F.col("o_orderkey") % 50).cast("double"), F.lit(20.0)).alias("bbox"))
    o.groupBy("chunk").agg(F.collect_list(image).alias("images"), F.collect_list(F.when(F.col("o_orderkey") % 7 != 0, note)).alias("annotations")).write.partitionBy("chunk").json(path)
    return files.layout_annotations(files.read_json_document(spark, path, files.COCO), files.PUBLAYNET).select("image_id", "category", "area")


@query("src14_listed", "SELECT 'found' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'missing', 5")
def src14(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders").select("o_orderkey")
    ids = o.filter("o_orderkey % 3 = 0").unionByName(spark.range(5).select((-1 - F.col("id")).alias("o_orderkey")))
    found, missing = files.listed(o, ids.distinct(), "o_orderkey")
    n = lambda d, k: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n")
    return n(found, "found").unionByName(n(missing, "missing"))


@query("src21_cache_misses", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 5 = 0")
def src21(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders").select("o_orderkey")
    cache = o.filter("o_orderkey % 4 <> 0").withColumn("usable", F.col("o_orderkey") % 5 != 0)
    return files.missing_from_cache(o, cache, "o_orderkey", F.col("usable"))


@query("src23_frozen_plans", "SELECT 'phase1a' AS phase, o_orderpriority AS config_id, CAST(o_orderkey AS VARCHAR) AS image_id, CAST(0 AS INT) AS step_no, 'P' || (o_orderkey % 6 + 1) AS probe FROM orders")
def src23(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders").withColumn("chunk", F.floor(F.col("o_orderkey") / 1000))
    step = F.array(F.struct(F.concat(F.lit("P"), (F.col("o_orderkey") % 6 + 1).cast("string")).alias("probe_type"), F.lit("anchor").alias("target_strategy")))
    one = o.groupBy("chunk", "o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), step))).alias("m"))
    path = scratch(spark, "plans")
    one.groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "m"))).alias("c")).select("chunk", F.create_map(F.lit("phase1a"), "c").alias("plans")).write.partitionBy("chunk").json(path)
    doc = files.read_json_document(spark, path, "plans map<string,map<string,map<string,array<struct<probe_type:string,target_strategy:string>>>>>")
    return files.frozen_plans(doc).select("phase", "config_id", "image_id", "step_no", F.col("step.probe_type").alias("probe"))


@query("st01_resume", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE (l_orderkey + l_linenumber) % 2 = 0 GROUP BY ALL")
def st01(spark: SparkSession, sf: str) -> DataFrame:
    wanted = fx.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    done = wanted.filter((F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 1)
    return files.without_done(wanted, done, ["l_orderkey", "l_linenumber"])


@query("ext08_cache_keys", "SELECT doc_id, sha256('{\"model\":\"m\",\"temperature\":0.0,\"prompt\":\"v2\",\"input\":\"' || md5(text) || '\",\"task\":\"qa\"}') AS cache_key FROM documents")
def ext08(spark: SparkSession, sf: str) -> DataFrame:
    key = external.cache_key(model=F.lit("m"), temperature=F.lit(0.0), prompt=F.lit("v2"), input=F.md5("text"), task=F.lit("qa"))
    return fx.table(spark, sf, "documents").select("doc_id", key.alias("cache_key"))


def audited_records(spark: SparkSession, sf: str) -> DataFrame:
    r = parse_records.normalize_parse(raw_results(spark, sf))
    status = F.when(F.col("page_id") % 17 == 0, "failed").when(F.col("page_id") % 23 == 0, "odd").otherwise(F.col("parser_status"))
    return r.withColumn("parser_status", status).withColumn("width", F.lit(1000)).withColumn("height", F.lit(300)).withColumn("pipeline", F.when(F.col("page_id") % 2 == 0, "mineru").otherwise("ppstructure"))


@query("dq02_parse_anomalies", f"""WITH {_BLOCKS}, a AS (SELECT d.doc_id AS p, CASE WHEN d.doc_id % 17 = 0 THEN 'failed' WHEN d.doc_id % 23 = 0 THEN 'odd' WHEN EXISTS (SELECT 1 FROM o WHERE o.page_id = d.doc_id) THEN 'success' ELSE 'empty' END AS st, (SELECT max(y) FROM o WHERE o.page_id = d.doc_id) AS y FROM documents d),
b AS (SELECT *, y IS NOT NULL AND p % 37 <> 9 AS has FROM a),
r AS (SELECT 'unknown_status' AS reason, count(*) AS n FROM b WHERE st = 'odd' UNION ALL SELECT 'empty_text', count(*) FROM b WHERE st = 'success' AND p % 19 = 3 UNION ALL SELECT 'no_blocks', count(*) FROM b WHERE st = 'success' AND p % 37 = 9
 UNION ALL SELECT 'bad_bbox', count(*) FROM b WHERE has AND p % 31 = 7 UNION ALL SELECT 'out_of_page', count(*) FROM b WHERE has AND p % 31 <> 7 AND y + 24 > 310 UNION ALL SELECT 'duplicate_block', count(*) FROM b WHERE has AND p % 29 = 5
 UNION ALL SELECT 'unrelated_text', count(*) FROM b WHERE st = 'success' AND p % 19 <> 3 AND (p % 41 = 11 OR p % 37 = 9))
SELECT * FROM r WHERE n > 0""")
def dq02(spark: SparkSession, sf: str) -> DataFrame:
    """Parse records with faults of every kind planted by page number."""
    p = F.col("page_id")
    upside_down = F.transform("blocks", lambda b: b.withField("bbox", F.array(*map(F.lit, (9.0, 9.0, 1.0, 1.0)))))
    blocks = F.when(p % 37 == 9, F.slice("blocks", 1, 0)).when(p % 31 == 7, upside_down).otherwise(F.col("blocks"))
    rows = audited_records(spark, sf).withColumn("blocks", blocks).withColumn("blocks", F.when(p % 29 == 5, F.concat("blocks", F.slice("blocks", 1, 1))).otherwise(F.col("blocks")))
    rows = rows.withColumn("page_text", F.when(p % 19 == 3, "").when(p % 41 == 11, "zzz qqq").otherwise(F.col("page_text")))
    found = audits.anomalies(rows, ["page_id", "pipeline"], audits.parse_checks())
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("dq03_readiness", f"""WITH {_BLOCKS}, j AS (SELECT page_id, count(*) AS n, sum(length(t)) + count(*) - 1 AS chars FROM o GROUP BY 1),
a AS (SELECT doc_id AS p, CASE WHEN doc_id % 2 = 0 THEN 'mineru' ELSE 'ppstructure' END AS pipeline, CASE WHEN doc_id % 17 = 0 THEN 'failed' WHEN doc_id % 23 = 0 THEN 'odd' WHEN n > 0 THEN 'success' ELSE 'empty' END AS st, coalesce(n, 0) AS n, coalesce(chars, 0) AS chars FROM documents d LEFT JOIN j ON j.page_id = doc_id),
per AS (SELECT pipeline, count(*) AS rows, count(*) FILTER (st = 'success') AS success, count(*) FILTER (st = 'empty') AS empty, count(*) FILTER (st = 'failed') AS failed, count(*) FILTER (chars = 0) AS empty_text, coalesce(avg(chars) FILTER (st IN ('success', 'empty')), 0) AS mean_chars, coalesce(median(n) FILTER (st IN ('success', 'empty')), 0)::DOUBLE AS median_blocks, CAST(0 AS BIGINT) AS duplicates FROM a GROUP BY 1),
b AS (SELECT CAST(0 AS BIGINT) AS both_success, count(*) FILTER (st = 'success' AND pipeline = 'mineru') AS only_a, count(*) FILTER (st = 'success' AND pipeline <> 'mineru') AS only_b, count(*) FILTER (st <> 'success') AS both_failed FROM a)
SELECT per.* EXCLUDE (mean_chars), round(mean_chars, 6) AS mean_chars, b.*, 'both_success_pages;both_non_empty_text_pages' || CASE WHEN mean_chars < 100 THEN ';average_page_text_length' ELSE '' END AS reasons, false AS ready FROM per, b""")
def dq03(spark: SparkSession, sf: str) -> DataFrame:
    r = audited_records(spark, sf)
    audit = audits.parse_audit(r, ["pipeline"])
    both = audits.pipeline_overlap(r.filter("pipeline = 'mineru'"), r.filter("pipeline = 'ppstructure'"))
    rows = audit.crossJoin(F.broadcast(both))  # one row
    ready = audits.ready_for_qa(rows, F.col("both_success"), F.col("both_success"), F.lit(0))
    return ready.withColumn("reasons", F.array_join("reasons", ";")).withColumn("mean_chars", F.round("mean_chars", 6))


@query("join14_pipeline_overlap", """WITH d AS (SELECT doc_id, doc_id % 3 <> 0 AS a, doc_id % 4 <> 0 AS b FROM documents)
SELECT count(*) FILTER (a AND b) AS both_success, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS both_failed FROM d""")
def join14(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"))
    mark = lambda k: d.withColumn("parser_status", F.when(F.col("page_id") % k != 0, "success").otherwise("failed"))
    return audits.pipeline_overlap(mark(3), mark(4))


_COND = ("structural_probe", "area_matched_erasure", "large_area_erasure")


@query("dq07_perturbation_gates", "SELECT true AS rows_structural_probe, true AS rows_area_matched_erasure, true AS rows_large_area_erasure, true AS \"unique\", true AS known_conditions, false AS tor_matches, true AS areas_matched, true AS large_area, false AS ready")
def dq07(spark: SparkSession, sf: str) -> DataFrame:
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"))
    n = d.count()
    m = d.select("page_id", F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.lit(t).alias("tor")) for c, t in zip(_COND, (0.02, 0.021, 0.2), strict=True)])).alias("c")).select("page_id", "c.*")
    m = m.select("*", F.when((F.col("page_id") == 3), 1.0).otherwise(F.round(F.col("tor") * 1_000_000)).cast("long").alias("mask_area"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    return audits.perturbation_audit(m, n, _COND)


@query("dq01_manifest", "SELECT count(*) FILTER (coalesce(trim(url), '') = '') AS missing_url, count(*) FILTER (html IS NULL) AS missing_html, count(*) - count(DISTINCT page_id) AS duplicate_pages FROM pages")
def dq01(spark: SparkSession, sf: str) -> DataFrame:
    return audits.manifest_faults(fx.table(spark, sf, "pages"), ["url", "html"])


@query("stat09_tor_mismatch", "SELECT event_id, CASE WHEN value IS NULL THEN true WHEN abs(value / 100 - floor(value * 10000) / 1000000.0) <= 1e-5 THEN false ELSE coalesce(abs(value / 100 - floor(value * 10000) / 1000000.0) / nullif(floor(value * 10000) / 1000000.0, 0) > 0.01, true) END AS mismatch FROM events")
def stat09(spark: SparkSession, sf: str) -> DataFrame:
    area = F.floor(F.col("value") * 10000)
    return fx.table(spark, sf, "events").select("event_id", audits.tor_mismatch(F.col("value") / 100, area, F.lit(1000), F.lit(1000)).alias("mismatch"))


@query("img12_run_plans")
def img12(spark: SparkSession, sf: str) -> DataFrame:
    """One anchor config for every page, in turn, at the place its strategy finds, on synthetic pages at a tenth of their size."""
    turn = F.concat(F.lit("A"), F.lpad((F.col("page_id") % 22 + 1).cast("string"), 2, "0"))
    plans = planning.anchor_configs(spark).select("config_id", "probe_type", "params", "target_strategy")
    pages_ = fx.page_boxes(spark, sf).withColumn("config_id", turn).join(F.broadcast(plans), "config_id")  # the 22 literal configs
    rows = placing.with_targets(pages_, fx.PAGE_W, fx.PAGE_H)
    step = F.struct("probe_type", "params", F.array(F.floor(F.col("x") / 10).cast("int"), F.floor(F.col("y") / 10).cast("int")).alias("target_location"))
    corner = lambda b: F.array(*(((b[c] + b[s] * sign / 2.0) / 10).cast("double") for c, s, sign in (("x", "w", -1), ("y", "h", -1), ("x", "w", 1), ("y", "h", 1))))
    rows = rows.select("page_id", "config_id", F.transform("boxes", corner).alias("boxes"), F.array(step).alias("steps"))
    return raster.run_plans(rows, (fx.PAGE_H // 10, fx.PAGE_W // 10))


@query("plan22_routes", "SELECT CASE WHEN doc_id % 11 = 0 THEN 'parser_empty' WHEN doc_id % 7 = 0 THEN 'skip' WHEN length(text) > 8000 THEN 'context_too_long' ELSE 'api' END AS route, count(*) AS n FROM documents GROUP BY 1")
def plan22(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("doc_id") % 11 == 0, "empty").otherwise("success")
    route = external.answer_route(status, F.col("text"), F.col("doc_id") % 7 == 0)
    return fx.table(spark, sf, "documents").groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


@query("txt19_21_sources", f"""WITH p AS ({LINES_SQL}), n AS (SELECT d.doc_id, d.text, l, {sql_norm("replace(d.text, 'e', 'e ')")} AS np FROM documents d JOIN p USING (doc_id)),
s AS (SELECT doc_id, text, array_to_string((list_filter(l, lambda s: len({sql_tokens(sql_norm('s'))}) <= 35 AND contains(np, {sql_norm('s')})))[1:60], chr(10)) AS shared FROM n)
SELECT doc_id, CASE WHEN length(shared) >= 800 THEN 'shared' WHEN length(replace(text, 'e', 'e ')) <= length(text) * 1.1::DOUBLE THEN 'mineru' ELSE 'ppstructure' END AS source, CAST(length(shared) AS INT) AS n_shared FROM s""")
def txt21(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import qa

    d = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("m"), F.regexp_replace("text", "e", "e ").alias("p"))
    chosen = qa.source_of(d, "m", "p")
    return chosen.select("doc_id", "source", F.length("shared").alias("n_shared"))
