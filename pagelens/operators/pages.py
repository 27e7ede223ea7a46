"""Page sets and small page records: phases, filters, guards, manifests, backfill, request payloads, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_answer, normalize_answer
from .audits import manifest_faults
from .sampling import dedupe_candidates, hash_order, quotas, stratified_sample

CONTEXT_CHARS, KEPT_A_PAGE = 8000, 4
#: The share of each complexity level in a manifest.
LEVEL_SHARES = {"simple": 0.145, "medium": 0.464, "complex": 0.391}


def should_run(phases: set[str], key: str) -> bool:
    return "all" in phases or key in phases


def phase_rows(df: DataFrame, phases: set[str], column: str = "phase") -> DataFrame:
    """Rows whose phase is selected; ``all`` selects every one, an empty set none."""
    return df if "all" in phases else df.filter(F.col(column).isin(*phases)) if phases else df.limit(0)


def of_source(pages: DataFrame, source: str | None) -> DataFrame:
    return pages if not source else pages.filter(F.col("data_source").eqNullSafe(source))


def of_categories(pages: DataFrame, categories: set[str], source: str = "doclaynet") -> DataFrame:
    """Drops pages of ``source`` outside the categories; pages of other or no source pass."""
    if not categories:
        return pages
    return pages.filter(~F.col("data_source").eqNullSafe(source) | F.coalesce(F.col("doc_category").isin(*categories), F.lit(False)))


def without_empty_baseline(pages: DataFrame, baseline: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages but those whose baseline (``spans``, ``elements`` arrays) has no span or no element; pages without a baseline stay."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return pages.join(baseline.filter(none("spans") | none("elements")).select(key), key, "left_anti")


def guarded(rows: DataFrame, clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metric rows of pages with clean elements, one warning a page for the others)."""
    known = clean.select("page_id").distinct()
    return rows.join(known, "page_id", "left_semi"), rows.join(known, "page_id", "left_anti").select("page_id", F.lit("empty clean baseline").alias("warning")).dropDuplicates(["page_id"])


def baseline_gate(baseline: DataFrame, most: float = 0.02) -> DataFrame:
    """One row: pages, pages without elements, and whether their share is within the limit."""
    empty = F.count_if(F.coalesce(F.size("elements"), F.lit(0)) <= 0)
    total = F.count(F.lit(1))
    return baseline.agg(total.alias("pages"), empty.alias("empty"), (F.coalesce(F.try_divide(empty.cast("double"), total.cast("double")), F.lit(0.0)) <= most).alias("ok"))


def doc_and_page(stem: Column) -> tuple[Column, Column]:
    """Document and page number of a file stem ``name_12``; both unknown where it has none."""
    whole, page = F.regexp_extract(stem, "^(.*)_([0-9]+)$", 1), F.regexp_extract(stem, "^(.*)_([0-9]+)$", 2)
    known = page != ""
    return F.when(known, whole).otherwise("unknown"), F.when(known, F.coalesce(F.nullif(F.ltrim(page, F.lit("0")), F.lit("")), F.lit("0"))).otherwise("unknown")


def build_manifest(candidates: DataFrame, fault: Column, n: int, debug: int, seed: str, shares: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest of ``n`` pages in the levels' shares, a debug set drawn from it): sound candidates, the first of each page and image."""
    sound = dedupe_candidates(candidates, "page_id", "image_path", "pos", fault)
    full = stratified_sample(sound, "page_id", "complexity", n, shares or LEVEL_SHARES, seed)
    return full, stratified_sample(full, "page_id", "complexity", debug, shares or LEVEL_SHARES, f"{seed}+1")


def manifest_or_debug(full: DataFrame, debug: DataFrame, use_debug: bool, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the chosen manifest, its faults)."""
    chosen = debug if use_debug else full
    return chosen, manifest_faults(chosen, required)


def backfill(kept: DataFrame, pool: DataFrame, level: str, n: int, shares: dict[str, float], seed: str, key: str = "page_id") -> DataFrame:
    """``n`` pages by level: kept ones trimmed to each level's target, open places filled from the pool's level, then from anything left.

    ``pool`` holds sound pages only, so one pass replaces rounds of drawing
    and checking. Kept pages come before new ones, each by hash of (seed, key).
    """
    rows = kept.withColumn("_new", F.lit(0)).unionByName(pool.join(kept.select(key), key, "left_anti").withColumn("_new", F.lit(1)))
    quota = quotas(n, shares)
    ranked = rows.withColumn("_h", F.concat(F.col("_new").cast("string"), hash_order(seed, key)))
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(level)), F.lit(0))
    ranked = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(level).orderBy("_h", key))).withColumn("_in", (F.col("_r") <= limit).cast("int"))
    return ranked.orderBy(F.desc("_in"), "_h", key).limit(n).select(*kept.columns)


def question_payload(questions: DataFrame, pages: DataFrame, most: int = CONTEXT_CHARS) -> DataFrame:
    """(page_id, payload): the request of a page as JSON, its questions in order and its text cut to the context limit (a limit of the request)."""
    asked = questions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("qa_id", "question"))).alias("questions"))
    rows = asked.join(pages.select("page_id", F.substring(F.coalesce("page_text", F.lit("")), 1, most).alias("page_text")), "page_id", "left")
    return rows.select("page_id", F.to_json(F.struct(F.coalesce("page_text", F.lit("")).alias("page_text"), "questions")).alias("payload"))


def plan_columns(steps: Column) -> dict[str, Column]:
    """The plan as JSON, its probes and targets joined by ``;``, and whether any step fell back."""
    return {
        "plan_json": F.to_json(steps), "probe_types": F.array_join(F.transform(steps, lambda s: s.probe_type), ";"),
        "target_strategies": F.array_join(F.transform(steps, lambda s: s.target_strategy), ";"), "target_fallback": F.exists(steps, lambda s: s.target_location.isNull()),
    }


def item_faults(items: Column, source: Column) -> Column:
    """Reasons against generated items (question, answer, evidence): missing parts, and answers or evidence the source lacks."""
    normal = normalize_answer(source)

    def why(i: Column) -> Column:
        gone = lambda c: F.trim(F.coalesce(i[c], F.lit(""))) == ""
        lacks = lambda c: ~gone(c) & ~contains_answer(normal, normalize_answer(i[c]))
        return F.array_compact(F.array(*[F.when(gone(c), F.lit(f"missing_{c}")) for c in ("question", "answer", "evidence")], *[F.when(lacks(c), F.lit(f"{c}_not_in_source")) for c in ("answer", "evidence")]))

    return F.flatten(F.transform(items, why))


def estimated_kept(answers: Column, sound: Column) -> Column:
    """How many candidates of a page would be kept: different normalised answers among the sound ones, four at most."""
    kept = F.array_distinct(F.transform(F.filter(F.arrays_zip(answers.alias("a"), sound.alias("ok")), lambda x: x.ok), lambda x: normalize_answer(x.a)))
    return F.least(F.lit(KEPT_A_PAGE), F.size(F.filter(kept, lambda a: a != "")))


def with_fields(rows: DataFrame, column: str, fields: dict[str, Column]) -> DataFrame:
    """The struct ``column`` with fields added or replaced."""
    updated = F.col(column)
    for name, value in fields.items():
        updated = updated.withField(name, value)
    return rows.withColumn(column, updated)


def annotations_of(blocks: Column, width: Column, height: Column) -> Column:
    """Blocks as annotations: rounded boxes clipped to the page, types capitalised by word, empty boxes left out."""
    def one(b: Column) -> Column:
        low = lambda i: F.greatest(F.lit(0), F.bround(b.bbox[i]).cast("int"))
        high = lambda i, top: F.least(top.cast("int"), F.bround(b.bbox[i]).cast("int"))
        return F.struct(F.array(low(0), low(1), high(2, width), high(3, height)).alias("bbox"), F.initcap(b.layout_type).alias("category"))

    return F.filter(F.transform(blocks, one), lambda a: (a.bbox[2] > a.bbox[0]) & (a.bbox[3] > a.bbox[1]))


def _yes(c: str) -> Column:
    return F.when(F.col(c), "yes").otherwise("no")


def neutral_description(elements: DataFrame, context: DataFrame, page_w: int, page_h: int) -> DataFrame:
    """(page_id, description): size, blocks in order with their corner boxes, columns, table, figure; no hint at gaps."""
    corner = lambda c, s, sign: F.bround(F.col(c) + F.col(s) * sign / 2.0).cast("int")
    line = F.format_string("  Block %d: %s [%d, %d, %d, %d]", F.col("elem_id"), "type", corner("x", "w", -1), corner("y", "h", -1), corner("x", "w", 1), corner("y", "h", 1))
    lines = elements.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("elem_id", line.alias("line")))).alias("b"))
    rows = context.join(lines, "page_id")
    # The words of the description.
    head = F.format_string(f"Image Size: {page_w} x {page_h} pixels\nLayout Blocks (%d total):", F.col("n_blocks"))
    tail = F.format_string("Multi-column layout: %s\nHas table: %s\nHas figure: %s", _yes("multi_column"), _yes("has_table"), _yes("has_figure"))
    return rows.select("page_id", F.concat_ws("\n", head, F.array_join(F.transform("b", lambda b: b.line), "\n"), tail).alias("description"))


def gap_description(gaps: DataFrame, elements: DataFrame, most: int = 5) -> DataFrame:
    """(page_id, description): a page's narrowest gaps with the types of the blocks beside them."""
    kind = lambda k: elements.select("page_id", F.col("elem_id").alias(k), F.col("type").alias(f"type_{k}"))
    rows = gaps.filter(F.col("rank") <= most).join(kind("i"), ["page_id", "i"]).join(kind("j"), ["page_id", "j"])
    line = F.format_string("  %d. Between %s and %s: gap=%.0fpx at (%d, %d), %s", F.col("rank"), "type_i", "type_j", F.col("width").cast("double"), F.col("cx").cast("long"), F.col("cy").cast("long"), F.concat("direction", F.lit("_gap")))
    listed = rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("g"))
    return listed.select("page_id", F.array_join(F.transform("g", lambda g: g.line), "\n").alias("description"))
