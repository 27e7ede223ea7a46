"""Operators against small models of their rules."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.operators import detection, evaluation, external, masks, matching, parse_records, placing, planning, qa, raster, report, retrieval, stats
from pagelens.operators import pages as page_sets
from pagelens.sources import files

EL = "page_id long, elem_id long, x long, y long, w long, h long, type string, text string"
AD = "page_id long, config_id string, adv_id long, x long, y long, w long, h long, type string, text string"


@pytest.fixture(scope="module")
def pages(spark):
    clean = spark.createDataFrame([(1, 0, 50, 50, 20, 20, "text", "alpha"), (1, 1, 50, 52, 20, 20, "text", "omega"), (1, 2, 200, 200, 20, 20, "title", "gone"), (2, 0, 10, 10, 10, 10, "text", "half")], EL)
    adv = spark.createDataFrame([(1, "C", 0, 50, 51, 20, 20, "table", "alphx"), (1, "C", 1, 50, 51, 20, 20, "text", "alpha")], AD)
    grid = spark.createDataFrame([(1, "C", 190, 190, 215, 215), (2, "C", 0, 0, 15, 10)], "page_id long, config_id string, mx1 long, my1 long, mx2 long, my2 long")
    return clean, adv, grid


def test_matching_rules(pages):
    clean, adv, grid = pages
    m = matching.with_similarity(matching.best_match(clean, adv, grid)).cache()
    best = {(r.page_id, r.elem_id): (r.adv_id, round(r.iou, 3)) for r in m.collect()}
    assert best[(1, 0)][0] == 0 and best[(1, 1)][0] == 0 and best[(1, 2)] == (-1, 0.0) and best[(2, 0)] == (-1, 0.0)
    loss = {r.page_id: r.b_slr for r in matching.block_loss(m).collect()}
    assert loss == {1: 2 / 3, 2: 1.0}
    d = {r.page_id: r for r in matching.decomposed_loss(m, grid).collect()}
    assert (d[1].n_merge, d[1].n_miss, d[1].n_degraded, d[1].n_intact) == (1, 1, 0, 1) and d[2].slr_miss == 1.0
    assert all(abs(r.b_slr - r.slr_miss - r.slr_topo) < 1e-12 and abs(r.b_slr - loss[p]) < 1e-12 for p, r in d.items())
    t = {r.page_id: r for r in matching.text_ablation(m).collect()}
    assert (t[2].text_sim_mean, t[2].cer_mean, t[2].n_matched) == (0.0, 1.0, 1) and t[1].n_matched == 3
    greedy = {r.page_id: r.delta_cer for r in matching.greedy_cer(clean, adv, grid).collect()}
    assert greedy[2] == 1.0 and abs(greedy[1] - (0.2 + 4 / 5 + 1) / 3) < 1e-9


def test_average_precision(spark, pages):
    clean, adv, grid = pages
    perfect = clean.join(grid.select("page_id", "config_id"), "page_id").withColumn("adv_id", F.col("elem_id")).withColumn("score", F.lit(1.0))
    assert {r.map for r in detection.page_map(clean, perfect, grid).collect()} == {1.0}
    none = {r.page_id: r.map for r in detection.page_map(clean, adv.withColumn("score", F.lit(1.0)), grid).collect()}
    assert none[2] == 0.0 and 0 < none[1] < 1
    extra = grid.unionByName(spark.createDataFrame([(9, "C", 0, 0, 1, 1)], grid.schema))
    assert {r.page_id: r.map for r in detection.page_map(clean, perfect, extra).collect()}[9] == 1.0


def test_mask_runs_equal_painting(spark):
    rng = np.random.default_rng(3)
    boxes = [(int(p), *map(int, b)) for p in range(5) for b in np.sort(rng.integers(-5, 45, (6, 2, 2)), 1).reshape(6, 4)]
    rows = spark.createDataFrame(boxes, "page_id int, x1 int, y1 int, x2 int, y2 int")
    def painted(rects):
        image = np.zeros((5, 40, 40), int)
        for p, x1, y1, x2, y2 in rects:
            image[p, max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)] += 1
        return image

    runs = masks.union(masks.clipped(rows, ["page_id"], 40, 40), ["page_id"])
    want = painted(boxes) > 0
    assert {r.page_id: r.pixels for r in masks.pixels(runs, ["page_id"]).collect()} == {p: w.sum() for p, w in enumerate(want)}
    assert (painted([(r.page_id, r.x0, r.y0, r.x1, r.y1) for r in runs.collect()]) == want).all()
    band = masks.outline_bands(rows, ["page_id"], 3, 40, 40)
    ring = (painted([(p, a - 3, b - 3, c + 3, d + 3) for p, a, b, c, d in boxes]) > 0) & ~(painted([(p, a + 3, b + 3, c - 3, d - 3) for p, a, b, c, d in boxes if a + 3 < c - 3 and b + 3 < d - 3]) > 0)
    assert (painted([(r.page_id, r.x0, r.y0, r.x1, r.y1) for r in band.collect()]) == ring).all()
    for mask, name in ((want, runs), (ring, band)):
        spots = planning.sampled_targets(name, rows.select("page_id").distinct(), ["page_id"], 40, 40).collect()
        assert len(spots) == 5 and all(mask[s.page_id, s.y, s.x] for s in spots)


def test_statistics_edges(spark):
    df = spark.createDataFrame([("c", 1.0, 5.0), ("c", 2.0, 5.0), ("c", 3.0, 5.0), ("two", 1.0, 2.0), ("two", 2.0, 1.0), ("n", float("nan"), 1.0)], "g string, x double, y double")
    assert {r.g: r.r for r in stats.pearson(df, "x", "y", ["g"]).collect()} == {"c": None, "two": pytest.approx(-1.0)}
    assert {r.g: r.r2 for r in stats.r_squared(df, "x", "y", ["g"]).collect()} == {"c": 0.0, "two": None}
    ranks = stats.average_rank(spark.createDataFrame([(1,), (2,), (2,), (3,)], "v int"), "v", [], "r").collect()
    assert sorted(r.r for r in ranks) == [1.0, 2.5, 2.5, 4.0]


def chunks_by_hand(texts, least=200, limit=700, most=700, step=620):
    """Lengths and block numbers, deciding for every block in turn whether it still fits."""
    out, open_ = [], []
    for i, t in enumerate([*texts, None]):
        size = sum(n + 1 for n, _ in open_)
        if open_ and (t is None or len(t) > most or (t and size >= least and size + len(t) + 1 > limit)):
            out.append((size - 1, [k for _, k in open_]))
            open_ = []
        if t and len(t) > most:
            at = [0]
            while at[-1] + most < len(t):
                at.append(at[-1] + step)
            out += [(min(most, len(t) - a), [i]) for a in at]
        elif t:
            open_.append((len(t), i))
            if sum(n + 1 for n, _ in open_) >= limit:
                out.append((sum(n + 1 for n, _ in open_) - 1, [k for _, k in open_]))
                open_ = []
    return out


def test_chunk_fold():
    assert [len(t) for t, _ in retrieval.fold_blocks(["x" * 701])] == [700, 81]
    rng = np.random.default_rng(6)
    for _ in range(400):
        texts = ["x" * int(n) for n in rng.choice([0, 1, 40, 180, 199, 200, 350, 500, 699, 700, 701, 1500], rng.integers(0, 12))]
        assert [(len(t), n) for t, n in retrieval.fold_blocks(texts)] == chunks_by_hand(texts)
    made = retrieval.fold_blocks(["a" * 300, "", "b" * 300, "c" * 300], target=400, least=200)
    assert [n for _, n in made] == [[0], [2], [3]] and retrieval.fold_blocks([]) == [] and retrieval.fold_blocks([" "]) == []


def test_ranking_metrics(spark):
    hits = spark.createDataFrame([("q", 1, 1), ("q", 2, 1), ("z", 1, 0)], "qa_id string, rank int, hit int")
    m = {r.qa_id: r for r in retrieval.ranking_metrics(hits, spark.createDataFrame([("q",), ("z",), ("none",)], "qa_id string"), "hit").collect()}
    assert m["q"].ndcg == pytest.approx(1 + 1 / np.log2(3)) and m["q"].precision_5 == 0.4 and m["none"].recall_10 == 0 and m["z"].mrr == 0.0


def test_sequential_dedupe(spark):
    rows = [(1, 0, "q1", "a1"), (1, 1, "q1", "a2"), (1, 2, "q2", "a2"), (1, 3, "q3", "a1"), (2, 0, "q1", "a1")]
    got = qa.accept_in_order(spark.createDataFrame(rows, "page_id long, pos int, question string, answer string")).collect()
    assert sorted((r.page_id, r.pos, r.qa_id) for r in got) == [(1, 0, "1_q001"), (1, 2, "1_q002"), (2, 0, "2_q001")]


def test_cover_steps():
    boxes = np.asarray([(x, 50, 10, 10) for x in (100, 120, 140, 300)])
    assert planning.cover_steps(boxes, 0, 30, 30, 400, 400) == [] and planning.cover_steps(boxes[:0], 1, 30, 30, 400, 400) == []
    assert planning.cover_steps(boxes, 1.0, 30, 30, 400, 400) == [(120, 50, 3), (300, 50, 1)]
    # Centres keep the radius from the border: the block in the corner is probed from (30, 30).
    assert planning.cover_steps(np.asarray([(0, 0, 70, 70), (200, 200, 4, 4)]), 1.0, 30, 30, 400, 400) == [(30, 30, 1), (200, 200, 1)]


def cover_by_hand(blocks, share, r, most, page_w, page_h):
    """Set cover pixel by rule: try every centre each time, count by loops."""
    def near(cx, cy, b):
        nx, ny = max(b[0] - b[2] // 2, min(cx, b[0] + b[2] // 2)), max(b[1] - b[3] // 2, min(cy, b[1] + b[3] // 2))
        return ((cx - nx) ** 2 + (cy - ny) ** 2) ** 0.5 < r

    centres = [(max(r, min(b[0], page_w - r)), max(r, min(b[1], page_h - r))) for b in blocks]
    covered, steps = set(), []
    while blocks and share > 0 and len(covered) < max(1, round(len(blocks) * share)) and len(steps) < most:
        new = [{i for i, b in enumerate(blocks) if near(*c, b)} - covered for c in centres]
        best = max(range(len(new)), key=lambda i: (len(new[i]), -i))
        if not new[best]:
            break
        covered |= new[best]
        steps.append((*centres[best], len(new[best])))
    return steps


def test_cover_steps_equal_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = int(rng.integers(0, 15))
        blocks = [tuple(map(int, b)) for b in np.stack([rng.integers(-20, 420, n), rng.integers(-20, 320, n), rng.integers(1, 90, n), rng.integers(1, 90, n)], 1)]
        share, r = float(rng.choice([0, 0.3, 0.6, 1.0])), int(rng.choice([20, 70, 180]))
        assert planning.cover_steps(np.asarray(blocks, np.int64).reshape(-1, 4), share, r, 5, 400, 300) == cover_by_hand(blocks, share, r, 5, 400, 300)


def test_canonical_labels(spark):
    rows = spark.createDataFrame([("Page-header",), ("weird",), ("TABLE",), ("Formula",), (None,)], "l string").select(detection.canonical_label(F.col("l")).alias("c")).collect()
    assert [r.c for r in rows] == [None, "text", "table", "equation", "text"]


def test_parse_records(spark):
    raw = spark.createDataFrame([("p", None, [([5.0, 20.0, 9.0, 30.0], "Text", " low "), ([1.0, 2.0, 9.0, 9.0], None, "top"), ([9.0, 9.0, 1.0, 1.0], "x", "bad"), ([1.0, 2.0, 3.0, 4.0], "x", " ")], None), ("q", None, None, None)], f"page_id string, text string, layout array<{parse_records.ITEM}>, content_list array<{parse_records.ITEM}>")
    got = {r.page_id: r for r in parse_records.normalize_parse(raw).collect()}
    assert [(b.block_id, b.layout_type, b.text) for b in got["p"].blocks] == [("b0001", "unknown", "top"), ("b0002", "Text", "low")]
    assert (got["p"].page_text, got["p"].parser_status, got["q"].parser_status) == ("top\nlow", "success", "empty")


def test_sources(spark, tmp_path):
    assert files.read_jsonl(spark, f"{tmp_path}/none", "a int").count() == 0
    good, bad = files.read_jsonl_tolerant(spark, f"{tmp_path}/none", "a int")
    assert good.count() == 0 and [r.error for r in bad.collect()] == ["missing_jsonl"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{oops\n[1]\n{"a": 2}\n')
    good, bad = files.read_jsonl_tolerant(spark, f"{tmp_path}/x.jsonl", "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and sorted(r.error for r in bad.collect()) == ["json_error", "not_object"]
    assert [(r.line_no, r.value) for r in files.numbered_lines(spark, f"{tmp_path}/x.jsonl").orderBy("line_no").collect()][2] == (3, "{oops")
    (tmp_path / "phase_ppstructure.csv").write_text("image_id,b_slr,TOR,odd\n7,0.5,0.25,z\n")
    (tmp_path / "other.csv").write_text("page_id\n1\n")
    rows = files.load_metrics(spark, [str(tmp_path)]).collect()
    assert [(r.page_id, r.pipeline, r.B_SLR_per_TOR, r.source_file) for r in rows] == [("7", "ppstructure", "2.0", "phase_ppstructure.csv")]
    assert files.read_yaml("") == {} and files.load_metrics(spark, [f"{tmp_path}/gone"]).count() == 0


def test_raster():
    shape, image = (60, 80), np.full((60, 80, 3), 200, np.uint8)
    out, mask = raster.apply_step(image, "P4", {"area_ratio": 0.25, "beta": 1.0}, (40, 30), raster.rng_of(1))
    assert mask.sum() == 900 and (out[mask] == 255).all() and (out[~mask] == 200).all()
    line = raster.line_mask(shape, (40, 30), 0, 1.0, 3)
    assert 3 * 78 <= line.sum() <= 3 * 80 and abs(raster.disk_mask(shape, (40, 30), 20, 20).sum() - np.pi * 400) < 60
    blob = raster.blob_mask(shape, (40, 30), 20, 0.0, raster.rng_of(2))
    assert abs(blob.sum() - np.pi * 400) < 80
    grey = image.mean(-1)
    assert raster.ssim(grey, grey) == pytest.approx(1.0) and raster.ssim(grey, out.mean(-1)) < 1
    assert raster.difference_mask(image, image).all() and (raster.difference_mask(image, out) == mask).all()
    content = raster.content_mask([(10, 10, 40, 40)], shape)
    anchor = raster.anchor_mask([(10, 10, 40, 40)], shape, 3)
    assert content.sum() == 900 and anchor[10, 20] and not anchor[25, 25] and not (raster.background_mask(content, anchor) & content).any()
    assert (raster.corrupt(image, "gaussian_blur", 5, raster.rng_of(1)) == image).all()
    rough = np.random.default_rng(2).integers(0, 256, (45, 61, 3)).astype(np.uint8)
    loss = [np.abs(raster.corrupt(rough, "jpeg_compression", q, raster.rng_of(1)).astype(int) - rough).mean() for q in (95, 70, 25)]
    assert loss[0] < loss[1] < loss[2] and (raster.corrupt(image, "jpeg_compression", 70, raster.rng_of(1)) == image).all()
    with pytest.raises(ValueError):
        raster.corrupt(image, "odd", 1, raster.rng_of(1))


def test_external_boundary(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page_id long")

    def load():
        def call(row):
            if row["page_id"] == 2:
                raise ValueError("no")
            return {"page_text": "ok"}

        return call

    got = {r.page_id: (r.parser_status, r.error_message) for r in external.run_adapter(pages, "t", load, "page_text string, page_id long").collect()}
    assert got == {1: ("success", ""), 2: ("failed", "no")}
    requests = spark.createDataFrame([("a",), ("b",), ("b",)], "key string")
    cache = spark.createDataFrame([("a", "old")], "key string, response string")
    answers, fresh = external.call_or_cache(requests, cache, "key", lambda m: m.withColumn("response", F.lit("new")))
    assert sorted((r.key, r.response) for r in answers.collect()) == [("a", "old"), ("b", "new"), ("b", "new")] and fresh.count() == 1
    log = spark.createDataFrame([("k", "x")], "api_key string, event string")
    assert external.redacted(log).columns == ["event", "logged_at"]


def overlap(a, b):
    x1, y1, x2, y2 = (max(a[0] - a[2] / 2, b[0] - b[2] / 2), max(a[1] - a[3] / 2, b[1] - b[3] / 2), min(a[0] + a[2] / 2, b[0] + b[2] / 2), min(a[1] + a[3] / 2, b[1] + b[3] / 2))
    inter = max(0, x2 - x1) * max(0, y2 - y1)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter)


def edits(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
    return d[len(a), len(b)]


def common(a, b):
    d = {}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = d.get((i - 1, j - 1), 0) + 1 if a[i] == b[j] else max(d.get((i - 1, j), 0), d.get((i, j - 1), 0))
    return d.get((len(a) - 1, len(b) - 1), 0)


def test_losses_equal_brute_force(spark):
    """Every loss of random pages, element by element, against plain loops over the rules."""
    rng = np.random.default_rng(12)
    words = ["", " ", "alpha", "alphx", "Beta two", "beta", "gamma ray"]
    box = lambda: tuple(map(int, (rng.integers(20, 140), rng.integers(20, 140), rng.integers(10, 60), rng.integers(10, 60))))
    kinds = ["text", "title", "table"]
    clean = [(p, i, *box(), str(rng.choice(kinds)), str(rng.choice(words))) for p in range(25) for i in range(int(rng.integers(1, 6)))]
    adv = [(p, "C", j, *box(), str(rng.choice(kinds)), str(rng.choice(words))) for p in range(25) for j in range(int(rng.integers(0, 5)))]
    grid = [(p, "C", 30, 30, 90, 90) for p in range(25)]
    c, a = spark.createDataFrame(clean, EL), spark.createDataFrame(adv, AD)
    g = spark.createDataFrame(grid, "page_id long, config_id string, mx1 long, my1 long, mx2 long, my2 long")
    m = matching.with_similarity(matching.best_match(c, a, g)).cache()
    losses = {r.page_id: r.b_slr for r in matching.block_loss(m).collect()}
    paths = {r.page_id: r for r in matching.decomposed_loss(m, g).collect()}
    texts = {r.page_id: r for r in matching.text_ablation(m).collect()}
    greedy = {r.page_id: r.delta_cer for r in matching.greedy_cer(c, a, g).collect()}
    maps = {r.page_id: r.map for r in detection.page_map(c, a.withColumn("score", F.lit(1.0)), g).collect()}
    for p in range(25):
        mine, found = [r for r in clean if r[0] == p], [r for r in adv if r[0] == p]
        rows = []
        for r in mine:
            laps = [overlap(r[2:6], b[3:7]) for b in found]
            best = max(range(len(found)), key=lambda j: (laps[j], -j), default=None)
            iou = laps[best] if best is not None else 0.0
            other = found[best] if iou > 0 else None
            ref, hyp = r[7].strip().lower(), (other[8].strip().lower() if other else "")
            sim = None if other is None or not ref else common(ref, hyp) / max(len(ref), len(hyp)) if hyp else 0.0
            rows.append((r, other, iou, ref, hyp, sim, iou < 0.1 or (bool(ref) and (sim or 0.0) < 0.5)))
        assert abs(losses[p] - sum(x[6] for x in rows) / len(rows)) < 1e-9
        sharing = [id(x[1]) for x in rows if x[2] >= 0.1]
        names = []
        for r, other, iou, _, _, _, lost in rows:
            x1, y1 = max(0, r[2] - r[4] // 2), max(0, r[3] - r[5] // 2)
            w, h = min(1000, x1 + r[4]) - x1, min(1400, y1 + r[5]) - y1
            under = max(0, min(x1 + w, 90) - max(x1, 30)) * max(0, min(y1 + h, 90) - max(y1, 30)) / (w * h) >= 0.3
            names.append("intact" if not lost else "miss" if under else "merge" if iou >= 0.1 and sharing.count(id(other)) > 1 else "misclass" if iou >= 0.1 and other[7] != r[6] else "degraded")
        assert [paths[p][f"n_{n}"] for n in ("miss", "merge", "misclass", "degraded", "intact")] == [names.count(n) for n in ("miss", "merge", "misclass", "degraded", "intact")]
        worded, near = [x for x in rows if x[3]], [x[5] for x in rows if x[3] and x[2] >= 0.1]
        default = 0.0 if not found else 1.0
        assert abs(texts[p].text_sim_mean - (sum(near) / len(near) if near else default)) < 1e-9 and abs(texts[p].text_sim_min - (min(near) if near else default)) < 1e-9
        rates = [edits(x[3], x[4]) / len(x[3]) if x[1] else 1.0 for x in worded]
        assert abs(texts[p].cer_mean - (sum(rates) / len(rates) if rates else 1.0)) < 1e-9 and texts[p].n_text_degraded == sum(s < 0.5 for s in near)
        free, rates = list(found), []
        for x in worded:
            laps = [overlap(x[0][2:6], b[3:7]) for b in free]
            if laps and max(laps) > 0:
                rates.append(edits(x[3], free.pop(laps.index(max(laps)))[8].strip().lower()) / len(x[3]))
            else:
                rates.append(1.0)
        assert abs(greedy[p] - (1.0 if not found or not rates else sum(rates) / len(rates))) < 1e-9
        aps = []
        for kind in {r[6] for r in mine}:
            left, flags = [r for r in mine if r[6] == kind], []
            total = len(left)
            for b in (b for b in found if b[7] == kind):
                laps = [overlap(r[2:6], b[3:7]) for r in left]
                flags.append(bool(laps) and max(laps) >= 0.5)
                if flags[-1]:
                    left.pop(laps.index(max(laps)))
            hits = np.cumsum(flags)
            aps.append(sum(max(hits[k] / (k + 1) for k in range(i, len(flags))) for i, f in enumerate(flags) if f) / total)
        assert abs(maps[p] - sum(aps) / len(aps)) < 1e-9, p


def test_metric_rows_agree(spark, pages):
    clean, adv, grid = pages
    rows = {r.page_id: r for r in matching.metric_rows(clean, adv, grid).collect()}
    assert set(rows) == {1, 2} and all(abs(r.b_slr - r.slr_miss - r.slr_topo) < 1e-12 for r in rows.values())
    guard = spark.createDataFrame([(1,), (2,), (9,)], "page_id long")
    kept, warned = page_sets.guarded(guard, clean)
    assert sorted(r.page_id for r in kept.collect()) == [1, 2] and [r.page_id for r in warned.collect()] == [9]


def test_page_sets(spark):
    rows = spark.createDataFrame([(1, "doclaynet", "law"), (2, "doclaynet", None), (3, "publaynet", None), (4, None, "law")], "page_id long, data_source string, doc_category string")
    ids = lambda df: sorted(r.page_id for r in df.collect())
    assert ids(page_sets.of_source(rows, "doclaynet")) == [1, 2] and ids(page_sets.of_source(rows, None)) == [1, 2, 3, 4]
    assert ids(page_sets.of_categories(rows, {"law"})) == [1, 3, 4] and ids(page_sets.of_categories(rows, set())) == [1, 2, 3, 4]
    base = spark.createDataFrame([(1, ["s"], ["e"]), (2, [], ["e"]), (3, ["s"], None)], "page_id long, spans array<string>, elements array<string>")
    assert ids(page_sets.without_empty_baseline(rows, base)) == [1, 4]
    gate = page_sets.baseline_gate(base).first()
    assert (gate.pages, gate.empty, gate.ok) == (3, 1, False) and page_sets.baseline_gate(base.limit(0)).first().ok
    assert page_sets.should_run({"all"}, "1a") and not page_sets.should_run({"0"}, "1a")
    stems = spark.createDataFrame([("report_012",), ("a_b_7",), ("plain",), ("_0",)], "s string")
    whole, page = page_sets.doc_and_page(F.col("s"))
    assert [tuple(r) for r in stems.select(whole, page).collect()] == [("report", "12"), ("a_b", "7"), ("unknown", "unknown"), ("", "0")]
    pool = spark.createDataFrame([(i, "simple" if i % 3 else "complex") for i in range(60)], "page_id long, level string")
    kept = pool.filter("page_id < 8")
    filled = page_sets.backfill(kept, pool, "level", 20, {"simple": 0.5, "complex": 0.5}, "s").collect()
    assert len(filled) == 20 and sum(r.level == "complex" for r in filled) == 10 and {0, 1, 2, 3, 4, 5, 6, 7} <= {r.page_id for r in filled}
    candidates = spark.createDataFrame([(i, f"i{i}.png", i, ["simple", "medium", "complex"][i % 3]) for i in range(90)] + [(5, "again.png", 99, "simple")], "page_id long, image_path string, pos int, complexity string")
    full, debug = page_sets.build_manifest(candidates, F.when(F.col("page_id") == 7, "bad"), 30, 6, "42")
    assert full.count() == 30 and debug.join(full, "page_id", "left_semi").count() == 6 and full.filter("page_id = 7").count() == 0


def test_page_records(spark):
    steps = spark.createDataFrame([(1, [("P1", {"w": 3.0}, "anchor", [1, 2], "r"), ("P3", {}, "random", None, "r")])], f"page_id long, steps array<{planning.STEP}>")
    row = steps.select(*(c.alias(n) for n, c in page_sets.plan_columns(F.col("steps")).items())).first()
    assert (row.probe_types, row.target_strategies, row.target_fallback) == ("P1;P3", "anchor;random", True) and '"probe_type":"P1"' in row.plan_json
    items = spark.createDataFrame([("The Answer is 42 units.", [("q", "42 units", "answer is"), ("", "gone", None)])], "s string, items array<struct<question:string,answer:string,evidence:string>>")
    assert items.select(page_sets.item_faults(F.col("items"), F.col("s"))).first()[0] == ["missing_question", "missing_evidence", "answer_not_in_source"]
    kept = spark.createDataFrame([(["A b", "a B", "c", "", "d", "e", "f"], [True] * 6 + [False])], "a array<string>, ok array<boolean>")
    assert kept.select(page_sets.estimated_kept(F.col("a"), F.col("ok"))).first()[0] == 4
    asked = spark.createDataFrame([("q2", 1, "two"), ("q1", 1, "one")], "qa_id string, page_id long, question string")
    texts = spark.createDataFrame([(1, "x" * 9000)], "page_id long, page_text string")
    payload = page_sets.question_payload(asked, texts).first().payload
    assert payload.count("x" * 8000) == 1 and "x" * 8001 not in payload and payload.index('"one"') < payload.index('"two"')
    blocks = spark.createDataFrame([([([1.4, 2.5, 40.0, 9.5], "section title"), ([5.0, 5.0, 5.0, 6.0], "x")],)], "b array<struct<bbox:array<double>,layout_type:string>>")
    notes = blocks.select(page_sets.annotations_of(F.col("b"), F.lit(30), F.lit(30))).first()[0]
    assert [(n.bbox, n.category) for n in notes] == [([1, 2, 30, 10], "Section Title")]
    given = page_sets.with_fields(spark.createDataFrame([((1, 2),)], "s struct<a:int,b:int>"), "s", {"b": F.lit(5), "c": F.lit(7)}).first().s
    assert given.asDict() == {"a": 1, "b": 5, "c": 7}


def test_evaluation_defaults(spark):
    meta = spark.createDataFrame([(1, "probe", 0.2), (2, "probe", 0.4)], "page_id long, condition string, tor double")
    summary = spark.createDataFrame([("probe", 0.0), ("large", 0.9)], "condition string, mean_tor double")
    assert {r.condition: round(r.mean_tor, 9) for r in evaluation.mean_tor(meta, summary).collect()} == {"probe": 0.3, "large": 0.9}
    rows = spark.createDataFrame([(1, "probe"), (3, "probe"), (3, "clean"), (3, "large")], "page_id long, condition string")
    assert {(r.page_id, r.condition): round(r.tor, 9) for r in evaluation.with_tor(rows, meta, summary).collect()} == {(1, "probe"): 0.2, (3, "probe"): 0.3, (3, "clean"): 0.0, (3, "large"): 0.9}
    records = spark.createDataFrame([(1, "probe", "empty"), (5, "probe", "empty"), (2, "probe", "success")], "page_id long, condition string, parser_status string")
    asked = spark.createDataFrame([(1, "a"), (1, "b")], "page_id long, qa_id string")
    found = evaluation.empty_page_details(records, meta.withColumn("support_bbox", F.array(F.lit(1.0))), asked).collect()
    assert {(r.page_id, r.tor, r.num_qa) for r in found} == {(1, 0.2, 2), (5, None, 0)}
    cover = spark.createDataFrame([("answer", "m", "clean", 10, 9), ("evidence", "m", "clean", 10, 4), ("answer", "m", "probe", 10, 1)], "kind string, pipeline string, condition string, total long, covered long")
    chunks = spark.createDataFrame([("m", "clean", 1)] * 2 + [("m", "clean", 2)] * 3, "pipeline string, condition string, page_id long")
    gates = {r.condition: (r.pages_few_chunks, r.ready) for r in evaluation.corpus_gates(cover, chunks).collect()}
    assert gates == {"clean": (1, False), "probe": (0, True)}


def test_character_loss_strips():
    from pagelens.functions.text import character_loss_of

    assert character_loss_of("  abc ", "\nabc") == 0.0 and character_loss_of(" ", "x") == 0.0 and character_loss_of("abc", " \t") == 1.0
    assert character_loss_of(" " * 3000 + "abcd", "ab") == 0.5


def test_saved_index(spark, tmp_path):
    chunks = spark.createDataFrame([(1, 0, "a b"), (1, 1, "b c"), (2, 0, "")], "page_id long, chunk_index int, text string")
    index = retrieval.build_index(chunks)
    retrieval.save_index(index, f"{tmp_path}/index")
    asked = spark.createDataFrame([("q", 1, "c")], "qa_id string, page_id long, question string")
    rows = lambda i: [(r.rank, r.chunk_index, round(r.score, 9)) for r in retrieval.bm25(i, asked, top=None).orderBy("rank").collect()]
    loaded = retrieval.load_index(spark, f"{tmp_path}/index")
    assert rows(loaded) == rows(index) and len(rows(index)) == 2
    index["lengths"].filter("page_id = 1").write.mode("overwrite").parquet(f"{tmp_path}/index/lengths")
    with pytest.raises(ValueError):
        retrieval.load_index(spark, f"{tmp_path}/index")


def test_selected_dataset_and_writers(spark, tmp_path):
    doc = spark.createDataFrame([([(1, "a.png", None), (2, "b.png", "law"), (3, "c.png", None)], [(1, 1, [0.0, 0.0, 10.0, 10.0], None), (1, 9, [5.0, 5.0, 5.0, 5.0], 25.0)], None)], files.COCO)
    images = spark.createDataFrame([("a.png", 100, 100), ("b.png", 50, 80)], "file_name string, width int, height int")
    rows = {r.file_name: r for r in files.selected_dataset(doc, images, files.PUBLAYNET, "publaynet").collect()}
    assert set(rows) == {"a.png", "b.png"} and rows["a.png"].n_blocks == 2 and rows["b.png"].annotations == [] and rows["b.png"].level == "simple"
    assert sorted(a.category for a in rows["a.png"].annotations) == ["9", "Text"]
    files.write_text(spark.createDataFrame([("x",), (None,)], "value string").coalesce(1), f"{tmp_path}/t")
    assert [r.value for r in spark.read.text(f"{tmp_path}/t").collect()] == ["x", ""]
    files.write_json_document(doc, f"{tmp_path}/doc")
    assert files.read_json_document(spark, f"{tmp_path}/doc", files.COCO).first().images[1].file_name == "b.png"


def test_targeted_plans(spark, pages):
    clean, _, _ = pages
    rows = {(r.page_id, r.config_id): r.steps for r in planning.targeted_plans(clean, 400, 400).collect()}
    assert len(rows) == 14 and [s.target_location for s in rows[1, "NT07"]] == [[70, 70], [200, 200]] and rows[2, "NT01"][0].params == {"r": 70.0, "alpha": 0.55}
    static = spark.createDataFrame([(1, "A01", [("P9", {}, "anchor", None, "own")])], f"page_id long, config_id string, steps array<{planning.STEP}>")
    plans = {(r.page_id, r.config_id): r.steps[0] for r in planning.phase_plans(clean.select("page_id").distinct(), planning.anchor_configs(spark), planning.targets(clean, 400, 400), static=static).collect()}
    assert len(plans) == 44 and plans[1, "A01"].probe_type == "P9" and plans[2, "A01"].probe_type == "P1" and len(plans[2, "A09"].target_location) == 2


def test_sql_functions(spark):
    from pagelens.functions.register import register

    assert "pl_similarity" in register(spark)
    spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "g string, v double").createOrReplaceTempView("some_values")
    assert {r.g: r.m for r in spark.sql("SELECT g, pl_safe_mean(v) AS m FROM some_values GROUP BY g").collect()} == {"a": 1.0, "b": 0.0}
    assert spark.sql("SELECT pl_similarity('abc', 'axc') AS s").first().s == 2 / 3


def test_config_means_tie_whatever_the_order(spark):
    """Sums of 0.1, 0.2, 0.3 differ by their order; ranks of config means must not."""
    values = {"A": [0.1, 0.2, 0.3], "B": [0.3, 0.2, 0.1], "C": [None, float("nan"), 0.2], "D": [600.0, -0.5, 0.5], "E": [float("inf"), 1.0, 1.0], "F": [None, None, None], "G": [-0.25, -0.5, -0.75]}
    rows = [(k, *[v] * len(report.COLUMNS)) for k, vs in values.items() for v in vs]
    metrics = spark.createDataFrame(rows, "config_id string, " + ", ".join(f"{c} double" for c in report.COLUMNS)).coalesce(1)
    mean = {r.config_id: r.b_slr for r in report.config_table(metrics).collect()}
    assert mean["A"] == mean["B"] == mean["C"] == 0.2 and mean["D"] == 200.0 and mean["E"] == float("inf") and mean["F"] is None and mean["G"] == -0.5


def test_pages_searched_in_place_equal_the_index(spark):
    """Hits of a page scored where it lies are those over the index tables, and nothing is shuffled for them."""
    rng = np.random.default_rng(9)
    texts = {p: [" ".join(f"w{w}" for w in rng.integers(0, 12, rng.integers(0, 9))) for _ in range(n)] for p, n in enumerate((1, 2, 15, 40, 3))}
    asked = {p: [{"qa_id": f"{p}_{i}", "question": " ".join(f"w{w}" for w in rng.integers(0, 14, 5)), "gold": texts[p][-1][:5]} for i in range(3 if p != 1 else 0)] for p in texts}
    pages = spark.createDataFrame([(p, texts[p], asked[p]) for p in texts] + [(7, None, None)], "page_id long, chunks array<string>, queries array<struct<qa_id:string,question:string,gold:string>>")
    found = retrieval.search_pages(pages, {"hit": "gold"})
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.qa_id, h.rank): (h.chunk_index, round(h.score, 6), h.hit) for r in found.collect() for h in r.hits}
    chunks = spark.createDataFrame([(p, i, t) for p, ts in texts.items() for i, t in enumerate(ts)], "page_id long, chunk_index int, text string")
    queries = spark.createDataFrame([(q["qa_id"], p, q["question"]) for p, qs in asked.items() for q in qs], "qa_id string, page_id long, question string")
    gold = {q["qa_id"]: (p, q["gold"]) for p, qs in asked.items() for q in qs}
    held = lambda r: int(gold[r.qa_id][1] != "" and gold[r.qa_id][1] in texts[r.page_id][r.chunk_index])
    want = {(r.qa_id, r["rank"]): (r.chunk_index, round(r.score, 6), held(r)) for r in retrieval.bm25(retrieval.build_index(chunks), queries, digits=9).collect()}
    assert got == want and len(want) > 60


def test_page_fold_equals_matches(spark, pages):
    """Losses folded page by page are those of the match rows, and no row is joined by element."""
    from pagelens.operators import page_metrics
    from pagelens.sources import fixtures as fx

    sf = "/root/testdata/sf0.001"
    odd = spark.createDataFrame([(3, 0, 5, 5, 0, 0, None, None), (3, 1, 5, 5, 4, 4, "", " \u3000"), (3, 2, 5, 5, 4, 4, "text", "Ab")], EL)
    more = spark.createDataFrame([(3, "C", 0, 5, 5, 4, 4, None, None), (3, "C", 1, 5, 5, 4, 4, "table", " aB "), (9, "C", 0, 1, 1, 2, 2, "text", "x"), (3, "Z", 0, 5, 5, 4, 4, "text", "Ab")], AD)
    place = spark.createDataFrame([(3, "C", 0, 0, 5, 5), (3, "D", 0, 0, 5, 5), (9, "C", 0, 0, 5, 5)], pages[2].schema)
    for clean, adv, masks_ in (tuple(a.unionByName(b) for a, b in zip(pages, (odd, more, place), strict=True)), (fx.clean_elements(spark, sf), fx.perturbed_elements(spark, sf), fx.page_configs(spark, sf))):
        want = matching.decomposed_loss(matching.with_similarity(matching.best_match(clean, adv, masks_)), masks_)
        found = page_metrics.decomposed_loss(clean, adv, masks_)
        assert not re.search(r"hashpartitioning\([^)]*(config_id|adv_id|elem_id)#", found._jdf.queryExecution().executedPlan().toString())
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.select(*found.columns).collect()}
        rows = page_metrics.metric_rows(clean, adv, masks_)
        assert not re.search(r"hashpartitioning\([^)]*(config_id|adv_id|elem_id)#", rows._jdf.queryExecution().executedPlan().toString())
        near = lambda df: {(r.page_id, r.config_id): tuple(-1.0 if v is None else round(v, 9) for v in r[2:]) for r in df.select(*rows.columns).collect()}
        assert near(rows) == near(matching.metric_rows(clean, adv, masks_))


def test_places_equal_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(p, k, int(x), int(y), int(w), int(h), "text", "") for p in range(60) for k, (x, y, w, h) in enumerate(rng.integers((0, 0, 0, 0), (1050, 1450, 400, 300), (1 + p % 7 if p else 40, 4)))]
    elements = spark.createDataFrame(rows, EL).repartition(2).cache()
    want = {(r.page_id, r.target_strategy): (r.x, r.y) for r in planning.targets(elements, 1000, 1400).collect()}
    boxes = elements.groupBy("page_id").agg(F.expr("transform(array_sort(collect_list(struct(elem_id, x, y, w, h))), b -> struct(b.x, b.y, b.w, b.h))").alias("boxes"))
    for strategy in ("anchor", "content", "random", "bridge"):
        got = placing.with_targets(boxes.withColumn("target_strategy", F.lit(strategy)), 1000, 1400).collect()
        assert len(got) == 60 and all((r.x, r.y) == want[r.page_id, strategy] for r in got)


def test_stamps_equal_painted_pages():
    rng, shape = np.random.default_rng(6), (41, 30)
    for _, probe, _, params in (*planning.ANCHORS, ("", "P10", "", {"theta": 30.0}), ("", "P3", "", {"r": 8.0}), ("", "odd", "", {}), ("", "P6", "", {})):
        stamp = raster.Stamp(probe, params, shape)
        size = rng.integers(0, 6, 40)
        start = np.concatenate([[0], np.cumsum(size)])
        at = rng.uniform(-4, 40, (start[-1], 2))
        boxes = np.concatenate([at, at + rng.uniform(-2, 25, at.shape)], 1)
        x, y = rng.integers(0, 30, 40), rng.integers(0, 41, 40)
        got = np.stack(stamp.run(raster.stripes(boxes, start, shape), x, y), 1)
        want = [raster.painted(i, "", boxes[a:b], [{"probe_type": probe, "params": params, "target_location": [x[i], y[i]]}], shape) for i, (a, b) in enumerate(zip(start, start[1:], strict=False))]
        assert np.abs(got - want).max() < 1e-9, (probe, params)


def test_run_plans_of_any_steps(spark):
    steps = "array<struct<probe_type:string,params:map<string,double>,target_location:array<int>>>"
    plans = [[("P4", {"area_ratio": 0.1}, [3, 5])], [("P7", {"n_points": 9.0}, None)], [("P1", {}, None), ("P3", {"r": 9.0}, [10, 10])], [("P2", None, [500, 5])], [("P2", {"w": 4.0}, None)], [(None, {}, [1, 1])], []]
    boxes = [[1.0, 2.0, 20.0, 18.5], [-3.0, 9.0, 8.0, 90.0]]
    rows = [(p, f"c{p}", boxes[: p % 3], s) for p, s in enumerate(plans)]
    got = {r.page_id: tuple(r)[1:] for r in raster.run_plans(spark.createDataFrame(rows, f"page_id long, config_id string, boxes array<array<double>>, steps {steps}"), (40, 30)).collect()}
    assert len(got) == len(rows)
    for p, c, b, s in rows:
        tor, similar, mean, dark = raster.painted(p, c, b, [dict(zip(("probe_type", "params", "target_location"), x, strict=True)) for x in s], (40, 30))
        assert got[p] == (c, tor, pytest.approx(similar, abs=1e-9), len(s), pytest.approx(mean), dark)
