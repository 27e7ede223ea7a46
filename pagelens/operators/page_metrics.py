"""The losses of ``matching`` in one fold over pages: boxes and texts of a page travel once, as arrays.

Pairs of a batch of pages are numbers side by side, so no row is made for a
pair or a match, and nothing but the page's own elements is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import similarity
from ..sources.fixtures import PAGE_H, PAGE_W
from .matching import IOU, OCCLUDED, SIMILAR, struct_columns

#: Unicode white space, as the Column form of ``strip`` has it.
BLANK = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PATHS = ("miss", "merge", "misclass", "degraded", "intact")
DECOMPOSED = "page_id long, config_id string, slr_miss double, slr_topo double, b_slr double, " + ", ".join(f"n_{p} long" for p in PATHS) + ", n_total long"


def page_arrays(clean: DataFrame, adv: DataFrame, masks: DataFrame) -> DataFrame:
    """One row for each page with clean elements and masks: arrays ``clean``, ``adv`` and ``masks``."""
    box = [F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")]
    gathered = lambda df, name, *columns: df.groupBy("page_id").agg(F.collect_list(F.struct(*columns)).alias(name))
    rows = gathered(clean, "clean", "elem_id", *box, "type", "text").join(gathered(masks, "masks", "config_id", *(F.col(c).cast("double").alias(c) for c in ("mx1", "my1", "mx2", "my2"))), "page_id")
    return rows.join(gathered(adv, "adv", "config_id", "adv_id", *box, "type", "text"), "page_id", "left").select("page_id", "clean", "adv", "masks")


def ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places start .. start + count of each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)


def texts_of(lists: pa.ListArray, name: str) -> pa.Array:
    flat = lists.flatten()
    return flat.flatten()[flat.type.get_field_index(name)]


def codes(*columns: pa.Array) -> tuple[list[np.ndarray], list]:
    """Whole numbers for the columns' values, alike in all of them, and the values; a null is a value."""
    every = pa.chunked_array([c.cast(pa.string()) for c in columns]).combine_chunks().dictionary_encode(null_encoding="encode")
    if isinstance(every, pa.ChunkedArray):
        every = every.combine_chunks()
    at = every.indices.to_numpy()
    return np.split(at, np.cumsum([len(c) for c in columns])[:-1]), every.dictionary.to_pylist()


@lru_cache(maxsize=100_000)
def _alike(a: str, b: str) -> float:
    a, b = a.strip(BLANK).lower(), b.strip(BLANK).lower()
    return 0.0 if not b else 1.0 if a == b else similarity(a, b)


def _firsts(match: np.ndarray, laps: np.ndarray) -> np.ndarray:
    """Places of the first largest overlap of each match; a match's pairs stand together."""
    if not len(match):
        return np.zeros(0, int)
    first = np.flatnonzero(np.r_[True, match[1:] != match[:-1]])
    best = np.flatnonzero(laps == np.repeat(np.maximum.reduceat(laps, first), np.diff(np.r_[first, len(laps)])))
    return best[np.r_[True, match[best][1:] != match[best][:-1]]]


def _rows(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Numbers of the batch's groups (page, config) and matches (group, clean element), the best perturbed element beside each match."""
    at, xywh = struct_columns(batch.column("clean"), ("x", "y", "w", "h"))
    to, other = struct_columns(batch.column("adv"), ("adv_id", "x", "y", "w", "h"))
    by, mask = struct_columns(batch.column("masks"), ("mx1", "my1", "mx2", "my2"))
    (g_config, a_config), configs = codes(texts_of(batch.column("masks"), "config_id"), texts_of(batch.column("adv"), "config_id"))
    page_of = lambda starts: np.repeat(np.arange(batch.num_rows), np.diff(starts))
    g_page = page_of(by)
    g_key, a_key = g_page * len(configs) + g_config, page_of(to) * len(configs) + a_config
    sort = np.argsort(g_key, kind="stable")
    place = np.minimum(np.searchsorted(g_key[sort], a_key), max(0, len(sort) - 1))
    known = g_key[sort][place] == a_key if len(sort) else np.zeros(len(a_key), bool)
    a_group = np.where(known, sort[place] if len(sort) else 0, len(g_key))
    order = np.lexsort((other[0], a_group))
    a_count = np.bincount(a_group, minlength=len(g_key) + 1)[: len(g_key)]
    a_start = np.cumsum(a_count) - a_count
    m_group, m_elem = ranges(at[:-1][g_page], np.diff(at)[g_page])
    p_match, p_adv = ranges(a_start[m_group], a_count[m_group])
    corner = lambda x, y, w, h: (x - w / 2.0, y - h / 2.0, x + w / 2.0, y + h / 2.0)
    c, a = corner(*xywh), [v[order] for v in corner(*other[1:])]
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    c_area, a_area, p_elem = size(c), size(a), m_elem[p_match]
    inter = np.maximum(0, np.minimum(c[2][p_elem], a[2][p_adv]) - np.maximum(c[0][p_elem], a[0][p_adv])) * np.maximum(0, np.minimum(c[3][p_elem], a[3][p_adv]) - np.maximum(c[1][p_elem], a[1][p_adv]))
    hit = np.flatnonzero(inter > 0)
    p_match, p_adv, inter = p_match[hit], p_adv[hit], inter[hit]
    laps = inter / (c_area[m_elem[p_match]] + a_area[p_adv] - inter)
    iou, adv = np.zeros(len(m_elem)), np.full(len(m_elem), -1)
    best = _firsts(p_match, laps)
    iou[p_match[best]], adv[p_match[best]] = laps[best], order[p_adv[best]]
    return {"g_page": g_page, "m_group": m_group, "m_elem": m_elem, "iou": iou, "adv": adv, "box": np.stack(xywh), "mask": np.stack(mask), "n_adv": len(order), "a_count": a_count, "p_match": p_match, "p_adv": p_adv, "laps": laps, "order": order}


def _similar(batch: pa.RecordBatch, r: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(worded, similarity) of the matches; each pair of texts is compared once a batch."""
    (mine, said), texts = codes(texts_of(batch.column("clean"), "text"), texts_of(batch.column("adv"), "text"))
    worded = np.asarray([bool((t or "").strip(BLANK)) for t in texts], bool)[mine][r["m_elem"]] if len(texts) else np.zeros(0, bool)
    out = np.zeros(len(r["iou"]))
    at = np.flatnonzero(worded & (r["adv"] >= 0))
    pairs, back = np.unique(mine[r["m_elem"][at]].astype(np.int64) * len(texts) + said[r["adv"][at]], return_inverse=True)
    out[at] = np.asarray([_alike(texts[p // len(texts)] or "", texts[p % len(texts)] or "") for p in pairs.tolist()], float)[back]
    return worded, out


def _under(r: dict[str, np.ndarray], page_w: int, page_h: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels of each match's clean box under its group's rectangle, and of the box, as in ``matching.mask_cover``."""
    x, y, w, h = r["box"]
    x1, y1 = np.maximum(0, x - np.floor(w / 2)), np.maximum(0, y - np.floor(h / 2))
    x2, y2 = np.minimum(page_w, x1 + w), np.minimum(page_h, y1 + h)
    e, (mx1, my1, mx2, my2) = r["m_elem"], r["mask"][:, r["m_group"]]
    cover = np.maximum(0, np.minimum(np.minimum(x2[e], mx2), page_w) - np.maximum(x1[e], mx1)) * np.maximum(0, np.minimum(np.minimum(y2[e], my2), page_h) - np.maximum(y1[e], my1))
    return cover, (np.maximum(0, x2 - x1) * np.maximum(0, y2 - y1))[e]


def _paths(batch: pa.RecordBatch, r: dict[str, np.ndarray], worded: np.ndarray, alike: np.ndarray, cover: np.ndarray, box: np.ndarray, iou: float, similar: float, occluded: float) -> list[np.ndarray]:
    """The columns of ``DECOMPOSED`` after its keys."""
    (mine, other), kinds = codes(texts_of(batch.column("clean"), "type"), texts_of(batch.column("adv"), "type"))
    named = np.asarray([bool(k) for k in kinds] or [False], bool)
    matched, e, a = r["iou"] >= iou, r["m_elem"], r["adv"]
    lost = ~matched | (worded & (alike < similar))
    sharing = np.bincount(a[matched & (a >= 0)], minlength=max(1, r["n_adv"]))[a]
    theirs = other[a] if len(other) else np.zeros(len(a), int)
    retyped = (a >= 0) & named[mine[e]] & named[theirs] & (mine[e] != theirs)
    path = np.select([~lost, (box > 0) & (cover / np.maximum(box, 1) >= occluded), matched & (sharing > 1), matched & retyped], [4, 0, 1, 2], 3)
    groups = len(r["g_page"])
    n = np.bincount(r["m_group"] * 5 + path, minlength=groups * 5).reshape(groups, 5)
    total, topo = n.sum(1), n[:, 1:4].sum(1)
    return [n[:, 0] / total, topo / total, (n[:, 0] + topo) / total, *n.T, total]


def _made(batch: pa.RecordBatch, r: dict[str, np.ndarray], columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    keys = [batch.column("page_id").take(pa.array(r["g_page"])), texts_of(batch.column("masks"), "config_id")]
    return pa.RecordBatch.from_arrays([*keys, *map(pa.array, columns)], names=[f.split()[0] for f in schema.split(", ")])


def decomposed_loss(clean: DataFrame, adv: DataFrame, masks: DataFrame, iou: float = IOU, similar: float = SIMILAR, occluded: float = OCCLUDED) -> DataFrame:
    """``matching.decomposed_loss`` of the best matches, page by page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = _rows(batch)
            yield _made(batch, r, _paths(batch, r, *_similar(batch, r), *_under(r, PAGE_W, PAGE_H), iou, similar, occluded), DECOMPOSED)

    return page_arrays(clean, adv, masks).mapInArrow(run, DECOMPOSED)


@lru_cache(maxsize=100_000)
def error_rate(reference: str, found: str) -> float:
    """``cer`` of two texts: Levenshtein distance over the reference's length, case-folded and stripped."""
    a, b = reference.strip(BLANK).lower(), found.strip(BLANK).lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1] / len(a) if a else 0.0


def _rates(batch: pa.RecordBatch, r: dict[str, np.ndarray], adv: np.ndarray) -> np.ndarray:
    """Error rate of each match's text against ``adv``'s, 1 where that is -1; each pair of texts is compared once a batch."""
    (mine, said), texts = codes(texts_of(batch.column("clean"), "text"), texts_of(batch.column("adv"), "text"))
    out = np.ones(len(adv))
    at = np.flatnonzero(adv >= 0)
    pairs, back = np.unique(mine[r["m_elem"][at]].astype(np.int64) * len(texts) + said[adv[at]], return_inverse=True)
    out[at] = np.asarray([error_rate(texts[p // len(texts)] or "", texts[p % len(texts)] or "") for p in pairs.tolist()], float)[back]
    return out


def _greedy(batch: pa.RecordBatch, r: dict[str, np.ndarray], worded: np.ndarray) -> np.ndarray:
    """For each match the perturbed element that ``matching.greedy_matches`` gives it, or -1: all pages' first worded blocks, then all second ones."""
    _, (elem,) = struct_columns(batch.column("clean"), ("elem_id",))
    turn, order = np.zeros(len(worded), int), np.lexsort((elem[r["m_elem"]], r["m_group"]))
    seen = np.cumsum(worded[order])
    group = r["m_group"][order]
    start = np.searchsorted(group, group)
    turn[order] = seen - (seen[start] - worded[order][start]) - 1 if len(order) else 0
    keep = np.flatnonzero(worded[r["p_match"]])
    keep = keep[np.argsort(turn[r["p_match"][keep]], kind="stable")]
    ends = np.cumsum(np.bincount(turn[r["p_match"][keep]]))
    free, picks = np.ones(r["n_adv"], bool), np.full(len(worded), -1)
    for lo, hi in zip([0, *ends], ends, strict=False):
        at = keep[lo:hi]
        at = at[free[r["p_adv"][at]]]
        best = at[_firsts(r["p_match"][at], r["laps"][at])]
        picks[r["p_match"][best]] = r["order"][r["p_adv"][best]]
        free[r["p_adv"][best]] = False
    return picks


METRICS = "page_id long, config_id string, tor double, boc double, eir double, " + DECOMPOSED.split(", ", 2)[2] + ", text_sim_mean double, text_sim_min double, cer_mean double, n_matched long, n_text_degraded long, b_slr_text_only double, splash double, n_lost long, delta_cer double, eir_det double"


def metric_rows(clean: DataFrame, adv: DataFrame, masks: DataFrame, margin: int = 20) -> DataFrame:
    """``matching.metric_rows`` in one fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = _rows(batch)
            worded, alike = _similar(batch, r)
            cover, box = _under(r, PAGE_W, PAGE_H)
            g, groups = r["m_group"], len(r["g_page"])
            count = lambda rows: np.bincount(g[rows], minlength=groups)  # noqa: E731,B023
            total = np.maximum(1, np.bincount(g, minlength=groups))

            def mean(values: np.ndarray, rows: np.ndarray, empty: np.ndarray | float) -> np.ndarray:
                n = count(rows)  # noqa: B023
                return np.where(n > 0, np.bincount(g[rows], values[rows], groups) / np.maximum(1, n), empty)  # noqa: B023

            mx1, my1, mx2, my2 = r["mask"]
            tor = np.maximum(0, (np.minimum(mx2, PAGE_W) - np.maximum(mx1, 0)) * (np.minimum(my2, PAGE_H) - np.maximum(my1, 0))) / float(PAGE_W * PAGE_H)
            x, y, w, h = r["box"][:, r["m_elem"]]
            mx1, my1, mx2, my2 = r["mask"][:, g]
            touched = (np.minimum(np.minimum(PAGE_W, np.rint(x + w / 2)), mx2) > np.maximum(np.maximum(0, np.rint(x - w / 2)), mx1)) & (np.minimum(np.minimum(PAGE_H, np.rint(y + h / 2)), my2) > np.maximum(np.maximum(0, np.rint(y - h / 2)), my1))
            missed = r["iou"] < IOU
            near, none = worded & ~missed, r["a_count"] == 0
            least = np.full(groups, np.inf)
            np.minimum.at(least, g[near], alike[near])
            least = np.where(np.isinf(least), np.where(none, 0.0, 1.0), least)
            degraded = count(near & (alike < SIMILAR))
            far = (x < mx1 - margin) | (x > mx2 - 1 + margin) | (y < my1 - margin) | (y > my2 - 1 + margin)
            cer_mean = mean(_rates(batch, r, r["adv"]), worded, 1.0)
            columns = [tor, count(touched) / total, count(cover >= 1) / total, *_paths(batch, r, worded, alike, cover, box, IOU, SIMILAR, OCCLUDED)]
            columns += [mean(alike, near, np.where(none, 0.0, 1.0)), least, cer_mean, count(worded), degraded, degraded / total]
            columns += [count(missed & far) / np.maximum(1, count(missed)), count(missed), mean(_rates(batch, r, _greedy(batch, r, worded)), worded, 1.0), count(missed) / total]
            yield _made(batch, r, columns, METRICS)

    return page_arrays(clean, adv, masks).mapInArrow(run, METRICS).withColumn("b_slr_per_tor", F.try_divide("b_slr", "tor"))
