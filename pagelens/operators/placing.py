"""Places of single strategies, found where a page's boxes lie: numpy forms of the draws in ``planning.targets``.

A mask is a grid between the edges of a page's boxes. Its runs, strip by strip,
are the disjoint rectangles of ``masks.union`` and ``masks.minus``, so a draw
picks the same pixel; no row is made for a rectangle, and a page is searched
for the one strategy that it needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .planning import hash_uniform

#: Boxes of a page whose grid is held whole, and pages to a grid; larger pages go strip by strip.
GRID_BOXES, GRID_PAGES = 24, 512
Rects = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _clipped(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, page_w: int, page_h: int) -> Rects:
    """Rectangles within the page; those without pixels shrink to its origin."""
    x0, x1, y0, y1 = (np.clip(v, 0, top) for v, top in ((x0, page_w), (x1, page_w), (y0, page_h), (y1, page_h)))
    some = (x0 < x1) & (y0 < y1)
    return x0 * some, y0 * some, x1 * some, y1 * some


def _row(rects: Rects, xs: np.ndarray, y: int) -> np.ndarray:
    """Cells of one page that a scan line covers."""
    x0, y0, x1, y1 = rects
    on = (y0 <= y) & (y < y1)
    n = len(xs)
    return np.cumsum(np.bincount(np.searchsorted(xs, x0[on]), minlength=n) - np.bincount(np.searchsorted(xs, x1[on]), minlength=n))[:-1] > 0


def pick(keep: Rects, holes: Rects | None, u: np.ndarray, page_w: int, page_h: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of a page: pixel number floor(u * pixels) of ``keep`` less ``holes``, arrays of (pages, boxes); the middle where there is none."""
    sides = [keep] if holes is None else [keep, holes]
    xs, ys = (np.sort(np.concatenate([s[i] for s in sides for i in at], 1), 1) for at in ((0, 2), (1, 3)))
    wide, high = np.diff(xs), np.diff(ys)
    n = len(u)
    whole = keep[0].shape[1] <= GRID_BOXES
    if whole:
        grids = []
        for x0, y0, x1, y1 in sides:
            grid = np.zeros((n, high.shape[1], wide.shape[1]), bool)
            for k in range(x0.shape[1]):
                down = (ys[:, :-1] >= y0[:, k, None]) & (ys[:, :-1] < y1[:, k, None])
                along = (xs[:, :-1] >= x0[:, k, None]) & (xs[:, :-1] < x1[:, k, None])
                grid |= down[:, :, None] & along[:, None, :]
            grids.append(grid)
        grid = grids[0] if holes is None else grids[0] & ~grids[1]
        width = np.matmul(grid.astype(np.float32), wide[:, :, None].astype(np.float32))[..., 0].astype(np.int64)  # whole numbers up to a page's width
    else:
        row = lambda i, y: _row(tuple(v[i] for v in keep), xs[i], y) & (True if holes is None else ~_row(tuple(v[i] for v in holes), xs[i], y))
        width = np.asarray([[row(i, y) @ wide[i] if h else 0 for y, h in zip(ys[i], high[i], strict=False)] for i in range(n)], np.int64)
    area = width * high
    end = np.cumsum(area, 1)
    pages, total = np.arange(n), end[:, -1]
    at = np.floor(u * total).astype(np.int64)
    strip = np.minimum((end <= at[:, None]).sum(1), high.shape[1] - 1)
    at = at - (end[pages, strip] - area[pages, strip])
    tall = np.maximum(high[pages, strip], 1)
    cells = grid[pages, strip] if whole else np.stack([row(i, ys[i, s]) for i, s in enumerate(strip)])
    reach = np.cumsum(cells * wide, 1)
    cell = np.minimum((reach <= (at // tall)[:, None]).sum(1), wide.shape[1] - 1)
    no = np.arange(wide.shape[1])
    first = np.maximum.accumulate(np.where(cells, -1, no), 1)[pages, cell] + 1
    last = np.minimum.accumulate(np.where(cells, len(no), no)[:, ::-1], 1)[:, ::-1][pages, cell]
    first = np.minimum(first, len(no) - 1)
    run = np.maximum(xs[pages, last] - xs[pages, first], 1)
    at = at - (reach[pages, first] - (cells * wide)[pages, first]) * tall
    found = total > 0
    return np.where(found, xs[pages, first] + at % run, page_w // 2), np.where(found, ys[pages, strip] + at // run, page_h // 2)


def _bridge(x: np.ndarray, y: np.ndarray, page_w: int, page_h: int) -> tuple[np.ndarray, np.ndarray]:
    """Middle of the closest two centres, the first of ties in the order of the boxes."""
    n, k = x.shape
    if k < 2:
        return np.full(n, page_w // 2), np.full(n, page_h // 2)
    least, a, b, pages = np.full(n, np.iinfo(np.int64).max), np.zeros(n, int), np.zeros(n, int), np.arange(n)
    for i in range(k - 1):
        d = (x[:, i + 1 :] - x[:, i, None]) ** 2 + (y[:, i + 1 :] - y[:, i, None]) ** 2
        j = d.argmin(1)
        better = d[pages, j] < least
        least, a, b = np.where(better, d[pages, j], least), np.where(better, i, a), np.where(better, i + 1 + j, b)
    return (x[pages, a] + x[pages, b]) // 2, (y[pages, a] + y[pages, b]) // 2


def place(strategy: str, boxes: np.ndarray, u: np.ndarray, page_w: int, page_h: int) -> tuple[np.ndarray, np.ndarray]:
    """(x, y) of pages with the same number of boxes, (pages, boxes, 4) whole numbers (centre x, y, size w, h) in order of elem_id; u: (pages, 3) draws of a place, x and y."""
    x, y, w, h = np.moveaxis(boxes, -1, 0)
    if strategy == "random":
        return np.floor(u[:, 1] * page_w).astype(np.int64), np.floor(u[:, 2] * page_h).astype(np.int64)
    if strategy == "bridge":
        return _bridge(x, y, page_w, page_h)
    if strategy not in ("anchor", "content"):
        raise ValueError(f"unknown strategy {strategy}")
    corners = [np.rint(c + s * d / 2.0).astype(np.int64) for c, d, s in ((x, w, -1), (y, h, -1), (x, w, 1), (y, h, 1))]
    if strategy == "content":
        return pick(_clipped(*corners, page_w, page_h), None, u[:, 0], page_w, page_h)
    grown, deep = ([c + s * d for c, s in zip(corners, (-1, -1, 1, 1), strict=True)] for d in (5, -5))
    return pick(_clipped(*grown, page_w, page_h), _clipped(*deep, page_w, page_h), u[:, 0], page_w, page_h)


def with_targets(pages: DataFrame, page_w: int, page_h: int, seed: str = "42") -> DataFrame:
    """``pages(page_id, target_strategy, boxes, ...)`` with the place (x, y) that ``planning.targets`` gives its page and strategy.

    ``boxes`` is an array of structs with whole x, y, w, h, in order of elem_id.
    """
    draws = F.array(*[hash_uniform(F.lit(seed), F.col("page_id").cast("string"), F.lit(name)) for name in ("place", "x", "y")])
    schema = StructType([*pages.schema.fields, StructField("x", LongType()), StructField("y", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, draw = batch.column("boxes"), batch.column("_draws")
            start, flat = lists.offsets.to_numpy(), lists.values
            values = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y", "w", "h")], 1) if len(flat) else np.zeros((0, 4), np.int64)
            u = draw.flatten().to_numpy().reshape(-1, 3)
            size = np.diff(start)
            kinds = batch.column("target_strategy").dictionary_encode()
            kind, names = kinds.indices.to_numpy(), kinds.dictionary.to_pylist()
            x, y = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            group = kind.astype(np.int64) << 32 | size
            order = np.argsort(group, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
                n = size[rows[0]]
                step = GRID_PAGES if n <= GRID_BOXES else 1
                for part in (rows[i : i + step] for i in range(0, len(rows), step)):
                    x[part], y[part] = place(names[kind[part[0]]], values[start[part][:, None] + np.arange(n)], u[part], page_w, page_h)
            columns = [batch.column(f.name) for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(x), pa.array(y)], names=[f.name for f in schema.fields])

    return pages.withColumn("_draws", draws).mapInArrow(run, schema)
