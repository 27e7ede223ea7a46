"""Box arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def centre_box(x: Column, y: Column, w: Column, h: Column) -> Box:
    return x - w / 2.0, y - h / 2.0, x + w / 2.0, y + h / 2.0


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))


def box_iou(a: Box, b: Box) -> Column:
    """Intersection over union of corner boxes, 0 where the union is empty."""
    inter = intersection(a, b)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, F.try_divide(inter, union)).otherwise(F.lit(0.0))


def corners(bbox: Column) -> Box:
    return tuple(F.try_element_at(bbox, F.lit(i)).cast("double") for i in (1, 2, 3, 4))


def area(bbox: Column) -> Column:
    """Area of an array box; null, short and inverted boxes have none."""
    b = corners(bbox)
    return F.coalesce(F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1]), F.lit(0.0))


def shared_area(p: Column, q: Column) -> Column:
    whole = (area(p) > 0) & (area(q) > 0)
    return F.when(whole, F.coalesce(intersection(corners(p), corners(q)), F.lit(0.0))).otherwise(F.lit(0.0))


def array_iou(p: Column, q: Column) -> Column:
    inter = shared_area(p, q)
    return F.coalesce(F.try_divide(inter, area(p) + area(q) - inter), F.lit(0.0))


def overlap_ratio(source: Column, other: Column) -> Column:
    return F.coalesce(F.try_divide(shared_area(source, other), area(source)), F.lit(0.0))


def is_non_overlap(evidence: Column, support: Column, most: float = 0.05, iou: float = 0.01) -> Column:
    """Both shares at most their limits."""
    return (overlap_ratio(evidence, support) <= most) & (array_iou(evidence, support) <= iou)


def in_non_overlap_subset(evidence: Column, support: Column, most: float = 0.05, iou: float = 0.01) -> Column:
    """A real evidence box for which either share is below its limit."""
    return (area(evidence) > 0) & ((overlap_ratio(evidence, support) < most) | (array_iou(evidence, support) < iou))


def normalize_bbox(bbox: Column) -> Column:
    """The first four numbers where they make a proper box, else null."""
    b = corners(bbox)
    good = (F.size(bbox) >= 4) & (b[2] > b[0]) & (b[3] > b[1])
    return F.when(F.coalesce(good, F.lit(False)), F.array(*b))


def as_corners(bbox: Column) -> Column:
    """Corner form of a box given as corners or as corner and size."""
    b = corners(bbox)
    return F.when((b[2] > b[0]) & (b[3] > b[1]), F.array(*b)).otherwise(F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]))


def bbox_fault(bbox: Column, width: Column, height: Column) -> Column:
    """Why a box is unusable on its page (null where it is fine); the page border has a tolerance of 2 %, at least 10."""
    b = corners(bbox)
    tol_x, tol_y = F.greatest(F.lit(10.0), width * 0.02), F.greatest(F.lit(10.0), height * 0.02)
    numbers = b[0].isNotNull() & b[1].isNotNull() & b[2].isNotNull() & b[3].isNotNull()
    return (
        F.when(F.coalesce(F.size(bbox), F.lit(0)) < 4, "bad_shape").when(~numbers, "non_numeric")
        .when((b[2] <= b[0]) | (b[3] <= b[1]), "bad_order")
        .when((b[0] < -tol_x) | (b[1] < -tol_y) | (b[2] > width + tol_x) | (b[3] > height + tol_y), "out_of_page")
    )


def rescale(width: Column, height: Column, long_edge: int = 1024) -> Column:
    """scale, new_w, new_h of a page brought to a long edge (half-even rounding)."""
    s = F.lit(float(long_edge)) / F.greatest(width, height)
    return F.struct(s.alias("scale"), F.bround(width * s).cast("int").alias("new_w"), F.bround(height * s).cast("int").alias("new_h"))


def gap(a: Box, b: Box) -> Column:
    """The free strip between two corner boxes: vertical if they overlap sideways, else horizontal, else null."""
    v = F.greatest(a[1], b[1]) - F.least(a[3], b[3])
    h = F.greatest(a[0], b[0]) - F.least(a[2], b[2])
    side = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    tall = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    mid = lambda lo, hi: F.floor((lo + hi) / 2)
    vertical = F.struct(v.alias("width"), F.lit("vertical").alias("direction"), mid(F.greatest(a[0], b[0]), F.least(a[2], b[2])).alias("cx"), mid(F.least(a[3], b[3]), F.greatest(a[1], b[1])).alias("cy"))
    level = F.struct(h.alias("width"), F.lit("horizontal").alias("direction"), mid(F.least(a[2], b[2]), F.greatest(a[0], b[0])).alias("cx"), mid(F.greatest(a[1], b[1]), F.least(a[3], b[3])).alias("cy"))
    return F.when((v > 0) & (side > 0), vertical).when((h > 0) & (tall > 0), level)


def touches_circle(x: Column, y: Column, w: Column, h: Column, cx: Column, cy: Column, r: Column) -> Column:
    """The circle reaches the element's box (half sizes rounded down)."""
    hw, hh = F.floor(w / 2), F.floor(h / 2)
    px, py = F.greatest(x - hw, F.least(cx, x + hw)), F.greatest(y - hh, F.least(cy, y + hh))
    return F.sqrt(F.pow(cx - px, F.lit(2.0)) + F.pow(cy - py, F.lit(2.0))) < r


def shifted_box(x: Column, y: Column, w: Column, h: Column, page_w: int, page_h: int) -> Box:
    """Integer box of an element on its page; a box clamped at the left or top keeps its size, as the pixel rules have it."""
    x1, y1 = F.greatest(F.lit(0), x - F.floor(w / 2)), F.greatest(F.lit(0), y - F.floor(h / 2))
    return x1, y1, F.least(F.lit(page_w), x1 + w), F.least(F.lit(page_h), y1 + h)
