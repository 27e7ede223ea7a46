"""Literal cases and properties of scalar functions."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.functions import geometry as geo
from pagelens.functions import text as tx
from pagelens.operators.sampling import quotas


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def lcs_table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=30), st.text("abcé ", max_size=30))
def test_lcs_equals_table(a, b):
    assert tx.lcs_length(a, b) == lcs_table(a, b)


def test_similarity_edges():
    assert tx.similarity("", "x") == 0 and tx.similarity(" Ab ", "aB") == 1 and tx.similarity("abc", "axc") == 2 / 3


def test_cer_edges(spark):
    assert one(spark, tx.cer(F.lit(""), F.lit("abc")), tx.cer(F.lit("ab"), F.lit("abcdef")), tx.cer(F.lit("é"), F.lit("e"))) == (0.0, 2.0, 1.0)


def test_token_f1_edges(spark):
    a = lambda *t: F.array(*map(F.lit, t)).cast("array<string>")
    assert one(spark, tx.token_f1(a(), a()), tx.token_f1(a("x"), a()), tx.token_f1(a("x", "x", "y"), a("x", "z")), tx.token_f1(a("x", "z"), a("x", "x", "y"))) == (1.0, 0.0, 0.4, 0.4)


def test_normalisation_cases(spark):
    n = lambda s: tx.normalize_answer(F.lit(s))
    assert one(spark, n("1,000,000"), n("1,00"), n(" A  b. "), n(None)) == ("1000000", "100", "a b", "")
    assert one(spark, tx.plain_numbers(F.lit("1,00")), tx.contains_answer(F.lit("abc"), F.lit("")), tx.occurrences(F.lit("aaaa"), F.lit("aa"))) == ("1,00", False, 2)


def test_window_fold_case(spark):
    w = one(spark, tx.windows(F.lit("x" * 701), 700, 80), tx.windows(F.lit(""), 700, 80))
    assert [len(x) for x in w[0]] == [700, 81] and w[1] == [""]


def test_boxes(spark):
    box = lambda *v: F.array(*map(F.lit, map(float, v)))
    a, none = box(0, 0, 10, 10), F.lit(None).cast("array<double>")
    assert one(spark, geo.array_iou(a, a), geo.array_iou(a, none), geo.area(box(5, 5, 1, 1)), geo.in_non_overlap_subset(a, none), geo.in_non_overlap_subset(none, a)) == (1.0, 0.0, 0.0, True, False)
    assert one(spark, geo.as_corners(box(5, 5, 2, 3)), geo.as_corners(box(0, 0, 2, 3))) == ([5, 5, 7, 8], [0, 0, 2, 3])
    got = one(spark, geo.gap(geo.corners(box(0, 0, 10, 10)), geo.corners(box(2, 25, 8, 30))), geo.gap(geo.corners(box(0, 0, 10, 10)), geo.corners(box(30, 30, 40, 40))))
    assert (got[0].width, got[0].direction, got[1]) == (15.0, "vertical", None)


def test_quotas():
    assert quotas(20, {"simple": 0.145, "medium": 0.464, "complex": 0.391}) == {"simple": 3, "medium": 9, "complex": 8}
