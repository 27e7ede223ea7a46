"""Correlation, regression and rank statistics over groups, guarded for ANSI arithmetic."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_BUCKETS = 64


def finite(c: str) -> Column:
    """The number, or null for NaN and null."""
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def steady_mean(c: str) -> Column:
    """Mean of the finite numbers that no order of rows changes, so groups of equal sums tie.

    Numbers count in whole units of 1e-15, summed as two long parts; a group
    with numbers of 500 and more, or infinite ones, gets the plain mean.
    """
    v = finite(c)
    units = F.rint(F.when(F.abs(v) < 500, v) * 1e15).cast("long")
    high, low = F.sum(F.shiftright(units, 30)), F.sum(units.bitwiseAND(F.lit((1 << 30) - 1)))
    total = high.cast("decimal(19,0)") * F.lit(1 << 30).cast("decimal(10,0)") + low.cast("decimal(19,0)")
    return F.when(F.count(units) == F.count(v), F.try_divide(total.cast("double"), F.count(v) * 1e15)).otherwise(F.avg(v))


def pearson(df: DataFrame, x: str, y: str, by: list[str], least: int = 2) -> DataFrame:
    """n and r per group in one aggregation; null under ``least`` pairs or where a side is constant.

    The built-in correlation raises on a constant side under ANSI arithmetic,
    so r comes from the (stable) population covariance and deviations.
    """
    rows = df.select(*by, finite(x).alias("x"), finite(y).alias("y")).filter("x is not null and y is not null")
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), (F.stddev_pop("x") * F.stddev_pop("y")).alias("s"), ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("varied"))
    return out.select(*by, "n", F.when((F.col("n") >= least) & F.col("varied"), F.try_divide("c", "s")).alias("r"))


def average_rank(df: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """1-based ranks with ties at their mean.

    Values are counted first, then summed up within buckets between quantiles
    and over the buckets before, so no task orders a whole group.
    """
    bounds = df.agg(F.percentile_approx(value, [i / RANK_BUCKETS for i in range(1, RANK_BUCKETS)], 10_000).alias("_bounds"))
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(bounds))  # one row
    counts = counts.withColumn("_bucket", F.size(F.filter("_bounds", lambda b: b <= F.col(value)))).drop("_bounds")
    below = F.sum("_n").over(Window.partitionBy(*by, "_bucket").orderBy(value)) - F.col("_n")
    before = counts.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_m"))
    before = before.select(*by, "_bucket", (F.sum("_m").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_m")).alias("_before"))

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """The join on keys that may be null, with the left side's key columns."""
        right = right.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
        return left.join(right, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)])).drop(*(f"_r{i}" for i in range(len(keys))))

    counts = joined(counts.withColumn("_below", below), before, [*by, "_bucket"])
    ranked = counts.select(*by, value, (F.col("_before") + F.col("_below") + (F.col("_n") + 1) / 2.0).alias(name))
    return joined(df, ranked, [*by, value])


def spearman(df: DataFrame, x: str, y: str, by: list[str], least: int = 2) -> DataFrame:
    """Pearson correlation of average ranks, over pairs of numbers."""
    rows = df.select(*by, finite(x).alias("x"), finite(y).alias("y")).filter("x is not null and y is not null")
    return pearson(average_rank(average_rank(rows, "x", by, "rx"), "y", by, "ry"), "rx", "ry", by, least)


def r_squared(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """r2 of a straight line per group: null under three pairs, 0 for a constant y, and 0 for a constant x (the mean fits best)."""
    rows = df.select(*by, finite(x).alias("x"), finite(y).alias("y")).filter("x is not null and y is not null")
    r = pearson(rows, "x", "y", by)
    return r.select(*by, "n", F.when(F.col("n") >= 3, F.coalesce(F.col("r") * F.col("r"), F.lit(0.0))).alias("r2"))


def mean_of_ratios(df: DataFrame, numerator: str, denominator: str, by: list[str]) -> DataFrame:
    """Mean over rows of numerator / denominator where the denominator is positive."""
    ratio = F.when(F.col(denominator) > 0, F.try_divide(finite(numerator), finite(denominator)))
    return df.groupBy(*by).agg(F.avg(ratio).alias("efficiency"))


def summary(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, mean, median, min, max and population deviation, zeros where a group has no number."""
    v, zero = finite(value), F.lit(0.0)
    return df.groupBy(*by).agg(F.count(v).alias("n"), *(F.coalesce(f(v), zero).alias(n) for n, f in (("mean", F.avg), ("median", F.median), ("lo", F.min), ("hi", F.max), ("std", F.stddev_pop))))


def upper_median(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The upper of the middle values (an element of the group)."""
    middle = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")  # over counts of values, combined before the shuffle
    return df.groupBy(*by).agg(middle.cast(df.schema[value].dataType).alias("upper_median"))


def dense_grid(df: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """All combinations of the given dimension values, as rows to left-join aggregates on."""
    grid = None
    for name, options in values.items():
        side = df.sparkSession.createDataFrame([(o,) for o in options], f"{name} string")
        grid = side if grid is None else grid.crossJoin(F.broadcast(side))  # literal lists
    return grid


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) of several columns in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s"))
    return long.groupBy("s.field", "s.value").agg(F.count(F.lit(1)).alias("n"))


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, missing): nulls, blanks and ``unknown``."""
    gone = lambda c: F.col(c).isNull() | F.lower(F.trim(F.col(c).cast("string"))).isin("", "unknown")
    one = df.agg(*[F.count_if(gone(c)).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in columns])).alias("s")).select("s.*")
