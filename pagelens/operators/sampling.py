"""Deterministic sampling: the order is the md5 of (seed, id), so any engine and any partitioning draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def random_sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows without replacement (all if there are fewer): a top-n, not a full sort."""
    return df.withColumn("_h", hash_order(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def quotas(n: int, shares: dict[str, float]) -> dict[str, int]:
    """Largest-remainder allocation; ties go to the larger share, then the earlier name."""
    total = sum(shares.values()) or 1.0
    raw = {k: n * v / total for k, v in shares.items()}
    out = {k: int(v) for k, v in raw.items()}
    names = list(shares)
    for k in sorted(names, key=lambda k: (-(raw[k] - out[k]), -raw[k], names.index(k)))[: n - sum(out.values())]:
        out[k] += 1
    return out


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, shares: dict[str, float], seed: str) -> DataFrame:
    """Quota rows of each stratum by hash order; what short strata leave open is filled from all other rows.

    No row beyond a stratum's first ``n`` can be drawn, so each input partition
    passes on that many at most; the refill is one global top-n.
    """
    quota = quotas(n, shares)
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col(stratum)), F.lit(0))
    w = Window.partitionBy(stratum).orderBy("_h", key)
    ranked = df.withColumn("_h", hash_order(seed, key)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).withColumn("_in", (F.col("_r") <= limit).cast("int"))
    return ranked.orderBy(F.desc("_in"), "_h", key).limit(n).drop("_h", "_r", "_in")


def level_sample(df: DataFrame, key: str, level: str, n: int, shares: dict[str, float], seed: str) -> DataFrame:
    """Rounded shares per level, the last one taking the rest; a short level gives all it has and isn't refilled."""
    names = list(shares)
    counts = {k: round(n * shares[k]) for k in names[:-1]}
    counts[names[-1]] = n - sum(counts.values())
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col(level)), F.lit(0))
    w = Window.partitionBy(level).orderBy(hash_order(seed, key), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(counts.values())).filter(F.col("_r") <= limit).drop("_r")


def complexity(n: Column, entropy: Column) -> Column:
    return F.when((n <= 8) & (entropy < 1.5), "simple").when((n > 18) | (entropy >= 2.5), "complex").otherwise("medium")


def first_per_group(df: DataFrame, by: list[str], order: list[str], n: int = 1) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= n).drop("_n")


def last_per_key(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def diverse_first(df: DataFrame, group: str, kind: str, pos: str, n: int = 4) -> DataFrame:
    """The first row of each kind in order, then the remaining rows in order, up to ``n``."""
    nth = F.row_number().over(Window.partitionBy(group, kind).orderBy(pos))
    rows = df.withColumn("_k", (nth > 1).cast("int"))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy("_k", pos))).filter(F.col("_n") <= n).drop("_k", "_n")


def dedupe_candidates(df: DataFrame, key: str, second_key: str, pos: str, fault: Column) -> DataFrame:
    """Sound rows only (``fault`` null), the first by ``key``, then of those the first by ``second_key``."""
    sound = first_per_group(df.filter(fault.isNull()), [key], [pos])
    return first_per_group(sound, [second_key], [pos])
