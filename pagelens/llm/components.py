"""Connected components by alternating star contraction, as shuffles over edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MAX_ROUNDS = 60


def _canonical(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with u > v."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    mark = F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.coalesce(mark, F.lit(0)).alias("m")).first()
    return row.n, row.m


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every node of ``edges(u, v)`` (longs); component is the least id reachable.

    Each round is written to the shared folder, so a lost executor costs one
    round. Nodes without an edge to another node don't appear; self-loops,
    repeated and reversed edges are allowed. A graph not settled after
    ``MAX_ROUNDS`` is an error.
    """
    now = staged(_canonical(edges), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS if state[0] else 0):
        now = staged(_canonical(_small_star(_canonical(_large_star(now)))), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
