"""Near-duplicate embeddings in spherical k-means cells (operator 5).

Centroids are learned for each of the ``LENGTHS`` commonest vector lengths from
a bounded sample (``SAMPLE`` vectors by hash of their id); they only decide
where vectors meet, never whether they are linked. Vectors of a rarer length,
and those of a label with fewer than two cells' worth, meet in one cell for
their length and label.
A vector lives in its nearest cell and also visits every cell whose border is
within the link distance d = sqrt(2 - 2 * threshold): for unit vectors x in
cell c and y in cell c', x.(c - c') >= 0, so |x - y| <= d needs
y.c' - y.c <= d * |c - c'|. Hence each pair over the threshold meets in the
home cell of either end and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, staged
from .components import connected_components

THRESHOLD, SAMPLE, LENGTHS, VECTORS_PER_CELL, ROUNDS = 0.98, 20_000, 16, 8192, 8
#: Sampled vectors a centroid needs, and so the most cells of a length: SAMPLE / 16.
SAMPLED_PER_CELL = 16
#: Home vectors that a task compares at once, and vectors that pass them at a time.
BLOCK, PASSING = 4096, 512


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of unit rows ``x``; an empty cell takes the row worst served so far."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        cosine = x @ centroids.T
        cell, best = cosine.argmax(1), cosine.max(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        empty = np.flatnonzero(np.bincount(cell, minlength=k) == 0)
        sums[empty] = x[np.argsort(best, kind="stable")[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norm > 0, sums / np.where(norm > 0, norm, 1), centroids)
    return centroids


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


_assigned = pa.schema([("label", pa.string()), ("cell", pa.int32()), ("home", pa.bool_()), ("rep", pa.int64()), ("w", pa.int64()), ("unit", pa.binary())])


def _assign(classes: DataFrame, centroids: dict[int, np.ndarray], threshold: float) -> DataFrame:
    reach = (2 - 2 * threshold) ** 0.5 + 1e-9

    def place(unit: np.ndarray, large: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, cell, whether its home) of each cell that a vector lives in or visits."""
        centers = centroids.get(unit.shape[1]) if large else None
        if centers is None:
            return np.arange(len(unit)), np.zeros(len(unit), np.int64), np.ones(len(unit), bool)
        cosine = unit @ centers.T
        home = cosine.argmax(1)
        apart = np.sqrt(np.maximum(2 - 2 * centers[home] @ centers.T, 0))
        row, cell = np.nonzero(cosine[np.arange(len(unit)), home][:, None] - cosine <= reach * apart + 1e-7)
        return row, cell, cell == home[row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                some = whole.slice(at, 1024)
                lengths = some.column("embedding").value_lengths().to_numpy()
                large = some.column("large").to_numpy(zero_copy_only=False)
                for d, many in sorted(set(zip(lengths.tolist(), large.tolist(), strict=True))):
                    batch = some.take(pa.array(np.flatnonzero((lengths == d) & (large == many))))
                    unit = _unit(batch.column("embedding"))
                    row, cell, home = place(unit, many)
                    raw, take = pa.array([u.tobytes() for u in unit], pa.binary()), pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column("label").take(take), pa.array(cell, pa.int32()), pa.array(home), batch.column("rep").take(take), batch.column("w").take(take), raw.take(take)], schema=_assigned)

    within = F.concat_ws(":", F.size("embedding").cast("string"), "label").alias("label")  # vectors of different lengths never meet
    return classes.select(within, "rep", "w", "embedding", "large").mapInArrow(run, "label string, cell int, home boolean, rep long, w long, unit binary")


_linked = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])


class _Cell:
    """One block of home vectors against the streamed vectors of its cell: exact link counts, and a spanning set of edges."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.rep: list[int] = []
        self.unit: list[np.ndarray] = []
        self.ready = False

    def _prepare(self) -> None:
        self.reps, self.home = np.asarray(self.rep, np.int64), np.stack(self.unit) if self.unit else np.zeros((0, 1))
        self.links, self.root, self.ready = np.zeros(len(self.reps), np.int64), self.reps.copy(), True

    def meet(self, reps: np.ndarray, w: np.ndarray, unit: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            self._prepare()
        if not len(self.reps):
            return
        linked = (self.home @ unit.T >= self.threshold) & (self.reps[:, None] != reps[None])
        self.links += linked @ w
        rows, cols = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
        if not len(rows):
            return
        part, far = linked[np.ix_(rows, cols)], np.iinfo(np.int64).max
        root = self.root[rows]
        while True:
            col_root = np.minimum(np.where(part, root[:, None], far).min(0), reps[cols])
            new = np.minimum(root, np.where(part, col_root[None], far).min(1))
            if (new == root).all():
                break
            root = new
        old = self.root[rows]
        self.root[rows] = root
        u, v = np.concatenate([reps[cols], old, self.reps[rows]]), np.concatenate([col_root, root, root])
        keep = u != v
        if keep.any():
            none = pa.nulls(int(keep.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array(u[keep]), pa.array(v[keep])], schema=_linked)

    def counts(self) -> pa.RecordBatch:
        if not self.ready:
            self._prepare()
        none = pa.nulls(len(self.reps), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(self.reps), pa.array(self.links), none, none], schema=_linked)


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cell = None, None
        for whole in batches:
            names = whole.schema.names
            for at in range(0, whole.num_rows, PASSING):
                batch = whole.slice(at, PASSING)
                keys = list(zip(*(batch.column(names.index(c)).to_pylist() for c in ("label", "cell", "block", "role")), strict=True))
                reps, w = batch.column("rep").to_numpy(), batch.column("w").to_numpy()
                unit = [np.frombuffer(u, np.float64) for u in batch.column("unit").to_pylist()]
                lo = 0
                while lo < len(keys):
                    hi = lo + 1
                    while hi < len(keys) and keys[hi] == keys[lo]:
                        hi += 1
                    if keys[lo][:3] != key:
                        if cell is not None:
                            yield cell.counts()
                        key, cell = keys[lo][:3], _Cell(threshold)
                    if keys[lo][3] == 0:
                        cell.rep += reps[lo:hi].tolist()
                        cell.unit += unit[lo:hi]
                    else:
                        yield from cell.meet(reps[lo:hi], w[lo:hi], np.stack(unit[lo:hi]))
                    lo = hi
        if cell is not None:
            yield cell.counts()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Vectors of equal, non-null labels are linked at cosine >= ``threshold`` in
    double precision. Equal vectors of a label are one class with a weight, so
    a vector that many rows repeat is compared once. Vectors of different
    lengths have no cosine and are compared with their own length only. A
    vector that is null, empty, zero, or holds null or non-finite components
    links with nothing, nor does a row without id or label: its n_links is 0
    and it is its own component. Of a component the row with the
    least id is kept. Repeated ids are rows of one node. An empty table gives
    no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("string").alias("label"))
    finite = F.coalesce(F.forall("embedding", lambda x: F.coalesce((x > float("-inf")) & (x < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: x != 0.0), F.lit(False))
    usable = finite & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    vkey = F.when(usable, F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b")))  # 128 bits
    rows = rows.withColumn("vkey", vkey)
    classes = rows.filter(F.col("vkey").isNotNull()).groupBy("label", "vkey").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("w"), F.first("embedding").alias("embedding"))
    classes = staged(classes, "vector-classes")
    sizes = classes.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect()
    centroids = {}
    for r in sizes:
        if r["count"] >= 2 * VECTORS_PER_CELL:
            sample = classes.filter(F.size("embedding") == r.d).select("embedding", F.xxhash64("rep").alias("h"), "rep").orderBy("h", "rep").limit(SAMPLE).select("embedding").toArrow()["embedding"]
            k = min(r["count"] // VECTORS_PER_CELL, max(1, len(sample) // SAMPLED_PER_CELL))
            centroids[r.d] = spherical_kmeans(_unit(sample.combine_chunks()), k)
    crowds = classes.groupBy("label", F.size("embedding").alias("d")).agg((F.count(F.lit(1)) >= 2 * VECTORS_PER_CELL).alias("large"))
    sized = classes.withColumn("d", F.size("embedding")).join(crowds, ["label", "d"])
    placed = staged(_assign(sized, centroids, threshold), "vector-cells")
    blocks = placed.filter("home").groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    met = placed.join(blocks, ["label", "cell"])
    homes = met.filter("home").select("label", "cell", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("role"), "rep", "w", "unit")
    others = met.select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "rep", "w", "unit")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = homes.unionByName(others).repartition(n, "label", "cell", "block").sortWithinPartitions("label", "cell", "block", "role")
    found = staged(dealt.mapInArrow(_compare(threshold), "rep long, links long, u long, v long"), "vector-links")
    links = found.filter(F.col("rep").isNotNull()).groupBy("rep").agg(F.sum("links").alias("links"))
    component = staged(connected_components(found.filter(F.col("u").isNotNull()).select("u", "v")), "vector-components")
    known = classes.select(F.col("label").alias("_l"), F.col("vkey").alias("_k"), "rep", "w").join(links, "rep", "left").join(component.withColumnRenamed("id", "rep"), "rep", "left")
    out = rows.join(known, (F.col("label") == F.col("_l")) & (F.col("vkey") == F.col("_k")), "left")
    component_id = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("w") - 1, F.lit(0))).alias("n_links"), component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
