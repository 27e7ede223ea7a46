"""Mixing sources to target weights by Poisson replication (operator 9), native columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name, staged

SEED = "mix-1"
#: A larger mean is drawn as a sum of equal Poisson draws, so that exp(-mean) keeps its precision.
MEAN_PER_DRAW = 256.0
ADDED = ("mix_copy", "mix_copies", "mix_key")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the joined parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(2.0**52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """Per source: characters, the mean number of copies of its documents, and the cumulative distribution to invert.

    ``weights`` are target shares of characters (a source without one gets
    none); by default the square root of each source's characters. A source
    whose texts are all empty has no share to fill and keeps its documents
    ``epochs`` times on average.
    """
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    stats = docs.groupBy("source").agg(F.sum(size).alias("chars"))
    if weights is None:
        wanted = F.sqrt(F.col("chars").cast("double"))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))])
        wanted = F.coalesce(F.try_element_at(given, F.col("source")), F.lit(0.0))
    stats = stats.withColumn("wanted", wanted)
    total = stats.agg(F.sum("chars").cast("double").alias("all_chars"), F.sum("wanted").alias("all_wanted"))
    stats = stats.crossJoin(F.broadcast(total))  # total is one row
    mean = F.when(F.col("chars") == 0, F.lit(float(epochs))).otherwise(F.lit(float(epochs)) * F.col("all_chars") * F.try_divide("wanted", "all_wanted") / F.when(F.col("chars") > 0, F.col("chars")))
    stats = stats.withColumn("mean", F.coalesce(mean, F.lit(0.0)))
    stats = stats.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("mean") / MEAN_PER_DRAW).cast("int")))
    stats = stats.withColumn("mu", F.col("mean") / F.col("draws"))
    last = F.ceil(F.col("mu") + 12 * F.sqrt("mu") + 20).cast("int")
    zero = F.exp(-F.col("mu"))
    start = F.struct(zero.alias("p"), zero.alias("c"), F.array(zero).alias("cdf"))

    def step(a: Column, k: Column) -> Column:
        p = a.p * F.col("mu") / k
        return F.struct(p.alias("p"), (a.c + p).alias("c"), F.concat(a.cdf, F.array(a.c + p)).alias("cdf"))

    return stats.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a.cdf)).select("source", "chars", "mean", "draws", "cdf")


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, epochs: float = 1.0, seed: str = SEED) -> DataFrame:
    """Every document of ``docs(doc_id, source, text, ...)`` as often as its Poisson draw says, in a global random order.

    The count inverts the Poisson distribution of the source's mean at a
    uniform number hashed from (seed, doc_id), so it depends on no partition
    and repeats after a lost executor. Adds ``mix_copy`` (0, 1, ...),
    ``mix_copies`` and the order's ``mix_key``; input columns of these names
    are replaced, all others kept. A null source is a source of its own, null
    text counts no characters, a row without doc_id draws by its text's hash,
    repeated rows draw alike, an empty table gives no rows, other columns may
    have any name. Rates are one row
    a source: written as a table, so the planner broadcasts them only under
    its size threshold and else joins by shuffle with skew splitting.
    """
    kept = docs.drop(*ADDED)
    at_source, at_draws, at_cdf = (own_name(kept, n) for n in ("mix_source", "mix_draws", "mix_cdf"))
    rates = staged(source_rates(kept, weights, epochs).select(F.col("source").alias(at_source), F.col("draws").alias(at_draws), F.col("cdf").alias(at_cdf)), "mix-rates")
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    joined = kept.join(rates, kept["source"].eqNullSafe(rates[at_source]))

    def drawn(j: Column) -> Column:
        u = uniform(F.lit(seed), key, j.cast("string"))
        return F.size(F.filter(at_cdf, lambda c: c <= u))

    copies = F.aggregate(F.sequence(F.lit(1), F.col(at_draws)), F.lit(0), lambda n, j: n + drawn(j))
    many = joined.withColumn("mix_copies", copies).filter(F.col("mix_copies") > 0).drop(at_source, at_draws, at_cdf)
    many = many.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    many = many.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), key, F.col("mix_copy").cast("string"))))
    return many.select(*kept.columns, *ADDED).orderBy("mix_key")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs)


ORACLE_OP9 = f"""
WITH stats AS (SELECT source, sum(length(coalesce(text, ''))) AS chars FROM documents GROUP BY source),
tot AS (SELECT sum(chars) AS all_chars, sum(sqrt(CAST(chars AS DOUBLE))) AS all_wanted FROM stats),
rate AS (SELECT source, CASE WHEN chars = 0 THEN 1.0 ELSE CAST(all_chars AS DOUBLE) * (sqrt(CAST(chars AS DOUBLE)) / all_wanted) / chars END AS mean FROM stats, tot),
mu AS (SELECT source, greatest(1, CAST(ceil(mean / 256) AS INTEGER)) AS draws, mean / greatest(1, CAST(ceil(mean / 256) AS INTEGER)) AS mu FROM rate),
term AS (SELECT source, mu, k, exp(-mu) * product(CASE WHEN k = 0 THEN 1 ELSE mu / k END) OVER (PARTITION BY source ORDER BY k) AS p
  FROM (SELECT source, mu, unnest(range(0, CAST(ceil(mu + 12 * sqrt(mu) + 20) AS BIGINT) + 1)) AS k FROM mu)),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM term) GROUP BY source),
doc AS (SELECT row_number() OVER () AS rn, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS id, doc_id, source, text FROM documents),
drawn AS (SELECT rn, cdf, CAST('0x' || substr(md5('{SEED}:' || id || ':' || j), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT rn, id, doc.source, unnest(range(1, draws + 1)) AS j FROM doc JOIN mu ON doc.source IS NOT DISTINCT FROM mu.source) d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source),
n AS (SELECT rn, CAST(sum(len(list_filter(cdf, lambda c: c <= u))) AS INTEGER) AS mix_copies FROM drawn GROUP BY rn),
cop AS (SELECT id, doc_id, source, text, CAST(unnest(range(0, mix_copies)) AS INTEGER) AS mix_copy, mix_copies FROM n JOIN doc USING (rn))
SELECT doc_id, source, text, mix_copy, mix_copies, md5('{SEED}:order:' || id || ':' || mix_copy) AS mix_key FROM cop
"""
