"""Structured Streaming forms, an extension beyond batch use: windows over events, resumed appends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: The sink's partition column and how many parts it has.
BUCKET, BUCKETS = "key_bucket", 256


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """Tail a directory of JSON-lines files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def tumbling(events: DataFrame, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts and means per event-time window and key; events later than ``late`` are dropped by the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str, by: list[str]) -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width, step), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, late: str, by: list[str]) -> DataFrame:
    """Bursts of a key's events with no pause over ``gap``."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def append_new(stream: DataFrame, sink: str, keys: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append rows whose keys the sink doesn't hold; a replayed batch adds nothing.

    The sink is partitioned by ``BUCKET``, a hash of the keys in ``BUCKETS``
    parts, and a batch looks for its keys only in the parts it falls into.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark, rows = df.sparkSession, transform(df).dropDuplicates(keys)
        from ..sources.files import exists

        rows = rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        if exists(spark, f"{sink}/_SUCCESS"):
            touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]  # at most BUCKETS numbers
            known = spark.read.parquet(sink).filter(F.col(BUCKET).isin(touched)).select(*keys)
            rows = rows.join(known, keys, "left_anti")
        rows.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(sink)  # one file a part

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
