"""Event-time queries: the batch form of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import table
from ..streaming import events
from .layout import scratch
from .registry import query


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_seconds(F.col(c)) for c in columns})


@query("st05_tumbling", "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st05(spark: SparkSession, sf: str) -> DataFrame:
    return _ntz(events.tumbling(_events(spark, sf), "1 hour", "10 minutes", ["event_type"]), "start").withColumn("total", F.round("total", 4))


@query("st05_sliding", "WITH s AS (SELECT unnest(range(0, 4)) AS i), w AS (SELECT CAST(floor(epoch(ts) / 900) * 900 - i * 900 AS BIGINT) AS start, event_type FROM events, s) SELECT start, event_type, count(*) AS n FROM w GROUP BY ALL")
def st05_sliding(spark: SparkSession, sf: str) -> DataFrame:
    return _ntz(events.sliding(_events(spark, sf), "1 hour", "15 minutes", "10 minutes", ["event_type"]), "start")


@query("st05_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS o FROM events),
s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def st05_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _ntz(events.sessions(_events(spark, sf), "30 minutes", "10 minutes", ["user_id"]), "start").select("user_id", "start", "n")


@query("st03_stream_append", "SELECT event_id, event_type FROM events")
def st03(spark: SparkSession, sf: str) -> DataFrame:
    """The events written as JSON lines, tailed by a stream and appended once; a second run of the stream adds nothing."""
    source, sink = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    table(spark, sf, "events").select("event_id", "event_type").write.json(source)
    for run in ("a", "b"):
        stream = events.read_events(spark, source, "event_id long, event_type string")
        events.append_new(stream, sink, ["event_id"], f"{sink}-checkpoint-{run}").awaitTermination()
    return spark.read.parquet(sink).drop(events.BUCKET)
