"""Shared folders, batch limits and small column helpers of the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker; a longer single row still travels whole.
BATCH_BYTES = 8 << 20
_own_dir: list[str] = []


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where it is unset and the master local, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own_dir:
            _own_dir.append(tempfile.mkdtemp(prefix="pagelens-"))
        base = f"file://{_own_dir[0]}"
    return base.rstrip("/") if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts the lineage so that lost executors recompute nothing before this
    point, and gives later joins a size the planner knows.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so long texts don't multiply by a row count."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(100_000, plan_bytes(df) // bytes_each))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """An Arrow file system (local, HDFS, S3, GCS) and the path on it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def commit_file(uri: str, write) -> None:
    """Write a file under a temporary name and move it, so a retried or doubled task leaves one whole file."""
    fs, path = file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def own_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while f"_{name}".lower() in taken:
        name = f"_{name}"
    return f"_{name}"


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow string column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def batched(rows: Iterator[dict], schema: pa.Schema, limit: int = 2000) -> Iterator[pa.RecordBatch]:
    """Gather row dicts into record batches of at most ``limit`` rows."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
