"""The boundary to models and services: adapters, cached calls, retries, redacted logs.

Parsers, chat models and encoders aren't part of the engine. An adapter is a
callable per worker; recorded outputs stand in for it in replay.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SECRETS = ("api_key", "authorization")
_loaded: dict[str, Any] = {}


def retry_call(f: Callable[[], Any], retries: int = 2, sleep: float = 0.0, backoff: float = 1.0) -> Any:
    """``retries`` + 1 attempts, waits growing by ``backoff``; the last error is raised."""
    for attempt in range(retries + 1):
        try:
            return f()
        except Exception:  # the adapter's errors are its own
            if attempt == retries:
                raise
            time.sleep(sleep)
            sleep *= backoff


def run_adapter(pages: DataFrame, name: str, load: Callable[[], Callable[[dict], dict]], schema: str, retries: int = 2) -> DataFrame:
    """Apply a per-page model: loaded once per worker, a page that keeps failing gives its error in ``error_message``.

    ``schema`` is that of the adapter's result with page_id; status and
    error_message are added.
    """

    fields = pages.sparkSession.createDataFrame([], f"{schema}, parser_status string, error_message string").schema
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded[name] = load()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    out.append(retry_call(lambda row=row: _loaded[name](row), retries) | {"page_id": row["page_id"], "parser_status": "success", "error_message": ""})
                except Exception as e:  # becomes the page's record
                    out.append({"page_id": row["page_id"], "parser_status": "failed", "error_message": str(e)})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return pages.mapInArrow(run, fields)


def cache_key(**parts: Column) -> Column:
    """SHA-256 over the request's parts in the order given."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()])), 256)


def call_or_cache(requests: DataFrame, cache: DataFrame, key: str, call: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(responses of all requests, new cache rows): known keys come from the cache, each unknown one is called once."""
    missing = requests.join(cache.select(key), key, "left_anti").dropDuplicates([key])
    fresh = call(missing)
    known = cache.unionByName(fresh.select(*cache.columns))
    return requests.join(known, key, "left"), fresh


def answer_route(parser_status: Column, page_text: Column, done: Column, most: int = 8000) -> Column:
    """What becomes of a page's questions: answered without a call on empty or overlong pages, skipped where done, else asked."""
    return F.when(parser_status != "success", "parser_empty").when(F.coalesce(done, F.lit(False)), "skip").when(F.length(page_text) > most, "context_too_long").otherwise("api")


def redacted(log: DataFrame) -> DataFrame:
    """An event log without secrets, stamped."""
    rows = log.drop(*SECRETS)
    for f in rows.schema.fields:
        if f.dataType.typeName() == "struct":
            rows = rows.withColumn(f.name, F.col(f.name).dropFields(*[n for n in f.dataType.names if n in SECRETS] or ["_none"]) if any(n in SECRETS for n in f.dataType.names) else F.col(f.name))
    return rows.withColumn("logged_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))


def replay(plans: DataFrame, pages: DataFrame) -> DataFrame:
    """Recorded plans of pages; a page without one is skipped."""
    return pages.join(plans, "page_id")


def resumable(records: DataFrame, reuse: tuple[str, ...] = ("success",)) -> DataFrame:
    """Page ids whose record may be reused: complete, of a reusable status, and without a failed call among its answers."""
    whole = F.col("parser_status").isin(*reuse)
    if "answers" in records.columns:
        whole = whole & ~F.exists("answers", lambda a: a.status == "api_failed")
    return records.filter(F.coalesce(whole, F.lit(False))).select("page_id").distinct()


def policy(name: str, registry: dict[str, Callable[[DataFrame], DataFrame]], context: DataFrame, override: DataFrame | None = None) -> DataFrame:
    """Plans of a registered policy; pages that ``override(page_id, steps)`` has keep those instead."""
    plans = registry[name](context)
    if override is None:
        return plans
    return plans.join(override.withColumnRenamed("steps", "_own"), "page_id", "left").withColumn("steps", F.coalesce("_own", "steps")).drop("_own")
