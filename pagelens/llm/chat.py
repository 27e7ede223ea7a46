"""Chat formatting by columnar byte assembly (operator 3).

Template: each turn is ``### <role>: <text> </turn>`` and a newline. Inside
roles and texts a backslash, ``###`` and ``</turn>`` get a backslash in front
(in roles also ``:`` and the newline), so a text can't forge a marker and
unescaping restores it exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches

TRAINED_ROLE = "assistant"
OPEN, SPLIT, CLOSE = "### ", ": ", " </turn>\n"
#: A conversation longer than this is formatted in several parts, cut between turns.
PART_BYTES = 16 << 20

_formatted = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
FORMATTED = "conv_id long, part int, n_turns long, formatted string, loss_spans array<struct<start:long,`end`:long>>"


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    for mark in ("\\", "###", "</turn>", *((":", "\n") if role else ())):
        column = pc.replace_substring(column, mark, "\\" + mark)
    return column


_escaped = re.compile(r"\\(.)", re.S)


def unescape(s: str) -> str:
    return _escaped.sub(r"\1", s)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data bytes, starts and lengths of a large_string column without nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, step: int = 1 << 20) -> None:
    """Copy segment i of ``data`` to ``out[at[i]:]`` through index vectors, about ``step`` bytes at a time."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + step)))
        size = lengths[lo:hi]
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(at[lo:hi], size) + within] = data[np.repeat(starts[lo:hi], size) + within]
        lo = hi


def assemble(table: pa.Table, conv: np.ndarray, first_part: int) -> pa.RecordBatch:
    """Format whole runs of equal ``conv`` numbers of ``table(conv_id, role, text)`` into one preallocated buffer."""
    n = len(table)
    role = escape(pc.fill_null(table["role"], "").combine_chunks(), role=True)
    text = escape(pc.fill_null(table["text"], "").combine_chunks())
    fixed = [np.frombuffer(s.encode(), np.uint8) for s in (OPEN, SPLIT, CLOSE)]
    columns = [_bytes_of(role), _bytes_of(text)]
    zero = np.zeros(n, np.int64)
    segments = [(fixed[0], zero, zero + len(fixed[0])), columns[0], (fixed[1], zero, zero + len(fixed[1])), columns[1], (fixed[2], zero, zero + len(fixed[2]))]
    lengths = np.stack([s[2] for s in segments], 1)
    at = np.cumsum(lengths.ravel()).reshape(lengths.shape) - lengths
    total = int(lengths.sum())
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    for k, (data, starts, size) in enumerate(segments):
        _scatter(out, at[:, k], data, starts, size)
    first = np.flatnonzero(np.diff(conv, prepend=-1))
    offsets = np.append(at[first, 0], total).astype(np.int32)
    formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), buffer)
    chars = np.stack([zero + len(OPEN), pc.utf8_length(role).to_numpy(), zero + len(SPLIT), pc.utf8_length(text).to_numpy(), zero + len(CLOSE)], 1).astype(np.int64)
    begin = np.cumsum(chars.ravel()).reshape(chars.shape) - chars
    which = np.cumsum(np.diff(conv, prepend=-1) != 0) - 1
    trained = np.flatnonzero(pc.fill_null(pc.equal(table["role"], TRAINED_ROLE), False).combine_chunks().to_numpy(zero_copy_only=False))
    start = begin[trained, 3] - begin[first[which[trained]], 0]
    per = np.bincount(which[trained], minlength=len(first))
    spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per)), pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(start + chars[trained, 3])], names=["start", "end"]))
    parts = np.zeros(len(first), np.int32)
    parts[0] = first_part
    return pa.RecordBatch.from_arrays([table["conv_id"].combine_chunks().take(pa.array(first)), pa.array(parts), pa.array(np.diff(np.append(first, n)), pa.int64()), formatted, spans], schema=_formatted)


def _runs(ids: pa.Array) -> np.ndarray:
    """A running number for each run of equal ids; nulls equal each other."""
    filled, null = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), pc.is_null(ids).to_numpy(zero_copy_only=False)
    change = np.append(False, (filled[1:] != filled[:-1]) | (null[1:] != null[:-1])) if len(filled) else np.zeros(0, bool)
    return np.cumsum(change)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    part, open_id = 0, None  # the part that the next rows of an open conversation make
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        elif len(table) and part and table["conv_id"][0].as_py() != open_id:
            part = 0
        if not len(table):
            continue
        table = table.combine_chunks()
        conv = _runs(table["conv_id"].combine_chunks())
        cut = int(np.searchsorted(conv, conv[-1]))
        if cut:
            yield assemble(table.slice(0, cut), conv[:cut], part)
            part = 0
        held = table.slice(cut)
        if held.nbytes > PART_BYTES:
            yield assemble(held, conv[cut:] - conv[cut], part)
            part, open_id, held = part + 1, held["conv_id"][0].as_py(), None
    if held is not None:
        yield assemble(held, np.zeros(len(held), np.int64), part)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, part, n_turns, formatted, loss_spans.

    ``turns(conv_id, turn, role, text)`` are taken by turn; equal turns go by
    role, then text; a null turn comes first. Null role and text are empty.
    Repeated rows are repeated turns. Rows of a null conv_id form one
    conversation. An empty table gives no rows; other columns are ignored.
    ``loss_spans`` are code point ranges of ``formatted`` holding the escaped
    assistant texts. A conversation over ``PART_BYTES`` comes as parts 0, 1, ...
    cut between turns, so no task holds all of it.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return rows.mapInArrow(_format, FORMATTED)


_turn = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|(?! </turn>\n)[^\\])*) </turn>\n", re.S)
_digests = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _turn.finditer(formatted)]


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Turn and loss digests per conversation, read back from the formatted text and its mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def start(conv_id: int | None) -> dict:
            return {"conv_id": conv_id, "n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0}

        def done(x: dict) -> dict:
            return {k: v for k, v in x.items() if k not in ("turns", "loss")} | {"turns_sha256": x["turns"].hexdigest(), "loss_sha256": x["loss"].hexdigest()}

        now = None
        for batch in batches:
            rows = []
            for conv_id, part, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_spans")), strict=True):
                if now is None or part == 0:
                    rows += [done(now)] if now else []
                    now = start(conv_id)
                for role, said in parse(text):
                    now["n_turns"] += 1
                    now["turns"].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    now["loss_chars"] += len(said)
                    now["loss"].update(said.encode())
                now["formatted_chars"] += len(text)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_digests)
        if now:
            yield pa.RecordBatch.from_pylist([done(now)], schema=_digests)

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PLANTED = r"\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    return chat_digests(format_chats(turns.unionByName(planted)))


_esc = r"replace(replace(replace(coalesce(text, ''), '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"
ORACLE_OP3 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, text FROM conversations
  UNION ALL SELECT -7, t, r, '{PLANTED}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ' || role || ': ' || {_esc} || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""
