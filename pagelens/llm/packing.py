"""Bounded-space online packing of token ids into fixed windows (operator 8)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, staged, texts_of
from .tokens import default_path, word_ids

WINDOW, OPEN_WINDOWS, FAN_IN, END_ID = 4096, 16, 16, 2
#: A window with at most this much room is emitted as it is; one with more is filled with the start of the next piece.
MAX_PAD = WINDOW // 128


class Piece(NamedTuple):
    """``length`` ids of a document from its ``start``-th, as little-endian bytes in ``ids``."""

    doc_id: int | None
    start: int
    length: int
    doc_tokens: int
    ids: bytes


class Window:
    __slots__ = ("used", "pieces")

    def __init__(self) -> None:
        self.used, self.pieces = 0, []

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += piece.length


def cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    doc_id, start, length, doc_tokens, ids = piece
    b = at * (len(ids) // length)
    return Piece(doc_id, start, at, doc_tokens, ids[:b]), Piece(doc_id, start + at, length - at, doc_tokens, ids[b:])


class Packer:
    """A fixed number of open windows: best fit, else emit the fullest.

    When no window has room, the fullest one is emitted; if its room exceeds
    ``max_pad`` the piece is cut to fill it first. Memory is ``open_windows``
    windows whatever the input.
    """

    def __init__(self, window: int, open_windows: int, max_pad: int):
        self.window, self.limit, self.max_pad = window, open_windows, max_pad
        self.open: list[Window] = []

    def add(self, piece: Piece) -> Iterator[Window]:
        if piece.length >= self.window:
            whole, width = piece.length - piece.length % self.window, len(piece.ids) // piece.length
            for at in range(0, whole, self.window):
                full = Window()
                full.put(Piece(piece.doc_id, piece.start + at, self.window, piece.doc_tokens, piece.ids[at * width : (at + self.window) * width]))
                yield full
            if whole == piece.length:
                return
            _, piece = cut(piece, whole)
        while piece.length:
            need = piece.length
            fit = max((w for w in self.open if w.used + need <= self.window), key=lambda w: w.used, default=None)
            if fit is None and len(self.open) < self.limit:
                fit = Window()
                self.open.append(fit)
            if fit is not None:
                fit.put(piece)
                if fit.used == self.window:
                    self.open.remove(fit)
                    yield fit
                return
            fullest = max(self.open, key=lambda w: w.used)
            if (room := self.window - fullest.used) > self.max_pad:
                head, piece = cut(piece, room)
                fullest.put(head)
            self.open.remove(fullest)
            yield fullest

    def rest(self) -> list[Window]:
        left, self.open = self.open, []
        return left


def power_of_two_parts(w: Window, largest: int) -> Iterator[Window]:
    """Cut a window into windows whose lengths are powers of two, so that none needs padding."""
    queue, left = list(w.pieces), w.used
    while left:
        size = min(largest, 1 << (left.bit_length() - 1))
        out, room = Window(), size
        while room:
            piece = queue.pop(0)
            if piece.length > room:
                piece, tail = cut(piece, room)
                queue.insert(0, tail)
            out.put(piece)
            room -= piece.length
        left -= size
        yield out


PIECES = "array<struct<doc_id:long,start:long,length:int,doc_tokens:long>>"
SEQUENCES = f"sequence_id long, is_open boolean, used int, input_ids binary, pieces {PIECES}"
_piece = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64())])
_pieces = pa.list_(_piece)
_sequences = pa.schema([("sequence_id", pa.int64()), ("is_open", pa.bool_()), ("used", pa.int32()), ("input_ids", pa.binary()), ("pieces", _pieces)])


class _Rows:
    """Windows gathered into columns, and record batches of at most ``limit`` windows made of them."""

    def __init__(self, limit: int = 256):
        self.limit = limit
        self._clear()

    def _clear(self) -> None:
        self.heads: list[tuple] = []
        self.pieces: list[Piece] = []
        self.ends = [0]

    def add(self, w: Window, sequence_id: int, is_open: bool) -> Iterator[pa.RecordBatch]:
        self.heads.append((sequence_id, is_open, w.used, b"".join([p.ids for p in w.pieces])))
        self.pieces += w.pieces
        self.ends.append(len(self.pieces))
        if len(self.heads) >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.heads:
            return
        columns = zip(*self.heads, strict=True)
        doc_id, start, length, doc_tokens, _ = zip(*self.pieces, strict=True)
        flat = [pa.array(c, f.type) for c, f in zip((doc_id, start, length, doc_tokens), _piece, strict=True)]
        lists = pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), pa.StructArray.from_arrays(flat, fields=list(_piece)))
        arrays = [pa.array(c, f.type) for c, f in zip(columns, _sequences, strict=False)]
        self._clear()
        yield pa.RecordBatch.from_arrays([*arrays, lists.cast(_pieces)], schema=_sequences)


def _windows(batch: pa.RecordBatch, width: int) -> Iterator[Window]:
    lists = batch.column("pieces")
    doc_id, start, length, doc_tokens = (c.to_pylist() for c in lists.flatten().flatten())
    lo = 0
    for raw, n in zip(batch.column("input_ids").to_pylist(), lists.value_lengths().to_pylist(), strict=True):
        at, w = 0, Window()
        for i in range(lo, lo + n):
            b = at + length[i] * width
            w.put(Piece(doc_id[i], start[i], length[i], doc_tokens[i], raw[at:b]))
            at = b
        lo += n
        yield w


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, fan_in: int = FAN_IN, max_pad: int = MAX_PAD, end_id: int = END_ID) -> DataFrame:
    """Pack ``docs(doc_id, text)`` into sequences (sequence_id, used, input_ids, pieces).

    One pass without a shuffle: each input partition streams its documents
    through a :class:`Packer`. The at most ``open_windows`` windows a partition
    leaves are merged by ``fan_in`` partitions at a time: largest first into a
    packer again, and what then remains is joined and cut at powers of two,
    which need no padding. Ids are little-endian, two bytes where the
    vocabulary allows, else four.

    Null text is the empty document (only its end id), a null doc_id stays
    null, repeated rows are packed each, a text longer than the window is cut,
    an empty table gives no sequence; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, packer, rows_out = word_ids(tokenizer), Packer(window, open_windows, max_pad), _Rows()
        end, width = np.asarray([end_id], coder.dtype).tobytes(), coder.dtype.itemsize
        n = TaskContext.get().partitionId() << 36
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids = coder.encode(text) + end
                tokens = len(ids) // width
                for w in packer.add(Piece(doc_id, 0, tokens, tokens, ids)):
                    yield from rows_out.add(w, n, False)
                    n += 1
        for w in packer.rest():
            yield from rows_out.add(w, n, True)
            n += 1
        yield from rows_out.flush()

    first = staged(rows.mapInArrow(pack, SEQUENCES), "packed")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = word_ids(tokenizer).dtype.itemsize
        rows_out = _Rows()

        def numbered(held: list[Window]) -> Iterator[Window]:
            packer = Packer(window, open_windows, max_pad)
            for w in sorted(held, key=lambda w: -w.used):
                for p in w.pieces:
                    yield from packer.add(p)
            last = Window()
            for w in sorted(packer.rest(), key=lambda w: -w.used):
                for p in w.pieces:
                    while last.used + p.length >= window:
                        room = window - last.used
                        if room < p.length:
                            head, p = cut(p, room)
                        else:
                            head, p = p, None
                        last.put(head)
                        yield last
                        last = Window()
                        if p is None:
                            break
                    if p is not None:
                        last.put(p)
            yield from power_of_two_parts(last, window)

        def flush(held: list[Window], group: int) -> Iterator[pa.RecordBatch]:
            for n, w in enumerate(numbered(held), (1 << 62) + (group << 36)):
                yield from rows_out.add(w, n, False)

        group, held = None, []
        for batch in batches:
            for at, w in zip(batch.column("sequence_id").to_pylist(), _windows(batch, width), strict=True):
                mine = (at >> 36) // fan_in
                if group is not None and mine != group:
                    yield from flush(held, group)
                    held = []
                group = mine
                held.append(w)
        if held:
            yield from flush(held, group)
        yield from rows_out.flush()

    left = first.filter("is_open").withColumn("g", F.floor(F.shiftright("sequence_id", 36) / fan_in))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    left = left.repartition(n, "g").sortWithinPartitions("g", "sequence_id").drop("g")
    merged = left.mapInArrow(merge, SEQUENCES)
    return first.filter(~F.col("is_open")).unionByName(merged).drop("is_open")


PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"


def piece_digests(sequences: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece, read back from the packed ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = word_ids(tokenizer).dtype
        for batch in batches:
            lists = batch.column("pieces")
            doc_id, start, length, doc_tokens = lists.flatten().flatten()
            each, lengths = lists.value_lengths().to_numpy(), length.to_numpy().astype(np.int64)
            crc, offset, lo = [], [], 0
            for raw, n in zip(batch.column("input_ids").to_pylist(), each.tolist(), strict=True):
                wide, at = memoryview(np.frombuffer(raw, dtype).astype("<u4").tobytes()), 0
                for size in lengths[lo : lo + n].tolist():
                    crc.append(zlib.crc32(wide[4 * at : 4 * (at + size)]))
                    offset.append(at)
                    at += size
                lo += n
            sequence_id = np.repeat(batch.column("sequence_id").to_numpy(), each)
            yield pa.RecordBatch.from_arrays([doc_id, start, pa.array(lengths), pa.array(crc, pa.int64()), doc_tokens, pa.array(sequence_id), pa.array(offset, pa.int64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return sequences.select("sequence_id", "input_ids", "pieces").mapInArrow(read, PLACED)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path("word_bpe_49k.json")
    return piece_digests(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
