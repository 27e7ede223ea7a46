"""Media columns over archives (operator 6).

Texts become PNG images (8-bit grey, 64 samples a row), stored as members of
ZIP archives in a shared folder. ``ArchiveSource`` is a Spark data source
that plans byte-range partitions over the archives: a member belongs to the
range its local header starts in. A task reads the archive's directory once,
then streams its members as Arrow batches, each read on its own by offset and
retried by itself.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import batched, bounded_batches, commit_file, file_system, shared_path, texts_of

ROW, RANGE_BYTES, MEMBER_TRIES, OUT_BYTES = 64, 32 << 20, 4, 4 << 20
MANIFEST = "_archives"
PNG = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """A grey PNG of ``ROW`` samples a row; ``n_bytes`` (without padding) goes into a text chunk."""
    grid = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(grid), ROW + 1), np.uint8)  # filter byte 0: rows as they are
    lines[:, 1:] = grid
    head = struct.pack(">IIBBBBB", ROW, len(grid), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\x00" + str(n_bytes).encode()) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[bytes, int]:
    """The payload and its unpadded length."""
    if data[:8] != PNG:
        raise ValueError("not a PNG")
    at, packed, n_bytes, height = 8, [], -1, 0
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(kind + body):
            raise OSError("PNG chunk checksum")
        if kind == b"IHDR":
            height = struct.unpack(">II", body[:8])[1]
        elif kind == b"tEXt" and body.startswith(b"bytes\x00"):
            n_bytes = int(body[6:])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, ROW + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes(), n_bytes


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + b"\0" * ((-len(raw)) % ROW if raw else ROW), len(raw)


def feature(payload: bytes) -> str:
    """Mean, deviation, entropy of the samples and mean step between neighbours, from exact integer sums."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256).astype(np.int64)
    n, level = int(counts.sum()), np.arange(256)
    mean = int((counts * level).sum()) / n
    dev = max(0.0, int((counts * level * level).sum()) / n - mean * mean) ** 0.5
    p = counts[counts > 0] / n
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    step = int(np.abs(np.diff(x)).sum()) / max(1, n - 1)
    return f"mean={mean:.4f};dev={dev:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f}"


class _Tell(io.RawIOBase):
    """What zipfile needs of an output that can't seek."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


def write_archives(docs: DataFrame, folder: str) -> DataFrame:
    """Store every row of ``docs(doc_id, text)`` as a member ``<doc_id or null>.<number>.png``; returns (archive, bytes, members).

    Null text is empty (64 zero bytes), repeated rows are repeated members, an
    empty table gives no archive; other columns are ignored. Members are
    written one by one, so a task holds one payload. An archive has a name of
    its own for each task attempt; only those of the returned table count.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = pa.schema([("archive", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        context = TaskContext.get()
        uri, made = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}.zip", {"members": 0}

        def fill(out) -> None:
            with zipfile.ZipFile(_Tell(out), "w", zipfile.ZIP_STORED, allowZip64=True) as z:
                batch = first
                while batch is not None:
                    for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                        name = f"{'null' if doc_id is None else doc_id}.{made['members']}.png"
                        z.writestr(zipfile.ZipInfo(name), encode_png(*payload_of(text)))
                        made["members"] += 1
                    batch = next(batches, None)
            made["bytes"] = out.tell()

        commit_file(uri, fill)
        yield pa.RecordBatch.from_pylist([{"archive": uri} | made], schema=schema)

    done = rows.mapInArrow(write, "archive string, bytes long, members long")
    done.write.parquet(f"{folder}/{MANIFEST}")
    return docs.sparkSession.read.schema(done.schema).parquet(f"{folder}/{MANIFEST}")


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


MEMBERS = "archive string, name string, header_offset long, media binary, error string"


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.tries = int(options.get("tries", MEMBER_TRIES))

    def partitions(self) -> list[Range]:
        """Byte ranges of the folder's archives, from their sizes alone; where the folder has a manifest, only of those it lists."""
        fs, path = file_system(self.folder)
        listed = None
        if fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.Directory:
            listed = {a.rsplit("/", 1)[-1] for a in pds.dataset(f"{path}/{MANIFEST}", filesystem=fs, format="parquet").to_table(["archive"])["archive"].to_pylist()}
        files = [f for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".zip") and (listed is None or f.base_name in listed)]
        found = [Range(f"{self.folder}/{f.base_name}", a, a + self.range_bytes) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, self.range_bytes)]
        return found or [Range("", 0, 0)]

    def member(self, uri: str, info: zipfile.ZipInfo) -> bytes:
        """One member's bytes by offset; a failed read or checksum reopens the archive and tries that member again."""
        for attempt in range(self.tries):
            try:
                fs, path = file_system(uri)
                with fs.open_input_file(path) as f:
                    return self._read(f, info)
            except (OSError, ValueError, struct.error):
                if attempt + 1 == self.tries:
                    raise
                time.sleep(0.05 * 2**attempt)
        raise OSError("no tries")

    @staticmethod
    def _read(f: pa.NativeFile, info: zipfile.ZipInfo) -> bytes:
        sizes = struct.unpack("<HH", f.read_at(4, info.header_offset + 26))
        data = f.read_at(info.compress_size, info.header_offset + 30 + sum(sizes))
        if len(data) != info.compress_size:
            raise OSError("short member")
        if info.compress_type == zipfile.ZIP_DEFLATED:
            data = zlib.decompress(data, -15)
        if zlib.crc32(data) != info.CRC:
            raise OSError("member checksum")
        return data

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        fs, path = file_system(partition.archive)
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            mine = [i for i in z.infolist() if partition.start <= i.header_offset < partition.end]
            rows, size = [], 0
            for info in sorted(mine, key=lambda i: i.header_offset):
                row = {"archive": partition.archive, "name": info.filename, "header_offset": info.header_offset, "media": None, "error": None}
                try:
                    row["media"] = self._read(f, info)
                except (OSError, ValueError, struct.error):
                    try:
                        row["media"] = self.member(partition.archive, info)
                    except (OSError, ValueError, struct.error) as e:
                        row["error"] = str(e)
                rows.append(row)
                size += info.file_size
                if size >= OUT_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_members)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_members)


_members = pa.schema([("archive", pa.string()), ("name", pa.string()), ("header_offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: one row per member of the folder's ZIP archives.

    A member that can't be read after its retries has a null ``media`` and its
    ``error``; the others of its archive are not affected. Options:
    ``rangeBytes`` and ``tries``.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in dict(self.options).items()})


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_features = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_features(members: DataFrame) -> DataFrame:
    """Digests and features of each stored image; an unreadable member fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for name, media, error in zip(*(batch.column(c).to_pylist() for c in ("name", "media", "error")), strict=True):
                    if media is None:
                        raise OSError(f"{name}: {error}")
                    payload, n_bytes = decode_png(media)
                    key = name.split(".")[0]
                    yield {"doc_id": None if key == "null" else int(key), "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(payload)}

        yield from batched(rows(), _features)

    return members.select("name", "media", "error").mapInArrow(run, FEATURES)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "media")
    write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    spark.dataSource.register(ArchiveSource)
    return media_features(spark.read.format("media_archive").load(folder))
