"""Token-id output as sorted-string-table shards (operator 1).

File layout, all integers little-endian or LEB128 varints::

    data block*   entries (shared, unshared, value length, key suffix, value),
                  u32 restart offsets, u32 restart count, u32 crc32
    index block   per data block: last key, offset, length   (sparse index)
    bloom block   u32 bit count, u32 hash count, bits
    footer        index offset/length, bloom offset/length, entries, ids,
                  id width, magic

A key is the order-preserving 8-byte form of the document's identifier; a null
identifier is the empty key and sorts first. Keys may repeat. A value is the
document's ids, ``id width`` bytes each. Shards hold disjoint, ascending key
ranges, so a point lookup picks the shard by the manifest's key range, asks its
Bloom filter, finds the block by binary search in the index and the entry by
binary search over the block's restart points.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batched, bounded_batches, commit_file, file_system, partitions_for, shared_path, staged, texts_of
from .tokens import default_path, word_ids

MAGIC = 0x31424C5453474150
BLOCK_BYTES, RESTART_EVERY = 64 << 10, 16
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQIQ")
END_ID = 2


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_hashes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit mixes of u64 keys (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        z = keys + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        return z, (z * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def _bloom_key(key: bytes) -> int:
    return struct.unpack(">Q", key)[0] if key else zlib.crc32(b"null")


def bloom_positions(keys: np.ndarray, bits: int) -> np.ndarray:
    a, b = _bloom_hashes(keys)
    with np.errstate(over="ignore"):
        return (a[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class Writer:
    """Streams ascending (key, value) entries into one shard; holds one block, the index and 8 bytes a key."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[int] = []
        self.ids, self.last, self.first = 0, b"", None
        self._open()

    def _open(self) -> None:
        self.block, self.restarts, self.n = bytearray(), [], 0

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.n % RESTART_EVERY == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.first = key if self.first is None else self.first
        self.n, self.last, self.ids = self.n + 1, key, self.ids + len(value) // self.width
        self.keys.append(_bloom_key(key))
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _write(self, data: bytes) -> tuple[int, int]:
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at, len(data)

    def _close_block(self) -> None:
        if self.n:
            self.block += struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            self.block += struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.last, *self._write(bytes(self.block))))
        self._open()

    def close(self) -> None:
        self._close_block()
        index = self._write(b"".join(varint(len(k)) + k + varint(a) + varint(n) for k, a, n in self.index))
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys))
        flags = np.zeros(bits, bool)
        keys = np.asarray(self.keys, np.uint64)
        for i in range(0, len(keys), 1 << 16):
            flags[bloom_positions(keys[i : i + (1 << 16)], bits).ravel()] = True
        bloom = self._write(struct.pack("<II", bits, BLOOM_HASHES) + np.packbits(flags, bitorder="little").tobytes())
        self.out.write(FOOTER.pack(*index, *bloom, len(self.keys), self.ids, self.width, MAGIC))


class Reader:
    """Reads one shard block by block; ``lookup`` touches footer, filter, index and one run of blocks."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        io, il, bo, bl, self.entries, self.ids, self.width, magic = FOOTER.unpack(self.f.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        raw, at, self.index = self.f.read_at(il, io), 0, []
        while at < len(raw):
            k, at = read_varint(raw, at)
            key, at = raw[at : at + k], at + k
            off, at = read_varint(raw, at)
            n, at = read_varint(raw, at)
            self.index.append((key, off, n))
        self.bloom_at = bo, bl
        self.bloom: bytes | None = None

    def close(self) -> None:
        self.f.close()

    def _block(self, off: int, n: int) -> tuple[bytes, list[int]]:
        data = self.f.read_at(n, off)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise OSError("block checksum")
        count = struct.unpack("<I", data[-8:-4])[0]
        restarts = list(struct.unpack(f"<{count}I", data[-8 - 4 * count : -8]))
        return data[: -8 - 4 * count], restarts

    @staticmethod
    def _entries(block: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < len(block):
            shared, at = read_varint(block, at)
            fresh, at = read_varint(block, at)
            n, at = read_varint(block, at)
            key = key[:shared] + block[at : at + fresh]
            at += fresh
            yield key, block[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for _, off, n in self.index:
            yield from self._entries(self._block(off, n)[0])

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = self.f.read_at(self.bloom_at[1], self.bloom_at[0])
        bits = struct.unpack_from("<I", self.bloom)[0]
        at = bloom_positions(np.asarray([_bloom_key(key)], np.uint64), bits)[0].tolist()
        return all(self.bloom[8 + p // 8] >> (p % 8) & 1 for p in at)

    def lookup(self, key: bytes) -> list[bytes]:
        """Values of all entries with this key."""
        found: list[bytes] = []
        if not self.may_hold(key):
            return found
        for b in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            block, restarts = self._block(*self.index[b][1:])
            start = bisect_left(restarts, key, key=lambda r: next(self._entries(block, r))[0])
            for k, v in self._entries(block, restarts[max(0, start - 1)]):
                if k == key:
                    found.append(v)
                elif k > key:
                    return found
        return found


MANIFEST = "shard string, partition int, first_key binary, last_key binary, first_id long, n_docs long, n_ids long, width int"


def write_sstables(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_bytes: int = 128 << 20) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write shards under ``path`` in ascending doc_id order; returns the manifest.

    Rows are range-partitioned on (doc_id, hash of text), so repeated ids split
    and each task streams one sorted shard. Null text is the empty document
    (its value is just ``end_id``), a null doc_id is the empty key, repeated
    rows give repeated entries in hash-then-text order, an empty table gives an
    empty manifest; other columns are ignored. A retried task rewrites its
    shard under the same name by an atomic move.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions_for(rows, shard_bytes)
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "h")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", F.col("text").asc_nulls_first()).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, coder = TaskContext.get().partitionId(), word_ids(tokenizer)
        end = np.asarray([end_id], coder.dtype).tobytes()
        batches = iter(batches)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        uri, made = f"{path}/shard-{part:06d}.sst", {}

        def fill(out) -> None:
            w = Writer(out, coder.dtype.itemsize)
            batch = first
            while batch is not None:
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                    w.add(key_of(doc_id), coder.encode(text) + end)
                batch = next(batches, None)
            w.close()
            made.update(first_key=w.first, last_key=w.last, first_id=id_of(w.first), n_docs=len(w.keys), n_ids=w.ids, width=w.width)

        commit_file(uri, fill)
        yield pa.RecordBatch.from_pylist([{"shard": uri, "partition": part} | made], schema=_manifest_arrow())

    return staged(rows.mapInArrow(write, MANIFEST), "sst-manifest")


def _manifest_arrow() -> pa.Schema:
    return pa.schema([("shard", pa.string()), ("partition", pa.int32()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())])


READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long, position long"


def read_sstables(manifest: DataFrame) -> DataFrame:
    """One row per entry of the shards: doc_id, start (ids before it over all shards), n_tokens, crc32 of its ids as u32, position in its shard."""
    w = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("shard", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for batch in batches:
                for shard, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    r = Reader(shard)
                    kind = np.dtype(f"<u{r.width}")
                    for i, (key, value) in enumerate(r.scan()):
                        ids = np.frombuffer(value, kind)
                        yield {"doc_id": id_of(key), "start": before, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()), "position": i}
                        before += len(ids)
                    r.close()

        yield from batched(rows(), pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32", "position")]))

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(n, "shard").mapInArrow(read, READ_BACK)


def lookup(manifest: DataFrame, doc_id: int | None) -> list[np.ndarray]:
    """Ids of every document with this identifier, reading only shards whose key range and filter admit it."""
    key = key_of(doc_id)
    hits = manifest.filter((F.col("first_key") <= F.lit(key)) & (F.col("last_key") >= F.lit(key))).orderBy("partition")
    out = []
    for row in hits.select("shard").collect():
        r = Reader(row.shard)
        out += [np.frombuffer(v, np.dtype(f"<u{r.width}")) for v in r.lookup(key)]
        r.close()
    return out


def op1_sstable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_sstables(docs, shared_path(spark, "sst"), default_path("word_bpe_49k.json"))
    return read_sstables(manifest).drop("position")
