"""Token counts without token ids (operator 10).

1. One pass cuts every text into pre-tokens. A block of documents keeps its
   distinct pre-tokens once, and per document (pre-token, frequency) vectors
   in a file of the shared folder.
2. The blocks' distinct pre-tokens are dealt by hash into buckets; a bucket
   counts the pieces of each distinct pre-token once for the whole corpus
   and answers each block with counts.
3. Per block, counts are joined to the documents' vectors and summed.

Only distinct pre-tokens and their counts are shuffled, at most one per block
and pre-token, so a word that every document holds costs one entry a block.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batched, bounded_batches, commit_file, file_system, partitions_for, shared_path, staged, texts_of
from .tokens import _ranges, byte_alphabet, default_path

BLOCK_WORDS, BLOCK_CHARS, LIMIT = 250_000, 24 << 20, 1024
_loaded: dict[str, ByteLevel] = {}


class ByteLevel:
    """Pre-tokens and piece counts of a byte-level BPE tokenizers file with its usual split pattern."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space")) != ("ByteLevel", True, False):
            raise ValueError("not a plain byte-level file")
        self.tokenize = Tokenizer.from_file(path).model.tokenize
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        head = "'s|'t|'re|'ve|'m|'ll|'d"
        let, num, space = _ranges("L"), _ranges("N"), "\x09-\x0d\x20\x85\xa0"
        #: The file's split pattern, spelled out for Latin text and in full.
        self.latin = re.compile(f"{head}| ?[{let}]+| ?[{num}]+| ?[^{space}{let}{num}]+|[{space}]+(?![^{space}])|[{space}]+").findall
        self.any = regex.compile(rf"{head}| ?\p{{L}}+| ?\p{{N}}+| ?[^\p{{White_Space}}\p{{L}}\p{{N}}]+|\p{{White_Space}}+(?!\P{{White_Space}})|\p{{White_Space}}+").findall
        self.beyond = re.compile("[^\x00-ſ]").search
        alphabet = byte_alphabet()
        self.shown = {ord(c): alphabet[b] for b in range(256) for c in (chr(b),)}

    def words(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many added tokens it holds."""
        cut = self.any if self.beyond(text) else self.latin
        if self.added is None or not self.added.search(text):
            return cut(text), 0
        parts = self.added.split(text)
        return [w for p in parts for w in cut(p)], len(parts) - 1

    def pieces(self, word: str) -> int:
        return len(self.tokenize(word.encode().decode("latin-1").translate(self.shown)))


def byte_level(path: str) -> ByteLevel:
    if path not in _loaded:
        _loaded[path] = ByteLevel(path)
    return _loaded[path]


def _pack_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    return zlib.compress(np.asarray([len(r) for r in raw], "<u4").tobytes() + b"".join(raw), 1)


def _unpack_words(data: bytes, n: int) -> Iterator[str]:
    raw = zlib.decompress(data)
    at = 4 * n
    for size in np.frombuffer(raw, "<u4", n).tolist():
        yield raw[at : at + size].decode()
        at += size


_asked = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])
_told = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("counts", pa.binary())])
_counted = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


class _Block:
    def __init__(self) -> None:
        self.ids: dict[str, int] = {}
        self.docs: list[tuple[int | None, int, int]] = []
        self.at: list[int] = [0]
        self.index: list[np.ndarray] = []
        self.freq: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str, coder: ByteLevel) -> None:
        words, added = coder.words(text)
        seen, ids = Counter(words), self.ids
        self.index.append(np.fromiter((ids.setdefault(w, len(ids)) for w in seen), "<u4", len(seen)))
        self.freq.append(np.fromiter(seen.values(), "<u4", len(seen)))
        self.docs.append((doc_id, len(text.encode()), added))
        self.at.append(self.at[-1] + len(seen))
        self.chars += len(text)

    def save(self, folder: str, buckets: int) -> Iterator[dict]:
        """Write the vectors, with words renumbered bucket by bucket, and ask each bucket for its words' counts."""
        words = list(self.ids)
        bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        new = np.empty(len(words), "<u4")
        new[order] = np.arange(len(words), dtype="<u4")
        uri = f"{folder}/{uuid.uuid4().hex}"
        index = new[np.concatenate(self.index)] if words else np.zeros(0, "<u4")
        table = pa.table({"doc_id": pa.array([d[0] for d in self.docs], pa.int64()), "n_bytes": pa.array([d[1] for d in self.docs], pa.int64()), "added": pa.array([d[2] for d in self.docs], pa.int64()), "at": pa.array(self.at[:-1], pa.int64())})
        vectors = pa.table({"index": pa.array(index, pa.uint32()), "freq": pa.array(np.concatenate(self.freq) if words else np.zeros(0, "<u4"), pa.uint32())})

        def write(out) -> None:
            for t in (table, vectors):
                with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(t)

        commit_file(uri, write)
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            mine = order[bounds[b] : bounds[b + 1]].tolist()
            if mine or b == 0:
                yield {"block": uri, "bucket": b, "n": len(mine), "words": _pack_words([words[i] for i in mine])}


def _load(uri: str) -> tuple[pa.Table, pa.Table]:
    fs, path = file_system(uri)
    with fs.open_input_stream(path) as f:
        return pa.ipc.open_stream(f).read_all(), pa.ipc.open_stream(f).read_all()


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of every row of ``docs(doc_id, text)``.

    Added tokens inside texts count one each, as the library counts them by
    default. Null text is empty (0 tokens), a null doc_id stays null, repeated
    rows are counted each, an empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = shared_path(spark, "token-vectors")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = min(4096, partitions_for(rows, 16 << 20))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_level(tokenizer)

        def asked() -> Iterator[dict]:
            block = _Block()
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                    block.add(doc_id, text, coder)
                    if len(block.ids) >= BLOCK_WORDS or block.chars >= BLOCK_CHARS:
                        yield from block.save(folder, buckets)
                        block = _Block()
            if block.docs:
                yield from block.save(folder, buckets)

        yield from batched(asked(), _asked, 64)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, known = byte_level(tokenizer), {}

        def told() -> Iterator[dict]:
            for batch in batches:
                for r in batch.to_pylist():
                    counts = np.empty(r["n"], "<u4")
                    for i, w in enumerate(_unpack_words(r["words"], r["n"])):
                        n = known.get(w)
                        if n is None:
                            if len(known) >= 1_000_000:
                                known.clear()
                            n = known[w] = coder.pieces(w)
                        counts[i] = n
                    yield {"block": r["block"], "bucket": r["bucket"], "counts": zlib.compress(counts.tobytes(), 1)}

        yield from batched(told(), _told, 64)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(uri: str, counts: list[bytes]) -> pa.RecordBatch:
            docs, vectors = _load(uri)
            n = np.frombuffer(b"".join(map(zlib.decompress, counts)), "<u4").astype(np.int64)
            part = n[vectors["index"].to_numpy()] * vectors["freq"].to_numpy()
            before = np.concatenate([[0], np.cumsum(part)])
            at = np.append(docs["at"].to_numpy(), len(part))
            tokens = before[at[1:]] - before[at[:-1]] + docs["added"].to_numpy()
            columns = [docs["doc_id"].combine_chunks(), docs["n_bytes"].combine_chunks(), pa.array(tokens, pa.int64()), pa.array(tokens > limit)]
            return pa.RecordBatch.from_arrays(columns, schema=_counted)

        uri, held = None, []
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                if uri is not None and block != uri:
                    yield finish(uri, held)
                    held = []
                uri = block
                held.append(counts)
        if uri is not None:
            yield finish(uri, held)

    asked = staged(rows.mapInArrow(split, "block string, bucket int, n int, words binary"), "token-words")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = asked.repartition(n, "bucket").mapInArrow(tell, "block string, bucket int, counts binary")
    told = told.repartition(n, "block").sortWithinPartitions("block", "bucket")
    return told.mapInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path("byte_bpe_50k.json"))
