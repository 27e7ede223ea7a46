"""Language identification by hyperdimensional n-gram profiles (operator 7).

Every letter has a random bipolar vector, made from its code point. An n-gram
binds its letters' vectors, permuted (rolled) by their place, by element-wise
product; a text bundles its n-grams by sum. A language's prototype is the sum
over its training texts; a text gets the language of the largest cosine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import bounded_batches, texts_of

DIM, ORDER, UNKNOWN = 1024, 3, "und"
#: Characters, texts and distinct n-grams bundled by one matrix product; its float32 sums stay whole numbers.
GROUP_CHARS, GROUP_TEXTS, GRAMS = 400_000, 256, 4096


def letter_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """A fixed random vector of +1 and -1 for each code point (splitmix64 bits)."""
    words = (dim + 63) // 64
    with np.errstate(over="ignore"):
        z = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
        for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(mul)
        z ^= z >> np.uint64(31)
    bits = np.unpackbits(z.view(np.uint8).reshape(len(codes), -1), axis=1)[:, :dim]
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


class _Letters(dict):
    """Code point to itself if a letter, else to a blank, as ``str.translate`` asks for it."""

    def __missing__(self, code: int) -> str:
        self[code] = got = c if (c := chr(code)).isalpha() else " "
        return got


_letters, _blanks = _Letters(), re.compile("  +")


def letters_of(text: str) -> str:
    """Lower case, with everything but letters as a single boundary blank."""
    return _blanks.sub(" ", text.lower().translate(_letters)).strip(" ")


def bundle(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Sums of bound n-gram vectors of texts in ``letters_of`` form, one row each.

    Sums are whole numbers below 2**53, so they don't depend on what is
    bundled beside a text. Memory is bounded: long texts are cut into pieces
    that overlap by an n-gram, and n-grams are bound ``GRAMS`` at a time.
    """
    out = np.zeros((len(texts), dim))
    held: list[tuple[int, str]] = []
    size = 0
    for i, t in enumerate(texts):
        t = f" {t} " if t else ""
        for at in range(0, max(len(t) - ORDER + 1, 0), GROUP_CHARS):
            held.append((i, t[at : at + GROUP_CHARS + ORDER - 1]))
            size += len(held[-1][1])
            if size >= GROUP_CHARS or len(held) >= GROUP_TEXTS:
                _add_bundles(held, out)
                held, size = [], 0
    if held:
        _add_bundles(held, out)
    return out


def _add_bundles(pieces: list[tuple[int, str]], out: np.ndarray) -> None:
    dim = out.shape[1]
    codes = np.frombuffer("".join(t for _, t in pieces).encode("utf-32-le", "surrogatepass"), "<u4")
    doc = np.repeat(np.arange(len(pieces)), [len(t) for _, t in pieces])
    alphabet, code = np.unique(codes, return_inverse=True)
    whole = doc[ORDER - 1 :] == doc[: len(doc) - ORDER + 1]
    gram = np.zeros(len(codes) - ORDER + 1, np.int64)
    for k in range(ORDER):
        gram = gram * len(alphabet) + code[k : len(codes) - ORDER + 1 + k]
    gram, doc = gram[whole], doc[ORDER - 1 :][whole]
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    grams, which = np.unique(gram, return_inverse=True)
    letters, sums = letter_vectors(alphabet, dim), np.zeros((len(pieces), dim))
    for lo in range(0, len(grams), GRAMS):
        some = grams[lo : lo + GRAMS]
        a, b = np.searchsorted(which, [lo, lo + len(some)])
        counts = np.bincount(doc[a:b] * len(some) + which[a:b] - lo, minlength=len(pieces) * len(some)).reshape(len(pieces), -1).astype(np.float32)
        bound, rest = np.ones((len(some), dim), np.int8), some
        for k in range(ORDER):  # the last letter isn't rolled, those before it by one more each
            bound *= np.roll(letters, k, axis=1)[rest % len(alphabet)]
            rest = rest // len(alphabet)
        sums += counts @ bound.astype(np.float32)
    np.add.at(out, [i for i, _ in pieces], sums)


def train(labelled: DataFrame, dim: int = DIM) -> dict[str, np.ndarray]:
    """Prototypes from ``labelled(text, lang)``, all rows of it; one vector a language comes to the driver.

    Null, empty and letterless texts add nothing, nor do rows without lang;
    repeated rows count each time; an empty table gives no prototype; other
    columns are ignored. A language without a letter in its texts isn't learned.
    """
    schema = pa.schema([("lang", pa.string()), ("vector", pa.list_(pa.int64()))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = [letters_of(t) for t in texts_of(batch.column(0))], np.asarray(batch.column(1).to_pylist(), object)
            rows = bundle(texts, dim)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + rows[langs == lang].sum(0).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"lang": list(total), "vector": [v.tolist() for v in total.values()]}, schema=schema)

    parts = labelled.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(add, "lang string, vector array<long>")
    sums = parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("v"))
    model: dict[str, np.ndarray] = {}
    for r in sums.collect():
        model.setdefault(r.lang, np.zeros(dim))[r.pos] = r.v
    return {lang: v / n for lang, v in sorted(model.items()) if (n := np.linalg.norm(v))}


def predict(docs: DataFrame, model: dict[str, np.ndarray], dim: int = DIM) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (cosine with the prototype, at least 0) from the column ``text`` alone.

    ``und`` with score 0 where the text is null, has no letter or nothing was
    learned. Input columns of these two names are replaced, all others kept;
    repeated rows get equal results, ties go to the first language by name, an
    empty table stays empty.
    """
    bounded_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score")
    names, table = list(model), list(model.values())
    at_text = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [letters_of(t) for t in texts_of(batch.column(at_text).cast(pa.string()))]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for lo in range(0, len(texts) if names else 0, GROUP_TEXTS):
                rows = bundle(texts[lo : lo + GROUP_TEXTS], dim)
                norm = np.sqrt((rows * rows).sum(1))
                # Each row is summed by itself, so that its score doesn't hang on the rows beside it.
                cosine = np.stack([(rows * v).sum(1) for v in table], 1) / np.where(norm > 0, norm, 1)[:, None]
                best = cosine.argmax(1)
                for i in np.flatnonzero(norm > 0):
                    langs[lo + i] = names[best[i]]
                    scores[lo + i] = min(1.0, max(0.0, float(cosine[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    fields = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return kept.mapInArrow(run, fields)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out quarter; a null doc_id is in neither."""
    return docs.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(training_rows(docs))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
