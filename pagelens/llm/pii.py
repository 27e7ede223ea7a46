"""Information-theoretic sanitisation of personal data (operator 2).

Base spans (e-mail, IP, card, phone) are the protected entities. A term that
stands within ``WINDOW`` words of an entity somewhere discloses it by their
pointwise mutual information over the corpus, measured against what the entity
itself carries:

    PMI(t; e) = log2(n(e,t) * N / (df(e) * df(t))),   IC(e) = log2(N / df(e))

with document counts over all documents, at any distance: n(e,t) counts those
that hold both. A ratio PMI / IC of 1 means that the term occurs only in the
entity's documents. At ``REMOVE`` the term is removed in every document that
holds the pair, wherever it stands, at ``GENERALISE`` it becomes a word class. A
pair counts only if at least ``SUPPORT`` different contexts, that is windows,
hold it, so that copies of one passage aren't evidence.

A run of ``SECRET_CHARS`` or more letters, digits and joining marks discloses
itself if it holds letters and digits and its characters carry at least
``SECRET_BITS`` bits (length times entropy): keys and tokens, which no document
but their own mentions. Such a run is a span of kind ``secret``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, own_name, staged
from .tokens import _Memo

WINDOW, SUPPORT, REMOVE, GENERALISE = 8, 3, 0.9, 0.8
SECRET_CHARS, SECRET_BITS = 20, 64.0
KINDS = ("email", "ip", "card", "phone", "removed", "general", "secret")
MARKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", "removed": "", "general": None, "secret": "<SECRET>"}
#: Distinct words counted before a worker hands them on, and documents of one output batch.
DF_FLUSH, ROWS_OUT = 20_000, 256
#: Bits of the filters of the pairs and terms to count; each is a table of FILTER_BITS / 8 bytes (4 MB) at any input.
FILTER_BITS, BITMAP_BITS = 1 << 25, 1 << 15

_local = re.compile(r"[A-Za-z0-9._%+-]")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile("[0-9]").search
_word = re.compile(r"[^\W_]+")
_long_run = re.compile(rf"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{{{SECRET_CHARS},}}+")
_letter = re.compile("[A-Za-z]").search
Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each ``@`` so that long runs of letters cost one step a character."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        left = at
        while left > free and _local.match(text, left - 1):
            left -= 1
        m = _domain.match(text, at + 1) if left < at else None
        if m:
            found.append((left, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d if i % 2 == 0 else 2 * d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    digits = s.replace(" ", "").replace("-", "")
    return 16 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(s: str) -> bool:
    return 8 <= sum(c in "0123456789" for c in s) <= 15


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches per kind, in code points; failing matches are dropped."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS[:4]}
    if "@" in text:
        out["email"] = emails(text)
    if _digit(text):
        if "." in text:
            out["ip"] = [m.span() for m in _ip.finditer(text) if _ip_ok(m[0])]
        out["card"] = [m.span() for m in _card.finditer(text) if _card_ok(m[0])]
        if "+" in text:
            out["phone"] = [m.span() for m in _phone.finditer(text) if _phone_ok(m[0])]
    return out


def secrets(text: str, taken: list[Span]) -> list[Span]:
    """Runs that disclose themselves, but those that touch a span of ``taken``."""
    if not _digit(text):
        return []
    found = []
    for m in _long_run.finditer(text):
        if _digit(m[0]) and _letter(m[0]) and _bits(m[0]) >= SECRET_BITS and not any(s < m.end() and m.start() < e for s, e in taken):
            found.append(m.span())
    return found


def _bits(s: str) -> float:
    counts = np.fromiter(Counter(s).values(), np.float64)
    return float(-(counts * np.log2(counts / len(s))).sum())


def _hash(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _entity(kind: str, s: str) -> int:
    return _hash(f"{kind}:{s.lower() if kind == 'email' else s if kind == 'ip' else re.sub('[^0-9]', '', s)}")


_term = _Memo(_hash, 50_000)
_odd = np.arange(1, 2 * WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def _words(text: str, taken: np.ndarray) -> np.ndarray:
    """(start, end) of the words outside the spans ``taken``, one row each."""
    words = np.fromiter((x for m in _word.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
    if len(words) and len(taken):
        taken = taken[np.argsort(taken[:, 0], kind="stable")]
        before = np.searchsorted(taken[:, 0], words[:, 1]) - 1
        words = words[(before < 0) | (np.maximum.accumulate(taken[:, 1])[before] <= words[:, 0])]
    return words


def _terms(text: str, words: np.ndarray) -> np.ndarray:
    return np.fromiter((_term[text[s:e].lower()] for s, e in words.tolist()), np.int64, len(words))


def _contexts(text: str, base: dict[str, list[Span]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (entity, term, context of their first window); all entities."""
    spans = np.asarray([s for found in base.values() for s in found], np.int64).reshape(-1, 2)
    entity = np.fromiter((_entity(kind, text[s:e]) for kind, found in base.items() for s, e in found), np.int64, len(spans))
    words = _words(text, spans)
    left, right = np.searchsorted(words[:, 0], spans[:, 0], "right"), np.searchsorted(words[:, 0], spans[:, 1])
    rows, seen = [], np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(spans), 4096):
            place = np.concatenate([left[at : at + 4096, None] + np.arange(-WINDOW, 0), right[at : at + 4096, None] + np.arange(WINDOW)], 1)
            inside = (place >= 0) & (place < len(words))
            asked, which = np.unique(place[inside], return_inverse=True)
            near = np.zeros(place.shape, np.int64)
            near[inside] = _terms(text, words[asked])[which]
            context = (near.view(np.uint64) * _odd).sum(1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
            e, c = (np.broadcast_to(x[:, None], place.shape)[inside] for x in (entity[at : at + 4096], context.view(np.int64)))
            t = near[inside]
            pair = e.view(np.uint64) * np.uint64(0x94D049BB133111EB) ^ t.view(np.uint64)
            pair, first = np.unique(pair, return_index=True)
            new = ~np.isin(pair, seen, assume_unique=True)
            seen, first = np.concatenate([seen, pair[new]]), np.sort(first[new])
            rows.append(np.stack([e[first], t[first], c[first]], 1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64), np.unique(entity)


_span_t = "array<struct<kind:string,start:int,`end`:int>>"
_found_sql = f"row_key long, doc_id long, text_key long, base {_span_t}, secrets {_span_t}, pairs array<struct<e:long,t:long,c:long>>, entities array<long>, text string"
_span_fields = [pa.field("kind", pa.string()), pa.field("start", pa.int32()), pa.field("end", pa.int32())]
_pair_fields = [pa.field(c, pa.int64()) for c in "etc"]


def _lists(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _span_lists(spans: list[list[tuple[str, int, int]]]) -> pa.ListArray:
    flat = [s for each in spans for s in each]
    columns = [pa.array([s[i] for s in flat], f.type) for i, f in enumerate(_span_fields)]
    return _lists(pa.StructArray.from_arrays(columns, fields=_span_fields), [len(x) for x in spans])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each document; of those that have any, also the pairs near them, the entities and the text."""
    from pyspark import TaskContext

    key = TaskContext.get().partitionId() << 40
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_OUT):
            batch = whole.slice(at, ROWS_OUT)
            spans, hidden, pairs, entities, texts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                spans.append([(k, s, e) for k, found in base.items() for s, e in found])
                hidden.append([("secret", s, e) for s, e in secrets(text or "", [x[1:] for x in spans[-1]])])
                if spans[-1]:
                    near, told = _contexts(text, base)
                    pairs.append(near)
                    entities.append(told)
                    texts.append(text)
                else:
                    pairs.append(np.zeros((0, 3), np.int64))
                    entities.append(np.zeros(0, np.int64))
                    texts.append(None)
            flat = np.concatenate(pairs)
            pair_lists = _lists(pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=_pair_fields), [len(p) for p in pairs])
            keys = pa.array(np.arange(key, key + batch.num_rows))
            key += batch.num_rows
            yield pa.RecordBatch.from_arrays([keys, batch.column(0), batch.column(2), _span_lists(spans), _span_lists(hidden), pair_lists, _lists(pa.array(np.concatenate(entities)), [len(e) for e in entities]), pa.array(texts, pa.string())], names=["row_key", "doc_id", "text_key", "base", "secrets", "pairs", "entities", "text"])


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """A bitmap over the hashes ``at`` of ``keys``; of fixed size, so it may travel with a task."""
    at = F.col("at").bitwiseAND(F.lit(FILTER_BITS - 1))
    rows = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / BITMAP_BITS).alias("bucket")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP_BITS).alias("bits")).collect()
    bits = np.zeros((FILTER_BITS // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for r in rows:
        bits[r.bucket] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits.reshape(-1)


def _in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.int64(FILTER_BITS - 1)
    return bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


def held_pairs(found: DataFrame, candidates: DataFrame) -> DataFrame:
    """(row_key, e, t) of the documents that hold both at any distance, as a written table.

    All of ``candidates(e, t)`` and a few others: a bitmap of fixed size over
    the pairs drops most others in the document's own pass, so that no join
    makes a row for every document and candidate of an entity.
    """
    bits = _filter_bits(candidates.select(F.col("e").bitwiseXOR(F.col("t")).alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, es, ts = [], [], []
            for key, base, entities, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = _words(text, np.asarray([(x["start"], x["end"]) for x in base], np.int64).reshape(-1, 2))
                terms = np.unique(_terms(text, words))
                for e in entities:
                    t = terms[_in_filter(bits, terms ^ np.int64(e))]
                    if len(t):
                        keys.append(np.full(len(t), key, np.int64))
                        es.append(np.full(len(t), e, np.int64))
                        ts.append(t)
            if ts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (keys, es, ts)], names=["row_key", "e", "t"])

    docs = found.filter(F.col("text").isNotNull())
    return staged(docs.select("row_key", "base", "entities", "text").mapInArrow(run, "row_key long, e long, t long"), "pii-held")


def document_counts(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(t, df_t): in how many documents of ``rows(text)`` each candidate's term occurs; a few other terms come too.

    Terms are counted as strings within a worker, then hashed and met with a
    bitmap of fixed size over the candidates' terms.
    """
    bits = _filter_bits(candidates.select(F.col("t").alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            t = np.fromiter(map(_hash, df), np.int64, len(df))
            n = np.fromiter(df.values(), np.int64, len(df))
            df.clear()
            asked = _in_filter(bits, t)
            return pa.RecordBatch.from_arrays([pa.array(t[asked]), pa.array(n[asked])], names=["t", "df"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                df.update(set(_word.findall((text or "").lower())))
                if len(df) >= DF_FLUSH:
                    yield flush()
        if df:
            yield flush()

    return rows.select("text").mapInArrow(run, "t long, df long").groupBy("t").agg(F.sum("df").alias("df_t"))


def candidate_pairs(found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """(e, t) of the pairs that at least ``support`` different windows hold."""
    pairs = found.select(F.explode("pairs").alias("p")).select("p.e", "p.t", "p.c")
    return pairs.groupBy("e", "t").agg(F.countDistinct("c").alias("contexts")).filter(F.col("contexts") >= support).select("e", "t")


def disclosures(found: DataFrame, candidates: DataFrame, held: DataFrame, df_t: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """(e, t, ratio, level) of the candidates over the thresholds; level 2 removes, 1 generalises."""
    joint = held.groupBy("e", "t").agg(F.count(F.lit(1)).alias("n")).join(candidates, ["e", "t"])
    df_e = found.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("df_e"))
    total = found.agg(F.count(F.lit(1)).cast("double").alias("total"))
    scored = joint.join(df_e, "e").join(df_t, "t").crossJoin(F.broadcast(total))  # total is one row
    carried = F.log2(F.col("total") / F.col("df_e"))
    pmi = F.log2(F.col("n") * F.col("total") / (F.col("df_e").cast("double") * F.col("df_t")))
    scored = scored.filter(F.col("df_e") < F.col("total")).withColumn("ratio", pmi / carried)
    level = F.when(F.col("ratio") >= remove, 2).otherwise(1)
    return scored.filter(F.col("ratio") >= generalise).select("e", "t", "ratio", level.alias("level"))


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_OUT):
            batch = whole.slice(at, ROWS_OUT)
            all_spans, counts, digests = [], {k: [] for k in KINDS[:4]}, []
            for base, hidden, hits, text in zip(*(batch.column(c).to_pylist() for c in ("base", "secrets", "hits", "text")), strict=True):
                spans = [(b["kind"], b["start"], b["end"]) for b in base]
                held = Counter(k for k, _, _ in spans)
                for k, n in counts.items():
                    n.append(held[k])
                digests.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest())
                if hits:
                    told = {h["t"]: h["level"] for h in sorted(hits, key=lambda h: h["level"])}
                    words = _words(text, np.asarray([s[1:] for s in spans], np.int64).reshape(-1, 2))
                    terms = _terms(text, words)
                    hit = np.isin(terms, np.fromiter(told, np.int64, len(told)))
                    more = [("removed" if told[t] == 2 else "general", s, e) for t, (s, e) in zip(terms[hit].tolist(), words[hit].tolist(), strict=True)]
                    spans += sorted(more, key=lambda x: (x[0] == "general", x[1]))
                all_spans.append(spans + [(b["kind"], b["start"], b["end"]) for b in hidden])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *(pa.array(n, pa.int64()) for n in counts.values()), pa.array(digests, pa.string()), _span_lists(all_spans)], names=["doc_id", "text_key", *(f"n_{k}" for k in counts), "base_sha256", "spans"])


_merged_sql = "doc_id long, text_key long, " + ", ".join(f"n_{k} long" for k in KINDS[:4]) + f", base_sha256 string, spans {_span_t}"


def find_spans(docs: DataFrame, support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """Base and disclosure spans of every row of ``docs(doc_id, text)``.

    Returns doc_id, text_key (xxhash64 of the text), n_email, n_ip, n_card,
    n_phone, base_sha256 and spans (base spans by kind and start, then removed
    and generalised terms and secrets by start; code points, end exclusive). Null text is
    empty and has no spans, a null doc_id stays null, repeated rows each give
    their row, an empty table gives none; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = staged(rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(_scan, _found_sql), "pii-found")
    candidates = staged(candidate_pairs(found, support), "pii-candidates")
    held = held_pairs(found, candidates)
    told = staged(disclosures(found, candidates, held, document_counts(rows, candidates), remove, generalise), "pii-disclosures")
    hits = held.join(told.select("e", "t", "level"), ["e", "t"]).groupBy("row_key").agg(F.collect_list(F.struct("t", "level")).alias("hits"))
    joined = found.join(hits, "row_key", "left").select("doc_id", "text_key", "base", "secrets", "text", "hits")
    return joined.mapInArrow(_merge_spans, _merged_sql)


def _class_of(word: str) -> str:
    return "<NUMBER>" if word.isdecimal() else "<NAME>" if word[:1].isupper() else "<WORD>"


def rewrite(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans replaced; of overlapping spans the first by start, then by kind, decides."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))):
        if s < at:
            at = max(at, e)
            continue
        mark = MARKS[kind]
        out += [text[at:s], _class_of(text[s:e]) if mark is None else mark]
        at = e
    return "".join(out) + text[at:]


def sanitize(docs: DataFrame, **thresholds: float) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; all columns and rows are kept.

    Null and empty texts stay as they are, rows without doc_id are treated like
    others, repeated rows get equal texts, an empty table stays empty; other
    columns may have any name.
    """
    at_id, at_key, at_spans = (own_name(docs, n) for n in ("span_id", "span_key", "spans"))
    spans = find_spans(docs, **thresholds).filter(F.size("spans") > 0).select(F.col("doc_id").alias(at_id), F.col("text_key").alias(at_key), F.col("spans").alias(at_spans)).dropDuplicates([at_id, at_key])
    spans = staged(spans, "pii-spans")
    same = docs["doc_id"].cast("long").eqNullSafe(spans[at_id]) & (F.xxhash64(docs["text"].cast("string")) == spans[at_key])
    joined = docs.join(spans, same, "left").drop(at_id, at_key)
    text_at, spans_at = joined.columns.index("text"), joined.columns.index(at_spans)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None or not s else rewrite(t, [(x["kind"], x["start"], x["end"]) for x in s]) for t, s in zip(batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist(), strict=True)]
            columns = [pa.array(texts, pa.string()) if i == text_at else c for i, c in enumerate(batch.columns) if i != spans_at]
            yield pa.RecordBatch.from_arrays(columns, names=[n for i, n in enumerate(batch.schema.names) if i != spans_at])

    return joined.mapInArrow(apply, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", shown.alias("spans"), F.size("spans").cast("long").alias("n_private"))
