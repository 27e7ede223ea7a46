"""b-bit MinHash near-duplicates (operator 4).

1. Each text's set of word shingles gives a 128-bit digest, ``HASHES`` minima,
   band keys over them and a signature of their low ``BITS`` bits. Texts of
   equal sets are one class, named by its least doc_id.
2. Star round: of the leaders (least classes) of its buckets, each class is
   confirmed against the likeliest by signature. Pairs grow with members, not
   their square, and the links found make first components.
3. Settling: in every bucket that still holds several components, signatures of
   different components are compared. Only signatures travel; out come the
   classes that have a likely partner in another component, and which
   components hang together by such pairs.
4. Those classes meet once more, by such a clump of components instead of by
   bucket, with their texts. Each likely pair between components is confirmed
   on the full 64-bit shingle sets, unless an earlier confirmed link joins it.
5. Components come from star contraction over the confirmed links.

Steps 3 and 4 compare the rows outside a group's largest component with the
whole group, dealt in blocks of bounded bytes to many tasks, so a hot group of
one component and few strays costs in proportion to its members. Every pair
that shares a bucket and is likely is confirmed or already joined: the only
links that can be missed are those no band or estimate shows (below).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, own_name, staged, texts_of
from .components import connected_components
from .tokens import _Memo

WORDS, NEAR, OF = 5, 75, 100
HASHES, BANDS, BITS = 128, 32, 4
#: A pair at 0.75 shares no band of 32 with odds of 5 in a million, and has a lower estimate than this (five standard errors off) with 1 in a million.
MAYBE = 0.55
#: Weight of the rows one task holds, and of those it streams past them: signatures by count, texts by shingles.
HELD_ROWS, PASSING_ROWS, HELD_SHINGLES, PASSING_SHINGLES = 4096, 1 << 16, 1 << 20, 1 << 22


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _stream(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15))


_place = _stream(WORDS + 1, 1 << 20) | np.uint64(1)
_mul, _add = (_stream(HASHES, 1 << 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_stream(HASHES, 1 << 22) >> np.uint64(32)).astype(np.uint32)
_band_mul = _stream(HASHES, 1 << 23) | np.uint64(1)
_word_hash = _Memo(lambda w: int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little"), 200_000)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; fewer words than ``WORDS`` make one, no words none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, len(words))
    width = min(WORDS, len(h))
    with np.errstate(over="ignore"):
        z = np.full(len(h) - width + 1, width, np.uint64) * _place[WORDS]
        for k in range(width):
            z += h[k : len(h) - width + 1 + k] * _place[k]
    return np.unique(_mix(z))


def minima(sets: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint32).max, np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 4096):
            low = np.minimum(low, (x[at : at + 4096, None] * _mul + _add).min(0))
    return low


def signature(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, packed into signed 64-bit words."""
    bits = (low & np.uint32(15)).astype(np.uint8)
    return (bits[::2] | bits[1::2] << 4).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = (low.astype(np.uint64) + np.uint64(1)) * _band_mul
        return _mix(rows.reshape(BANDS, -1).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


_signed = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("sig", pa.list_(pa.int64())), ("bands", pa.list_(pa.int64()))])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digest, sig, bands = [], [], [], []
        for text in texts_of(batch.column(1)):
            s = shingles(text)
            n.append(len(s))
            if len(s):
                low = minima(s)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(signature(low))
                bands.append(band_keys(low))
            else:
                digest.append(None)
                sig.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], schema=_signed)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from signatures: the share of equal low bits, corrected for chance collisions of 1 in 2**BITS."""
    differ = F.lit(0)
    for i in range(HASHES * BITS // 64):
        x = a[i].bitwiseXOR(b[i])
        any_bit = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3))
        differ = differ + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0**-BITS
    return ((HASHES - differ) / float(HASHES) - chance) / (1 - chance)


def likeliest_leaders(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (a, b) whose sizes and signatures leave a similarity of NEAR / OF possible, each b's likeliest a."""
    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").withColumn("likely", estimate(F.col("sig_a"), F.col("sig_b")))
    fit = both.filter((F.least("n_a", "n_b") * OF >= F.greatest("n_a", "n_b") * NEAR) & (F.col("likely") >= MAYBE))
    return fit.groupBy("b").agg(F.max(F.struct("likely", (-F.col("a")).alias("minus"))).alias("top")).select((-F.col("top.minus")).alias("a"), "b")


#: Bits of the filter that spares most texts the shuffle; it is a table of FILTER_BITS / 8 bytes (4 MB) at any input.
FILTER_BITS, BITMAP_BITS = 1 << 25, 1 << 15


def texts_for(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """``asked(doc_id, text_key, ...)`` with the ``text`` of each from ``rows(doc_id, text)``, once for each row asked.

    A bitmap over hashed ids, broadcast because its size is fixed, drops most
    other rows before their texts are shuffled; the join after it is exact.
    """
    place = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    bits = asked.select(place().alias("at")).groupBy(F.floor(F.col("at") / BITMAP_BITS).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("at") % BITMAP_BITS).alias("_bits"))
    found = rows.withColumn("_at", place()).withColumn("_bucket", F.floor(F.col("_at") / BITMAP_BITS)).join(F.broadcast(bits), "_bucket")
    within = F.col("_at") % BITMAP_BITS
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(within / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    likely = found.filter(F.floor(byte / F.pow(F.lit(2.0), (within % 8).cast("double"))) % 2 == 1).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return asked.join(likely.dropDuplicates(["doc_id", "text_key"]), ["doc_id", "text_key"])


_popcount = np.bitwise_count if hasattr(np, "bitwise_count") else lambda x: np.unpackbits(x.view(np.uint8).reshape(*x.shape, 8), axis=-1).sum(-1, dtype=np.uint8)


def _may_link(n: np.ndarray, sig: np.ndarray, n_held: np.ndarray, sig_held: np.ndarray) -> np.ndarray:
    """Matrix of rows against held rows: whether sizes fit and the estimate is at least MAYBE."""
    fit = np.minimum(n[:, None], n_held) * OF >= np.maximum(n[:, None], n_held) * NEAR
    differ = np.zeros(fit.shape, np.int16)
    for i in range(sig.shape[1]):
        x = sig[:, i, None] ^ sig_held[:, i]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differ += _popcount(x & np.uint64(0x1111111111111111))
    return fit & (((HASHES - differ) / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS) >= MAYBE)


def dealt(rows: DataFrame, key: str, weight: Column, held: int, passing: int) -> DataFrame:
    """``rows(key, label, rep, ...)`` dealt to groups (key, h, p), with ``role`` 0 for held rows and 1 for passing ones.

    Held are the rows outside their key's heaviest label, in blocks of weight
    ``held``; all rows of the key pass each block, in parts of weight
    ``passing``. So any two rows of different labels meet, held rows at most
    once more than needed, and no task holds or reads a whole heavy key.
    """
    one = lambda name: own_name(rows, name)
    w, total, rest, blocks, parts = (one(x) for x in ("w", "total", "rest", "blocks", "parts"))
    by_label = rows.withColumn(w, weight).groupBy(key, "label").agg(F.sum(w).alias(w))
    by_key = by_label.groupBy(key).agg(F.sum(w).alias(total), F.max(F.struct(F.col(w).alias("w"), F.col("label").alias("most"))).alias("_top"))
    by_key = by_key.select(key, F.col("_top.most").alias("most"), F.col(total), (F.col(total) - F.col("_top.w")).alias(rest)).filter(F.col(rest) > 0)
    by_key = by_key.select(key, "most", F.ceil(F.col(rest) / held).cast("int").alias(blocks), F.ceil(F.col(total) / passing).cast("int").alias(parts))
    met = rows.join(by_key, key)
    mine = lambda count, salt: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(count)).cast("int")
    every = lambda count: F.sequence(F.lit(0), F.col(count) - 1)
    hold = F.when(F.col("label") != F.col("most"), F.transform(every(parts), lambda p: F.struct(mine(blocks, 1).alias("h"), p.alias("p"), F.lit(0).alias("role"))))
    go = F.transform(every(blocks), lambda h: F.struct(h.alias("h"), mine(parts, 2).alias("p"), F.lit(1).alias("role")))
    places = F.concat(F.coalesce(hold, F.array().cast("array<struct<h:int,p:int,role:int>>")), go)
    return met.withColumn("_at", F.explode(places)).select(*rows.columns, "_at.h", "_at.p", "_at.role")


class _Roots(dict):
    """A union-find over labels."""

    def of(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.of(x), self.of(y)
        if x != y:
            self[max(x, y)] = min(x, y)
        return x != y


def _by_group(batches: Iterator[pa.RecordBatch], most: int = 256) -> Iterator[tuple[bool, int, pa.RecordBatch]]:
    """(new group, role, slice) of sorted rows (key, h, p, role, ...); slices of passing rows hold at most ``most``."""
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "h", "p", "role")], 1)
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)] if len(keys) else [0]
        for lo, hi in zip(starts, starts[1:], strict=False):
            group = tuple(keys[lo, :3].tolist())
            for at in range(lo, hi, most):
                yield group != last, int(keys[lo, 3]), batch.slice(at, min(most, hi - at))
                last = group


def _signatures(batch: pa.RecordBatch) -> np.ndarray:
    words = HASHES * BITS // 64
    return batch.column("sig").flatten().to_numpy().reshape(-1, words).view(np.uint64)


def _stack(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


_torn = pa.schema([("rep", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])


def _clump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group: ``rep`` of each row with a likely partner of another label, and a spanning set (u, v) of such labels."""
    held: list[tuple] = []
    hot: set[int] = set()
    roots, edges = _Roots(), []

    def flush() -> pa.RecordBatch:
        n = len(hot) + len(edges)
        rep = pa.array([*hot, *[None] * len(edges)], pa.int64())
        u, v = ([*[None] * len(hot), *(e[i] for e in edges)] for i in (0, 1))
        assert n == len(rep)
        return pa.RecordBatch.from_arrays([rep, pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=_torn)

    for new, role, rows in _by_group(batches):
        if new:
            if len(hot) + len(edges) > 20_000:
                yield flush()
                hot, edges = set(), []
            held, ready, roots = [], None, _Roots()
        mine = tuple(rows.column(c).to_numpy() for c in ("rep", "label", "n")) + (_signatures(rows),)
        if role == 0:
            held.append(mine)
            continue
        if not held:
            continue
        if ready is None:
            ready = tuple(_stack([h[i] for h in held]) for i in range(4))
        for at in range(0, len(ready[0]), HELD_ROWS):
            rep, label, n, sig = (x[at : at + HELD_ROWS] for x in ready)
            i, j = np.nonzero(_may_link(mine[2], mine[3], n, sig) & (mine[1][:, None] != label))
            if len(i):
                hot.update(mine[0][np.unique(i)].tolist(), rep[np.unique(j)].tolist())
                pairs = np.unique(np.sort(np.stack([mine[1][i], label[j]], 1), axis=1), axis=0)
                edges += [(v, u) for u, v in pairs.tolist() if roots.join(u, v)]
    if hot or edges:
        yield flush()


_link = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _links_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per group: confirmed links (u, v) between passing and held rows, a spanning set of them over the labels."""
    held: list[tuple] = []
    roots, found = _Roots(), []
    for new, role, rows in _by_group(batches):
        if new:
            held, ready, roots = [], None, _Roots()
        mine = tuple(rows.column(c).to_numpy() for c in ("rep", "label", "n")) + (_signatures(rows),)
        if role == 0:
            held.append(mine + ([shingles(t) for t in texts_of(rows.column("text"))],))
            continue
        if not held:
            continue
        if ready is None:
            ready = tuple(_stack([h[i] for h in held]) for i in range(4))
            sets = [s for h in held for s in h[4]]
        rep, label, n, sig = ready
        likely = _may_link(mine[2], mine[3], n, sig) & (mine[1][:, None] != label)
        texts = rows.column("text")
        for i in np.flatnonzero(likely.any(1)).tolist():
            my_label, s = int(mine[1][i]), None
            for j in np.flatnonzero(likely[i]).tolist():
                if roots.of(my_label) == roots.of(int(label[j])):
                    continue
                if s is None:
                    s = shingles(texts[i].as_py())
                if shared_enough(s, sets[j]):
                    roots.join(my_label, int(label[j]))
                    found.append((int(mine[0][i]), int(rep[j])))
        if len(found) >= 10_000:
            yield _pairs(found)
            found = []
    if found:
        yield _pairs(found)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], schema=_link)


def shared_enough(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted shingle sets hold OF * |x & y| >= NEAR * |x | y|."""
    if len(x) > len(y):
        x, y = y, x
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return both * OF >= (len(x) + len(y) - both) * NEAR


def _meet(rows: DataFrame, run, schema: str) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "key", "h", "p").sortWithinPartitions("key", "h", "p", "role", "rep").mapInArrow(run, schema)


def star_links(leaders: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (u, v): the pairs (a, b) of classes that hold on their full sets.

    A leader's text travels once for each of its blocks of followers, a
    follower's once.
    """
    followers = leaders.groupBy("a").agg(F.count(F.lit(1)).alias("m")).select("a", F.ceil(F.col("m") / 512).cast("int").alias("parts"))
    go = leaders.join(followers, "a").select(F.col("b").alias("rep"), F.array(F.struct(F.col("a").alias("key"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("p"), F.lit(1).alias("role"))).alias("places"))
    hold = followers.select(F.col("a").alias("rep"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.col("a").alias("key"), p.cast("int").alias("p"), F.lit(0).alias("role"))).alias("places"))
    places = go.unionByName(hold).select("rep", F.explode("places").alias("at")).select("rep", "at.*")
    asked = places.join(classes.select("rep", "n", "sig", "text_key"), "rep").withColumn("doc_id", F.col("rep"))
    full = texts_for(asked.select("doc_id", "text_key", "key", F.lit(0).alias("h"), "p", "role", "rep", "n", "sig"), rows)
    return _meet(full.select("key", "h", "p", "role", "rep", F.col("rep").alias("label"), "n", "sig", "text"), _links_in, "u long, v long")


def settled(members: DataFrame, classes: DataFrame, component: DataFrame, rows: DataFrame) -> DataFrame:
    """The links (u, v) between components that share a bucket: every likely pair is confirmed or joined by those returned."""
    labels = component.select(F.col("id").alias("rep"), "component")
    labelled = staged(members.join(labels, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("label")), "bucket-labels")
    torn = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    signed = labelled.join(torn, "key").join(classes.select("rep", "n", "sig"), "rep")
    near = staged(_meet(dealt(signed, "key", F.lit(1), HELD_ROWS, PASSING_ROWS), _clump, "rep long, u long, v long"), "likely-across")
    clump = connected_components(near.filter(F.col("u").isNotNull()).select("u", "v")).select(F.col("id").alias("label"), F.col("component").alias("key"))
    hot = near.filter(F.col("rep").isNotNull()).select("rep").distinct().join(labels, "rep", "left").select("rep", F.coalesce("component", "rep").alias("label"))
    asked = staged(hot.join(clump, "label").join(classes.select("rep", "n", "sig", "text_key"), "rep"), "likely-classes")
    full = texts_for(dealt(asked, "key", F.col("n") + 256, HELD_SHINGLES, PASSING_SHINGLES).withColumn("doc_id", F.col("rep")), rows)
    return _meet(full.select("key", "h", "p", "role", "rep", "label", "n", "sig", "text"), _links_in, "u long, v long")


def find_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs(doc_id, text)``.

    A document's set holds its distinct shingles of five words (ASCII lower
    case, split at ASCII white space); documents with
    100 * |A & B| >= 75 * |A | B| are linked; component_id is the least doc_id
    reachable and kept marks the document that bears it. Null, empty and blank
    texts have no shingle and link with nothing. A row without doc_id can't be
    named: it links with nothing, its component_id is null and it is kept.
    Rows of one doc_id are one document. Repeated rows are all returned. An
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(_sign, "doc_id long, text_key long, n long, digest binary, sig array<long>, bands array<long>")
    signed = staged(signed, "minhash")
    named = signed.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    first = named.groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("at"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = staged(first.select("digest", F.col("at.doc_id").alias("rep"), F.col("at.text_key").alias("text_key"), "n", "sig", "bands"), "minhash-classes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("key", "leader")
    members = staged(banded.join(buckets, "key"), "buckets")
    star = members.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    leaders = staged(likeliest_leaders(star, classes), "star-pairs")
    owned = named.select("doc_id", "digest").join(classes.select("digest", "rep"), "digest").select("doc_id", "rep")
    twice = owned.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi").select("doc_id", "lo")
    same_id = owned.join(twice, "doc_id").filter("rep <> lo").select(F.col("rep").alias("u"), F.col("lo").alias("v"))
    links = staged(star_links(leaders, classes, rows).unionByName(same_id), "links")
    component = staged(connected_components(links), "components")
    more = staged(settled(members.select("key", "rep"), classes, component, rows), "links-across")
    if not more.isEmpty():
        component = staged(connected_components(links.unionByName(more)), "components")
    found = signed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    found = found.join(classes.select("digest", "rep"), "digest", "left").join(component.withColumnRenamed("id", "rep"), "rep", "left")
    component_id = F.coalesce("component", "rep", "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate component, all columns kept.

    Rows without doc_id stay, as do all with null or blank texts (each links
    with nothing). Of rows that repeat the kept doc_id one stays: the first by
    hash of its text, then by text. An empty table stays empty; other columns
    may have any name.
    """
    nth, kept_id = own_name(docs, "nth"), own_name(docs, "kept_id")
    kept = staged(find_components(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias(kept_id)).distinct(), "kept")
    stays = docs.join(kept, docs["doc_id"].cast("long") == kept[kept_id], "left_semi")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return stays.withColumn(nth, F.row_number().over(one)).filter(F.col(nth) == 1).drop(nth).unionByName(docs.filter(F.col("doc_id").isNull()))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_OP4 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, CAST(len(ws) - 3 AS BIGINT)), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS s FROM w),
h AS (SELECT doc_id, md5(s) AS s FROM sh),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM h a JOIN h b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON comp.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
