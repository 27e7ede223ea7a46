"""Edge cases, round trips and brute-force comparisons of the training-data operators."""

import hashlib
import random
import re
import zipfile
import zlib

import numpy as np
import pytest

from pagelens.llm import chat, components, embeddings, langid, media, minhash, mixing, packing, pii, sstable, token_counts
from pagelens.llm.common import shared_path
from pagelens.llm.tokens import default_path, word_ids

WORD, BYTE = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")
CLASHES = ["_nth", "_kept_id", "_key", "_i", "_k", "_spans", "_span_id", "_mix_cdf", "_at"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, copy string, mix_key string, row_key int"
#: Null, empty, blank, very long and repeated texts, a null id, odd characters, clashing column names.
ROWS = [
    (1, "Hello world, it's 3.14 été <|endoftext|> done", "en", "a", 1, "x", "k", 7), (2, None, None, None, None, None, None, None), (3, "", "en", "a", 0, "", "", 0), (4, "  \n\t ", "de", "b", 5, "x", "k", 1),
    (5, "word " * 30_000, "en", "a", 9, "x", "k", 2), (6, "same text here for all", "fr", "b", 3, "x", "k", 3), (6, "same text here for all", "fr", "b", 3, "x", "k", 3), (None, "no id", "en", None, 1, None, None, None),
    (7, "\x1c odd 中文 \U0001f600 İΣς", "de", "b", 2, "x", "k", 4), (8, "SAME text here FOR all", "fr", "a", 3, "x", "k", 5),
]


def clashing(df):
    return df.selectExpr("*", *(f"n_chars AS {c}" for c in CLASHES))


@pytest.fixture(scope="module")
def docs(spark):
    return clashing(spark.createDataFrame(ROWS, DOCS)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return clashing(spark.createDataFrame([], DOCS))


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD).encode(text or "", add_special_tokens=False).ids + [2]


def test_word_memo_equals_library():
    rng, coder = random.Random(5), word_ids(WORD)
    letters = [chr(c) for c in range(0x250)] + list("Σςİﬁ ​᠎中") + ["<|endoftext|>", "'s", "'LL", " ", "\n", "Word"] * 4
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        assert coder.encode(t) == coder.whole(t), repr(t)


def test_sstable_round_trip_and_lookup(spark, docs, empty):
    manifest = sstable.write_sstables(docs, shared_path(spark, "t-sst"), WORD)
    rows = sorted(sstable.read_sstables(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8]
    at = 0
    texts = {r[0]: r[1] for r in ROWS}
    for r in rows:
        ids = np.asarray(library_ids(texts[r.doc_id]), "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert [v.tolist() for v in sstable.lookup(manifest, 6)] == [library_ids("same text here for all")] * 2
    assert [v.tolist() for v in sstable.lookup(manifest, None)] == [library_ids("no id")]
    assert sstable.lookup(manifest, 99) == []
    assert sstable.read_sstables(sstable.write_sstables(empty, shared_path(spark, "t-sst"), WORD)).count() == 0


def test_sstable_blocks_and_filter(tmp_path):
    path = f"{tmp_path}/x.sst"
    with open(path, "wb") as f:
        w = sstable.Writer(f, 2)
        for i in range(0, 40_000, 2):
            w.add(sstable.key_of(i - 9000), i.to_bytes(4, "little") * 3)
        w.close()
    r = sstable.Reader(f"file://{path}")
    assert len(r.index) > 5 and r.entries == 20_000
    assert [sstable.id_of(k) for k, _ in r.scan()] == list(range(-9000, 31_000, 2))
    for i in range(0, 40_000, 777):
        assert r.lookup(sstable.key_of(i - 9000)) == ([i.to_bytes(4, "little") * 3] if i % 2 == 0 else [])
    false = sum(r.may_hold(sstable.key_of(i)) for i in range(-8999, 31_000, 2))
    assert false < 0.03 * 20_000


def test_packing_covers_every_id_once(docs, empty):
    seqs = packing.pack_documents(docs, WORD).cache()
    pieces = packing.piece_digests(seqs, WORD).collect()
    texts = {r[0]: r[1] for r in ROWS}
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
        ids = library_ids(texts[p.doc_id])
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.asarray(ids[p.start : p.start + p.length], "<u4").tobytes())
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW
    assert sum(p.length for p in pieces) == sum(len(library_ids(r[1])) for r in ROWS)
    assert packing.piece_digests(packing.pack_documents(empty, WORD), WORD).count() == 0


def test_packer_is_bounded_and_pads_little():
    rng = random.Random(1)
    packer, sizes, most = packing.Packer(4096, 16, 32), [], 0
    for i in range(3000):
        n = rng.choice([1, 5, 300, 900, 2500, 9000])
        for w in packer.add(packing.Piece(i, 0, n, n, bytes(2 * n))):
            sizes.append(w.used)
        most = max(most, len(packer.open))
    assert most <= 16 and min(sizes) >= 4096 - 32


def test_power_of_two_parts():
    w = packing.Window()
    w.put(packing.Piece(1, 0, 1000, 1000, np.arange(1000, dtype=np.uint16).tobytes()))
    w.put(packing.Piece(2, 5, 337, 342, np.arange(337, dtype=np.uint16).tobytes()))
    parts = list(packing.power_of_two_parts(w, 4096))
    assert [p.used for p in parts] == [1024, 256, 32, 16, 8, 1]
    assert np.frombuffer(b"".join(p.ids for x in parts for p in x.pieces), np.uint16).tolist() == list(range(1000)) + list(range(337))


def test_token_counts_equal_library(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BYTE).collect())
    want = sorted((i or 0, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x, *_ in ROWS)
    assert got == want
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def test_byte_level_words_equal_library():
    from tokenizers import Tokenizer

    rng, t, coder = random.Random(4), Tokenizer.from_file(BYTE), token_counts.byte_level(BYTE)
    letters = [chr(c) for c in range(0x250)] + list("Σ　​中٣\xb2ﬁ\U0001f600") + ["<|endoftext|>", "'s", "'LL", " ", "  ", "\n", "Word"] * 4
    for _ in range(1500):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        words, added = coder.words(x)
        assert sum(map(coder.pieces, words)) + added == len(t.encode(x, add_special_tokens=False).ids), repr(x)


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


@pytest.mark.parametrize("letters", ["a1@.-+ ", "a@.b- @", "01. -+()", "12.3.+4 5"])
def test_base_spans_equal_patterns(letters):
    rng = random.Random(3)
    for _ in range(4000):
        x = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(x) == {k: [m.span() for m in re.finditer(p, x) if ok(m[0])] for k, (p, ok) in PATTERNS.items()}, x


def test_pii_disclosing_terms(spark):
    pairs = [(i, f"note {i} from zorbax via mail bob@corp.example today w{i}") for i in range(4)]
    rest = [(10 + i, f"plain note {i} from someone today about things u{i}") for i in range(40)]
    docs = spark.createDataFrame([*pairs, *rest, (99, None), (None, "zorbax x@y.zz")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find_spans(docs).collect()}
    kinds = {(s.kind, docs_text[s.start : s.end]) for docs_text in [pairs[0][1]] for s in rows[0].spans}
    assert kinds == {("email", "bob@corp.example"), ("removed", "zorbax"), ("removed", "via"), ("removed", "mail")}
    assert rows[0].n_email == 1 and rows[0].base_sha256 == hashlib.sha256(f"email:{(s := pairs[0][1].index('bob'))}:{s + 16}".encode()).hexdigest()
    assert rows[99].spans == [] and rows[20].spans == [] and [s.kind for s in rows[None].spans] == ["email"]
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert "<EMAIL>" in clean[0] and "zorbax" not in clean[0] and clean[99] is None and clean[20] == rest[10][1] and clean[None] == "zorbax <EMAIL>"


def test_pii_disclosing_terms_far_from_the_entity(spark):
    def far(i):
        return f"Zorbax heads this {' '.join(f'p{i}x{k}' for k in range(30))} bob@corp.example"

    near = [(i, f"n{i} zorbax bob@corp.example m{i}") for i in range(3)]
    rows = [*near, *[(i, far(i)) for i in range(3, 9)], (9, "bob@corp.example"), *[(20 + i, f"plain note u{i} this heads") for i in range(40)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: [(s.kind, s.start) for s in r.spans] for r in pii.find_spans(docs).collect()}
    assert spans[0] == [("email", 10), ("removed", 3)] and spans[9] == [("email", 0)] and spans[20] == []
    for i in range(3, 9):
        assert spans[i] == [("email", far(i).index("bob")), ("removed", 0)]
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert not any("zorbax" in clean[i].lower() for i in range(9))


def test_pii_levels_equal_the_definition(spark):
    """Every (entity, term) of a small corpus: counts, PMI against IC and level, by loops over the documents."""
    import math

    rng, docs = random.Random(17), []
    for i in range(160):
        e = rng.choice(["ann@x.example", "bob@y.example", "10.0.0.7", None])
        words = rng.choices(["zorbax", "vendel", "quill", "umber", "the", "note", "here"], [1, 1, 1, 1, 4, 4, 4], k=rng.randint(2, 9))
        if e == "ann@x.example":
            words += ["zorbax"] * (rng.random() < 0.9) + ["vendel"] * (rng.random() < 0.8)
        words = [w for w in words if w not in ("zorbax", "vendel") or e == "ann@x.example" or rng.random() < {"zorbax": 0.02, "vendel": 0.12}[w]]
        docs.append((i, " ".join([*words, *([e] if e else [])])))
    want, total = {}, len(docs)
    entities = {i: {w for w in t.split() if "@" in w or w.count(".") == 3} for i, t in docs}
    terms = {i: {w for w in t.split() if w not in entities[i]} for i, t in docs}
    for e in set().union(*entities.values()):
        mine = [i for i in entities if e in entities[i]]
        for t in set().union(*terms.values()):
            both = [i for i in mine if t in terms[i]]
            windows = {tuple(docs[i][1].split()[:-1][-8:]) for i in both if t in docs[i][1].split()[:-1][-8:]}
            if len(windows) >= 3:
                ratio = math.log2(len(both) * total / (len(mine) * sum(t in terms[i] for i in terms))) / math.log2(total / len(mine))
                want |= {(i, t): "removed" if ratio >= 0.9 else "general" for i in both if ratio >= 0.8}
    assert set(want.values()) == {"removed", "general"}
    got = {}
    for r in pii.find_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got |= {(r.doc_id, docs[r.doc_id][1][s.start : s.end]): s.kind for s in r.spans if s.kind in ("removed", "general")}
    assert got == want
    clean = {r.doc_id: r.text for r in pii.sanitize(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(t not in clean[i].split() for i, t in want) and any("<WORD>" in t for t in clean.values())


def test_pii_secrets(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    text = f'my token = "{key}"### and a-very-long-joined-word-of-letters 1234567890123456789012345 aaaaaaaaaaaaaaaaaaaaaaa1'
    assert [text[s:e] for s, e in pii.secrets(text, [])] == [key]
    long_mail = f"{key}@corp.example"
    assert pii.secrets(long_mail, pii.base_spans(long_mail)["email"]) == [] and pii.secrets("x" * 50_000 + "7", []) == []
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    assert {r.doc_id: [s.kind for s in r.spans] for r in pii.find_spans(docs).collect()} == {1: ["secret"], 2: []}
    assert key not in pii.sanitize(docs).filter("doc_id = 1").first().text


def test_pii_edges(spark, docs, empty):
    assert pii.find_spans(docs).count() == len(ROWS) and pii.find_spans(empty).count() == 0
    out = pii.sanitize(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS) and pii.sanitize(empty).count() == 0
    assert pii.rewrite("a b@c.d e", [("email", 2, 7), ("phone", 4, 8)]) == "a <EMAIL>e"
    assert pii.base_spans("1" * 50_000 + "@" * 20_000 + "a" * 50_000)["email"] == []


def test_chat_round_trip(spark):
    odd = ["", "\\", "### x", "</turn>", "\\### Assistant: </turn> ok", " </turn>\n### user: y", "é\U0001f600", "a: b\n"]
    rows = [(c, t, r, odd[(c * 3 + t) % len(odd)] if (c + t) % 5 else None) for c in range(12) for t, r in enumerate(["user", "assistant", "sys: x", None])]
    rows += [(3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (None, None, "user", "null conversation")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(turns)).collect()}
    assert len(got) == 13
    for c, r in got.items():
        mine = sorted(((t is not None, t or 0, role or "", role is not None, text or "", text is not None) for i, t, role, text in rows if i == c))
        said = [(x[2], x[4]) for x in sorted(mine, key=lambda x: (x[0], x[1], x[3], x[2], x[5], x[4]))]
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        loss = "".join(b for a, b in said if a == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(said), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_chat_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_BYTES", 2000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(1, t, "assistant", f"text {t} " * 20) for t in range(90)] + [(2, t, "user", "x") for t in range(5)]
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
        batches = [b for b in turns.orderBy("conv_id", "turn").drop("turn").toArrow().to_batches(max_chunksize=7)]
        parts = [r for b in chat._format(iter(batches)) for r in b.to_pylist()]
        assert [p["part"] for p in parts if p["conv_id"] == 1] == list(range(sum(p["conv_id"] == 1 for p in parts))) and len(parts) > 3
        assert "".join(t for p in parts if p["conv_id"] == 1 for _, t in chat.parse(p["formatted"])) == "".join(r[3] for r in rows if r[0] == 1)
        assert [p["part"] for p in parts if p["conv_id"] == 2] == [0]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def brute_components(texts):
    sets = {i: set(minhash.shingles(t or "").tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_minhash_equals_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    texts, n = {}, 0
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([3, 6, 40, 150]))
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts[n := n + 1] = " ".join(t)
    for _ in range(40):
        texts[n := n + 1] = passage + " " + " ".join(rng.choices(words, k=rng.choice([4, 10, 15, 25, 60])))
    texts |= {n + 1: None, n + 2: "", n + 3: " \t ", n + 4: "A b", n + 5: "a  B"}
    docs = spark.createDataFrame([*texts.items(), (1, texts[1]), (None, texts[2])], "doc_id long, text string")
    want, sizes = brute_components(texts)
    rows = minhash.find_components(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)
    stays = [r.doc_id for r in minhash.drop_near_duplicates(docs).collect()]
    assert sorted(x for x in stays if x is not None) == sorted(set(want.values())) and stays.count(None) == 1


def test_minhash_blocks_find_links_off_the_star(spark, monkeypatch):
    for name, size in (("HELD_ROWS", 2), ("PASSING_ROWS", 3), ("HELD_SHINGLES", 900), ("PASSING_SHINGLES", 1500)):
        monkeypatch.setattr(minhash, name, size)
    body = {g: " ".join(f"{g}{i}" for i in range(60)) for g in "abc"}
    texts = {i: f"{body[g]} x{i}" for i, g in enumerate("abbcbaacbbb")}
    rows = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    keys = {r.doc_id: r.k for r in rows.selectExpr("doc_id", "xxhash64(text) AS k").collect()}
    sets = {i: minhash.shingles(t) for i, t in texts.items()}
    members = spark.createDataFrame([(7, i) for i in sets], "key long, rep long")
    classes = spark.createDataFrame([(i, keys[i], len(s), minhash.signature(minhash.minima(s)).tolist()) for i, s in sets.items()], "rep long, text_key long, n long, sig array<long>")
    for known in ([], [(1, 1), (2, 1), (4, 1), (8, 1)]):
        component = spark.createDataFrame(known, "id long, component long")
        links = minhash.settled(members, classes, component, rows).unionByName(component.selectExpr("id AS u", "component AS v"))
        got = {r.id: r.component for r in components.connected_components(links).collect()}
        assert got == brute_components(texts)[0]
    star = spark.createDataFrame([(1, 2), (0, 1), (0, 3), (1, 10)], "a long, b long")
    assert {tuple(sorted(r)) for r in minhash.star_links(star, classes, rows).collect()} == {(1, 2), (1, 10)}


def test_minhash_stars_and_chains_at_the_threshold(spark):
    """Families of four whose links lie at 0.74 to 0.80, as stars around the last, the first or as chains."""
    rng, texts, n = random.Random(21), {}, 0
    for f in range(300):
        words = [f"f{f}w{i}" for i in range(104)]

        def edited(k, base, places):
            return [f"f{f}r{k}x{i}" if any(at <= i < at + rng.choice((9, 10)) for at in places) else w for i, w in enumerate(base)]

        if f % 3 == 2:
            chain = [words]
            for k in range(3):
                chain.append(edited(k, chain[-1], [rng.randrange(0, 90)]) if rng.random() < 0.5 else chain[-1][7:] + [f"f{f}c{k}x{i}" for i in range(7)])
            family = chain
        else:
            family = [edited(k, words, (rng.choice((9, 10)), 45, 80)[: rng.choice((2, 3))]) for k in range(3)]
            family = [*family, words] if f % 3 else [words, *family]
        for t in family:
            texts[n := n + 1] = " ".join(t)
    texts |= {n + 1 + k: " ".join(f"115r{k}_{i % 35}" if i in {*range(10, 20), *range(45, 55), *range(80, 90)} else f"115w{i}" for i in range(104)) for k in range(3)}
    texts[n + 4] = " ".join(f"115w{i}" for i in range(104))
    want = {}
    for at in range(1, n + 5, 4):
        want |= brute_components({i: texts[i] for i in range(at, at + 4)})[0]
    assert 200 < sum(i == c for i, c in want.items()) < 1000
    got = {r.doc_id: r.component_id for r in minhash.find_components(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert got == want


def test_minhash_links_every_leader_of_buckets_of_two(spark):
    """Families whose last text has three leaders; the one neither least nor likeliest shares only buckets of two with it."""
    texts, n = {}, 0
    for f in (182, 477, 605, 833):
        words = [f"f{f}w{i}" for i in range(160)]
        for lo, hi in ((0, 38), (60, 91), (122, 160), (0, 0)):
            texts[n := n + 1] = " ".join(words[:lo] + words[hi:])
    want, _ = brute_components(texts)
    assert want == {i: i - (i - 1) % 4 for i in texts}
    rows = minhash.find_components(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_minhash_edges(docs, empty):
    rows = {r.doc_id: r for r in minhash.find_components(docs).collect()}
    assert rows[8].component_id == 6 and rows[2].n_shingles == 0 and rows[5].n_shingles == 1
    assert minhash.find_components(empty).count() == 0
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 8


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7, 8), (8, 7)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: root[i] for i in linked}


def test_components_not_settled_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(components, "MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="not settled"):
        components.connected_components(spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long"))
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "VECTORS_PER_CELL", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows = []
    for i in range(300):
        v = base[i % 60] + rng.normal(size=16) * rng.choice([0, 0.05, 0.12, 0.3])
        rows.append((i, v.tolist(), int(i % 3)))
    rows += [(300, rows[0][1], 0), (301, [0.0] * 16, 0), (302, None, 0), (303, [float("nan")] * 16, 0), (304, rows[0][1], None), (305, [None] * 16, 1), (306, [], 1), (307, [float("inf")] * 16, 1), (None, rows[0][1], 0)]
    rows += [(310, [1.0, 2.0, 3.0], 0), (311, [1.0, 2.0, 3.01], 0), (312, [3.0, 2.0, 1.0], 0), (313, [1.0, 2.0, 3.0], 1), (314, [2.0, 4.0, 6.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    ok = {i: (np.asarray(v) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and i <= 300}
    links = {i: [j for j in ok if j != i and ok[j][1] == ok[i][1] and ok[i][0] @ ok[j][0] >= 0.98] for i in ok}
    assert sum(map(len, links.values())) > 200
    seen = {}
    for i in sorted(ok):
        if i not in seen:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = i
                    todo += links[x]
    for i in ok:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links[i]), seen[i], seen[i] == i)
    for i in (*range(301, 308), None):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    for i, links, first in ((310, 2, 310), (311, 2, 310), (312, 0, 312), (313, 0, 313), (314, 2, 310)):
        assert (got[i].n_links, got[i].component_id) == (links, first)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_media_round_trip(spark, docs, empty):
    folder = shared_path(spark, "t-media")
    media.write_archives(docs, folder)
    spark.dataSource.register(media.ArchiveSource)
    members = spark.read.format("media_archive").option("rangeBytes", "200").load(folder)
    rows = media.media_features(members).collect()
    assert len(rows) == len(ROWS)
    texts = {r[0]: r[1] for r in ROWS}
    for r in rows:
        payload, n = media.payload_of(texts[r.doc_id] or "")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert len(payload) % 64 == 0 and len(payload) > 0
    assert rows and len({r.media_sha256 for r in rows if r.doc_id == 6}) == 1
    other = shared_path(spark, "t-media")
    media.write_archives(empty, other)
    assert spark.read.format("media_archive").load(other).count() == 0


def test_media_members_fail_alone(tmp_path, spark):
    with zipfile.ZipFile(f"{tmp_path}/a.zip", "w") as z:
        for i in range(3):
            z.writestr(f"{i}.0.png", media.encode_png(*media.payload_of(f"text {i}")))
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    with zipfile.ZipFile(f"{tmp_path}/a.zip") as z:
        at = z.getinfo("1.0.png").header_offset
    raw[at + 60] ^= 255
    (tmp_path / "a.zip").write_bytes(raw)
    reader = media.ArchiveReader({"path": f"file://{tmp_path}", "tries": "2"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["media"] is None for r in rows] == [False, True, False] and "checksum" in rows[1]["error"]


def test_language_profiles(spark, docs, empty):
    model = langid.train(spark.createDataFrame([("the quick brown fox and the dog " * 3, "en"), ("der schnelle braune fuchs und der hund " * 3, "de"), (None, "en"), ("123", "de")], "text string, lang string"))
    rows = {r.doc_id: r for r in langid.predict(spark.createDataFrame([(1, "the dog and the fox"), (2, "der hund und der fuchs"), (3, None), (4, "12 !"), (5, "")], "doc_id int, text string"), model).collect()}
    assert [rows[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in rows.values())
    out = langid.predict(docs, langid.train(langid.training_rows(docs)))
    assert out.count() == len(ROWS) and out.columns == [*docs.columns, "lang_pred", "score"]
    assert langid.train(langid.training_rows(empty)) == {} and langid.predict(docs, {}).filter("lang_pred <> 'und'").count() == 0


def test_language_bundle_equals_definition():
    texts = ["abca", "", "bb ab"]
    got = langid.bundle(texts, 128)
    for row, t in zip(got, texts, strict=True):
        want, s = np.zeros(128), f" {t} " if t else ""
        v = {c: langid.letter_vectors(np.asarray([ord(c)]), 128)[0].astype(int) for c in set(s)}
        for i in range(len(s) - 2):
            want += np.roll(v[s[i]], 2) * np.roll(v[s[i + 1]], 1) * v[s[i + 2]]
        assert (row == want).all()


def test_language_score_depends_on_the_text_alone(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    alone = [langid.bundle([t], 256) for t in texts]
    assert (langid.bundle(texts, 256) == np.concatenate(alone)).all()
    model = langid.train(spark.createDataFrame([("abc def abc " * 30, "x"), ("ghij hij g " * 30, "y")], "text string, lang string"))
    rows = [(i, t) for i, t in enumerate(texts * 2)]
    many = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1), model).collect()}
    few = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(rows, "doc_id int, text string").repartition(40), model).collect()}
    assert many == few and all(many[i] == many[i + 60] for i in range(60))


def test_language_bundle_of_long_texts_in_bounded_memory(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(langid, "GROUP_CHARS", 1000)
    monkeypatch.setattr(langid, "GRAMS", 64)
    text = langid.letters_of("".join(chr(0x4E00 + i * 7919 % 8000) for i in range(3000)) + " plain words here")
    want = np.zeros((1, 128))
    padded = np.frombuffer(f" {text} ".encode("utf-32-le"), "<u4")
    v = langid.letter_vectors(padded, 128).astype(int)
    for i in range(len(padded) - 2):
        want += np.roll(v[i], 2) * np.roll(v[i + 1], 1) * v[i + 2]
    assert (langid.bundle([text], 128) == want).all()
    monkeypatch.undo()
    big = "".join(chr(0x4E00 + i * 7919 % 8000) for i in range(400_000)) * 3
    tracemalloc.start()
    langid.bundle([big])
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.predict(d.filter(langid.held_out()), langid.train(langid.training_rows(d))).select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_mixing_rates(spark, docs, empty):
    many = spark.createDataFrame([(i, f"{'x' * 10}", "a" if i % 4 else "b") for i in range(4000)], "doc_id long, text string, source string")
    out = mixing.mix_sources(many, {"a": 0.5, "b": 0.5}).groupBy("source").count().collect()
    assert all(abs(r["count"] - 2000) < 200 for r in out)
    again = mixing.mix_sources(many.repartition(7), {"a": 0.5, "b": 0.5}).select("doc_id", "mix_copy").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, mixing.mix_sources(many, {"a": 0.5, "b": 0.5}).select("doc_id", "mix_copy").collect()))
    heavy = mixing.mix_sources(many.limit(20), {"a": 1.0, "b": 0.0}, epochs=900.0)
    n = heavy.count()
    assert abs(n - 18_000) < 800
    assert [r.mix_key for r in heavy.limit(50).collect()] == sorted(r.mix_key for r in heavy.limit(50).collect())
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == [*[c for c in docs.columns if c != "mix_key"], *mixing.ADDED] and mixed.count() > 0
    assert mixing.mix_sources(empty).count() == 0


def test_pipeline_stages_on_edges(spark, docs, tmp_path):
    import corpus_pipeline

    extra = [(100 + i, f"the quick brown fox number {i} jumps over the lazy dog by the river bank {i * i}", "en", "a", 1, "x", "k", 1) for i in range(20)]
    now = clashing(spark.createDataFrame([*ROWS, *extra, (150, extra[0][1], "en", "a", 1, "x", "k", 1)], DOCS))
    for name, stage in corpus_pipeline.STAGES:
        columns = now.columns
        path = f"{tmp_path}/{name}"
        stage(spark, now, str(tmp_path)).write.parquet(path)
        now = spark.read.parquet(path)
        if name == "mix_sources":
            assert now.columns == [c for c in columns if c not in mixing.ADDED]
        elif name != "packing":
            assert now.columns == columns
        ids = {r.doc_id for r in now.select("doc_id").collect()} if "doc_id" in now.columns else set()
        if name == "language_id":
            assert not ids & {2, 3, 4} and ids >= {1, 5, 6, 100}
        if name == "minhash_dedup":
            assert 150 not in ids and 100 in ids and 8 not in ids and 6 in ids
    assert now.count() > 0
