"""Operators on single documents and on pairs, against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import public_tokenizers as tok
import pytest

from lorewell.llm import bpe, near_dedup, pii, secrets, winnow
from lorewell.llm.bpe import BpeTransducer, Utf8Machine, bpe_encode, codec, load_ranks, merge_encode
from lorewell.llm.dac import DacFile, pack, token_ids
from lorewell.llm.textvec import shingle_sets

from . import fixtures


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.docs(spark).cache()


def empty(spark):
    return spark.createDataFrame([], fixtures.SCHEMA)


def by_id(rows):
    out = defaultdict(list)
    for r in rows:
        out[r["doc_id"]].append(r)
    return out


def expected(make):
    out = defaultdict(list)
    for r in fixtures.rows():
        out[r[0]].append(make(r[1] or ""))
    return out


def test_bpe_equals_tiktoken(spark, docs):
    import tiktoken

    path = tok.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    got = by_id(bpe_encode(docs, path, tok.PATTERN, stream_ids=7).collect())
    for i, want in expected(lambda t: (enc.encode_ordinary(t), t)).items():
        assert [(r["ids"], r["decoded"]) for r in got[i]] == want
    digests = by_id(bpe_encode(docs, path, tok.PATTERN, output="digests").collect())
    for i, want in expected(lambda t: (len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest())).items():
        assert [(r["n_tokens"], r["decoded_sha256"]) for r in digests[i]] == want
    assert bpe_encode(empty(spark), path, tok.PATTERN).count() == 0


def test_arcs_to_a_state_are_one_object(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_PAIRS", 20)
    ranks = load_ranks(tok.path("byte_bpe_multi_50k.tiktoken"))
    fst, codes = BpeTransducer(ranks), {r.to_bytes(4, "little"): t for t, r in ranks.items()}
    rng = random.Random(4)
    for _ in range(400):
        piece = "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 12))).encode()
        ids = fst.encode_piece(piece)
        assert [codes[ids[i : i + 4]] for i in range(0, len(ids), 4)] == ([piece] if piece in ranks else merge_encode(piece, ranks))
        assert len(fst.follows) <= 20
    assert len({id(arc) for arc in fst.arcs.values()}) < len(fst.info) < len(fst.arcs)


def test_every_byte_walks_the_transducer():
    ranks = load_ranks(tok.path("byte_bpe_multi_50k.tiktoken"))
    codes = {r.to_bytes(4, "little"): t for t, r in ranks.items()}
    fst = BpeTransducer(ranks, max_states=50)  # so small that it is emptied again and again
    for piece in (b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " internationalisation".encode(), " the".encode(), "übermäßigkeit".encode(), b"=" * 99, bytes(range(256)), b"abracadabra" * 500):
        fst.steps = 0
        ids = fst.encode_piece(piece)
        assert fst.steps == len(piece)
        merged = merge_encode(piece, ranks)
        assert [codes[ids[i : i + 4]] for i in range(0, len(ids), 4)] == ([piece] if piece in ranks else merged)
        out, waiting, most = [], 0, 0

        def read():
            nonlocal waiting, most
            for byte in piece:
                waiting += 1
                most = max(most, waiting)
                yield byte

        for some in fst.stream(read()):  # tokens leave after a bounded lookahead
            out += some
            waiting -= sum(map(len, some))
        assert out == merged and most <= 3 * fst.longest


def test_utf8_machine():


    rng = random.Random(4)
    texts = ["aé€😀".encode()[i:j] for i in range(10) for j in range(11)] + [bytes(rng.choice([0x41, 0x80, 0xBF, 0xC1, 0xC3, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xF5, 0xFF]) for _ in range(rng.randrange(9))) for _ in range(4000)]
    for data in texts:
        text, state = Utf8Machine.run(Utf8Machine.REST, data)
        assert text + ("\ufffd" if state != Utf8Machine.REST else "") == data.decode("utf-8", "replace")
    c = codec(tok.path("byte_bpe_multi_50k.tiktoken"), tok.PATTERN)
    for data in texts:
        ids = b"".join(c.fst.codes[bytes((x,))] for x in data)
        for size in (4, 8, 400):
            assert "".join(c.decode_stream(ids[i : i + size] for i in range(0, len(ids), size))) == data.decode("utf-8", "replace")


def test_token_files(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tok.path("byte_bpe_50k.json"))
    got = sorted(token_ids(docs, tok.path("byte_bpe_50k.json")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in fixtures.rows()), key=lambda x: -1 if x is None else x)
    want = expected(lambda x: t.encode(x, add_special_tokens=False).ids + [0])
    start = 0
    for r in got:
        ids = want[r["doc_id"]][0]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
        start += len(ids)
    assert token_ids(empty(spark), tok.path("byte_bpe_50k.json")).count() == 0


def test_units_equal_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from lorewell.llm.dac import encoder

    path = tok.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    texts = ["x<|endoftext|>y", "a <|endoftext|> b c", "it's we'll, o'clock.\nNext \u0301x", "a\u00a0b c", "one two. one two!\nThree", " lead", "trail ", "", "\n", "1st 2.5x a1 'tis", "日本 語 ﬁn ǆ×÷ é.é", "a,b;c? d!)\n\ne f\n", "Ω l'été d'un"]
    assert encoder(path).encode(pa.array(texts)) == [b"".join(i.to_bytes(4, "little") for i in t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_random_access():
    import numpy as np

    ids = np.random.default_rng(1).integers(0, 1 << 24, 3000).astype("<u4")
    ids[::3] %= 256
    f = DacFile(pack(ids, np.array([5]), np.array([0, 3000])) + b"\n")
    assert [f.get(i) for i in range(3000)] == ids.tolist()
    for a, b in ((0, 0), (0, 3000), (511, 513), (2999, 3000)):
        assert f.slice(a, b).tolist() == ids[a:b].tolist()


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


@pytest.mark.parametrize("most", [3, 200_000])
def test_components_against_union_find(spark, most):
    """Random links, a path and a star, folded in one forest and in many small ones."""
    rng = random.Random(5)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(80)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((top(a), top(b)))
            root[y] = x
    name = lambda i: i.to_bytes(4, "big")
    links = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "a binary, b binary").repartition(3)
    got = {(int.from_bytes(r.node), int.from_bytes(r.root)) for r in near_dedup.components(links, most).collect()}
    assert got == {(x, top(x)) for x in list(root)}
    assert near_dedup.components(links.where("false"), most).count() == 0


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, k, num):
    rows = [(i, shingles(t or "", k)) for i, t, *_ in fixtures.rows()]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both, every = len(rows[a][1] & rows[b][1]), len(rows[a][1] | rows[b][1])
            if rows[a][1] and rows[b][1] and 100 * both >= num * every:
                group[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(rows):
        least[find(a)] += [] if i is None else [i]
    want = sorted((str(i), len(s), str(min(least[find(a)], default=None))) for a, (i, s) in enumerate(rows))
    got = near_dedup.near_duplicates(docs, k, num / 100).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_chain_of_links(spark):
    """Each text is linked to the next only, so a hub doesn't reach all."""
    words = [f"w{i}" for i in range(200)]
    chain = [" ".join(words[i : i + 100]) for i in range(0, 60, 4)]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(chain)), "doc_id long, text string"), 3, 0.85).collect()
    assert {r["component_id"] for r in got} == {0}


def test_set_hashes_tell_sets_apart():
    for k in (1, 3):
        sets = [len(s) for s in shingle_sets([(t or "").encode() for t in fixtures.texts()], k)]
        assert sets == [len(shingles(t or "", k)) for t in fixtures.texts()]
    big = " ".join(f"word{i}" for i in range(300_000))  # longer than a slice
    assert len(next(shingle_sets([big.encode()], 3))) == 299_998


BASE_SECRETS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
)


def test_secrets(spark, docs):
    def want(text):
        spans = sorted((m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, rx, ok) in enumerate(BASE_SECRETS) for m in rx.finditer(text) if ok(m))
        return hashlib.sha256(",".join(s for _, _, s in spans).encode()).hexdigest(), len(spans)

    got = by_id(secrets.secret_report(docs).collect())
    for i, w in expected(want).items():
        assert [(r["base_sha256"], r["n_assign"] + r["n_access"] + r["n_hex"]) for r in got[i]] == w
    assert any("github" in r["spans"] for rows in got.values() for r in rows)
    assert secrets.secret_report(empty(spark)).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query(r"[0-9a-f]{16,}") is True
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == secrets.all_of(b"aki", b"kia")
    either = secrets.trigram_query(r"(abc|defg)x*")
    assert either == secrets.any_of(b"abc", secrets.all_of(b"def", b"efg"))
    index = secrets.TrigramIndex([b"abc", b"xdefgx", b"def efg", b"DEFG", b""], secrets.trigrams_of(either))
    assert index.search(either).tolist() == [0, 1, 2, 3]
    assert secrets.redacted("a secretx b", [("assign", 2, 9)]) == "a [assign] b"


def luhn_ok(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


BASE_PII = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn_ok(re.sub("[^0-9]", "", s))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
)


def test_pii(spark, docs):
    def want(text):
        spans = [f"{kind}:{m.start()}:{m.end()}" for kind, rx, ok in BASE_PII for m in rx.finditer(text) if ok(m[0])]
        return hashlib.sha256(",".join(spans).encode()).hexdigest(), len(spans)

    got = by_id(pii.pii_report(docs).collect())
    for i, w in expected(want).items():
        assert [(r["base_sha256"], r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]) for r in got[i]] == w
    every = ",".join(r["spans"] for rows in got.values() for r in rows)
    assert "iban:" in every and "ssn:" in every
    assert pii.pii_report(empty(spark)).count() == 0


def test_pii_hostile_texts(spark):
    """Texts that would make a recursive or a retrying pattern fail."""
    hostile = ["1 " * 60_000, "a." * 60_000, "1." * 60_000 + "x", "a@" + "b." * 40_000, "+1" + "(" * 100_000, "9" * 100_000]
    got = pii.pii_report(spark.createDataFrame(list(enumerate(hostile)), "doc_id long, text string")).collect()
    assert len(got) == len(hostile)


def test_winnowing(spark, docs):
    rows = sorted(((-(1 << 63) if i is None else i, t or "") for i, t, *_ in fixtures.rows()), reverse=True)
    got = by_id(winnow.edited_likeness(docs).collect())
    same, prints, following = {}, {}, []
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        mine = got[None if i == -(1 << 63) else i]
        assert hashlib.sha256(edited.encode()).hexdigest() in [r["edited_sha256"] for r in mine]
        assert all(r["n_chars"] == len(text) and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in mine)
        assert same.setdefault(text, mine[0]["fingerprint"]) == mine[0]["fingerprint"]
        told = lambda f: {w.split(":")[1] for w in f.split(",") if w}
        share = lambda f, g: len(told(f) & told(g)) / len(told(f) | told(g)) if told(f) | told(g) else 1.0
        prints.setdefault(text, mine[0]["fingerprint"])
        assert all(abs(r["near_edited"] - share(r["fingerprint"], r["edited_fingerprint"])) < 1e-12 for r in mine)
        following.append((mine, after, share))
    for mine, after, share in following:
        if len(mine) == 1:
            assert abs(mine[0]["near_next"] - share(mine[0]["fingerprint"], prints[after])) < 1e-12
    assert winnow.edited_likeness(empty(spark)).count() == 0
    one = winnow.edited_likeness(spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")).collect()
    assert one[0]["near_next"] == 1.0


def test_winnowing_chooses_minima_and_keeps_its_guarantee(spark):
    from pyspark.sql import functions as F



    rng = random.Random(5)
    shared = [rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(10)]  # k + w - 1 words
    a = " ".join([f"x{i}" for i in range(31)] + shared + [f"y{i}" for i in range(7)])
    b = " ".join([f"u{i}" for i in range(4)] + shared + [f"v{i}" for i in range(50)])
    df = winnow.fingerprints(spark.createDataFrame([(1, a), (2, b), (3, "same " * 50)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in df.collect()}
    assert set(got[1]["hashes"]) & set(got[2]["hashes"])
    assert got[3]["positions"] == list(range(7, 48))  # all hashes tie: the rightmost of each window
    grams = spark.createDataFrame([(1, a.split(" "))], "doc_id long, w array<string>").select(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(*(F.xxhash64(F.get("w", i + j)) for j in range(3)))).alias("h")).first()["h"]
    want = sorted({max(range(i, i + 8), key=lambda p: (-grams[p], p)) for i in range(len(grams) - 7)})
    assert got[1]["positions"] == want
    assert got[1]["hashes"] == [grams[p] for p in want]  # whole hashes: no bits go to positions


def test_next_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(winnow, "ROWS_PER_BUCKET", 3)
    monkeypatch.setattr(winnow, "_FINE", 4)
    ids = [i * i for i in range(100)]
    got = {r["doc_id"]: r["next_text"] for r in winnow.with_next(spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")).collect()}
    assert got == {i: f"t{ids[n - 1]}" for n, i in enumerate(ids)}


def test_secrets_hostile_texts():
    """Long runs that begin a match over and over take time in proportion to their length."""
    import time

    for piece in ("eyJ", "eyJaaaaaaaa.", "eyJaaaaaaaa.eyJaaaaaaaa.", "AKIA", "token", "password:", "xoxb-", "ghp_", "AIza", "-----BEGIN ", "0123456789abcde "):
        text = piece * (400_000 // len(piece))
        began = time.process_time()
        secrets.scan([text], secrets.BASE_RULES + secrets.MORE_RULES)
        assert time.process_time() - began < 5, piece


def test_kept_tables_are_dropped_when_idle():
    import time

    from lorewell.llm.common import Kept

    kept, made = Kept(idle=0.2), []
    assert kept.get("a", lambda: made.append(1) or "x") == kept.get("a", lambda: "y") == "x"
    time.sleep(1)
    assert not kept.found and kept.get("a", lambda: "z") == "z"
