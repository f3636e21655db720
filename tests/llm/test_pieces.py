"""Exact merge-type encoding against the sentencepiece library and against plain merging."""

import hashlib
import random

import numpy as np
import public_tokenizers as tok
import pyarrow as pa
import pytest
import sentencepiece

from lorewell.llm.piece_bpe import BacktrackingEncoder, PieceCodec, merge_pieces, piece_encode

MODEL = tok.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return PieceCodec(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def same(codec, library, texts):
    for text, got, want in zip(texts, codec.encode(pa.array(texts, pa.string())), library.encode(texts)):
        ids = np.frombuffer(got, "<u4")
        assert ids.tolist() == want, text[:100]
        assert codec.decode(ids) == library.decode(want)


def test_hand_made_texts(codec, library):
    same(codec, library, ["", " ", "  ", " a", "a  b ", "▁x", "▁▁", "a\x00b", "ﬁ Ａ ½ é", "\r\n\t", " " * 3000, "a" * 20_000, "ab" * 10_000, "日本語テキスト漢字", "😀 ok😀", "x.²..y", "<s> </s> <0x41>"])


def test_random_texts(codec, library):
    rng = random.Random(11)
    letters = "aábc de▁ tion ing  he日ｱ\n.éеп0123,²."
    pieces = list(codec.encoder.ranks)
    same(codec, library, ["".join(rng.choices(letters, k=rng.randint(0, 60))) for _ in range(5000)])
    same(codec, library, ["".join(rng.choices(pieces, k=rng.randint(0, 30))) for _ in range(3000)])


def test_small_tables_change_nothing(library):
    rng = random.Random(5)
    words = [" ".join("".join(rng.choices("abetion", k=rng.randint(1, 9))) for _ in range(50)) for _ in range(20)]
    same(PieceCodec(MODEL, max_parts=3), library, words)


def test_decoding_of_any_ids(codec, library):
    rng = random.Random(7)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32_000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 12))]
        assert codec.decode(np.array(ids, "<u4")) == library.decode(ids), ids


def test_search_equals_merging():
    """Random vocabularies, with pieces that merging never makes, equal ranks and characters without a piece of their own."""
    rng = random.Random(3)
    for _ in range(200):
        pieces = {"".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 25))}
        ranks = {p: float(rng.randint(1, 12)) for p in sorted(pieces)}
        encoder = BacktrackingEncoder(ranks)
        letters = sorted(set("".join(pieces)))
        for _ in range(60):
            text = "".join(rng.choices(letters, k=rng.randint(1, 30)))
            assert [encoder.strings[i] for i in encoder.encode(text)] == merge_pieces(text, ranks), (text, ranks)


def test_whole_table(spark, library):
    rows = [(1, "Ein Satz, noch einer.", "x"), (1, "Ein Satz, noch einer.", "x"), (None, "  two  ", "y"), (3, None, None), (4, "", ""), (5, "naïve 漢 " * 5000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, piece_encode(docs, MODEL, output="digests").collect()), key=str)
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    texts = {r.doc_id: r for r in piece_encode(docs, MODEL).collect()}
    assert texts[5].ids == library.encode(rows[5][1]) and texts[5].decoded == rows[5][1] and texts[4].ids == []
    assert piece_encode(docs.limit(0), MODEL).count() == 0
