"""The piece codec against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import piece_codec
from vitalgrid.llm.queries import op11_sentencepiece, vocabulary

PATH = vocabulary("piece_bpe_32k.model")
MODEL = piece_codec.read_model(PATH)
TEXTS = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "\ta\r\n\n b", "▁", "▁▁x ▁", "   many    spaces         here" + " " * 37, "x" * 5000, "ab" * 3000 + "\n" * 50, "</s><s><unk><0x0A>",
    "naïve Ünïcödé ÿ × ÷", "日本語のテキスト 執 梦", "😀👍🏽 é ​﻿ ", "\x00\x01\x7f", "0123456789 3.14e-10", "internationalization untranslatable", "\U0010ffff�",
    "A" * 31 + " " + "=" * 200 + "-" * 77, "https://example.com/a?b=c&d=e#f", " line sep", "aaaa" * 16 + "b",
]


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_encode_and_decode_equal_the_library(spark):
    lib = library()
    docs = spark.createDataFrame([(i, t, "old", i) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, ids string, decoded long")
    got = piece_codec.decode(piece_codec.encode(docs, MODEL), MODEL).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        want = lib.encode(TEXTS[r.doc_id % len(TEXTS)] or "", add_eos=True)
        assert r.ids == want, repr(r.text)
        assert r.decoded == lib.decode(want), repr(r.text)
    assert sorted(map(repr, piece_codec.round_trip(docs, MODEL).collect())) == sorted(map(repr, got))
    assert piece_codec.encode(docs.limit(0), MODEL).count() == 0
    assert piece_codec.encode(docs, MODEL, end=False).filter("doc_id = 1").first().ids == []


def test_random_texts_equal_the_library():
    lib, c, rng = library(), piece_codec.codec(MODEL), random.Random(5)
    pieces = [p for p in c.scores]
    alphabets = ["ab", "etaoin shr", "▁ x", "abcdefghijklmnopqrstuvwxyz   \n", "äöüßéèñ ", "0123456789.,-", "漢字かな한글 ab"]
    for n in range(3000):
        text = "".join(rng.choice(pieces).replace("▁", " ") for _ in range(rng.randint(1, 12))) if n % 2 else "".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(1, 60)))
        assert np.frombuffer(c.encode(text), np.int32).tolist() == lib.encode(text), repr(text)


def test_every_piece_and_pairs_of_pieces():
    """Pieces that no text gives must not be found; neighbours that merge must be told from those that stay."""
    lib, c, rng = library(), piece_codec.codec(MODEL), random.Random(6)
    pieces = [p.replace("▁", " ") for p in c.scores]
    for text in [*pieces, *[rng.choice(pieces) + rng.choice(pieces) for _ in range(20_000)]]:
        assert np.frombuffer(c.encode(text), np.int32).tolist() == lib.encode(text), repr(text)


def test_decode_of_any_ids(spark):
    lib, c, rng = library(), piece_codec.codec(MODEL), random.Random(7)
    some = list(range(0, 300)) + [c.scores[p][1] for p in ("▁", "▁▁", "▁the", "é", "x")]
    lists = [[rng.choice(some) for _ in range(rng.randint(1, 12))] for _ in range(3000)]
    for ids in lists:
        assert c.decode(np.array(ids)) == lib.decode(ids), ids
    rows = spark.createDataFrame([(1, [None, 3 + 65]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in piece_codec.decode(rows, MODEL).collect()} == {1: "A", 2: "", 3: ""}


def test_walk_steps_back_and_marks_places():
    """A small alphabet of merges in which the longest piece is often wrong."""
    c = piece_codec.codec(MODEL)
    seen = 0
    for text in ("▁unhappinesses", "ationsing", "▁interestingly", "eresting", "ttthhheee" * 40):
        assert [c.pieces[i] for i in c.walk(text)] == c.merged(text)
        seen += c.walk(text)[0] != max((i for p, (_, i) in c.scores.items() if text.startswith(p)), key=lambda i: len(c.pieces[i]))
    assert seen


def test_other_models_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(MODEL)
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        piece_codec.Codec(proto.SerializeToString())


def test_op11_whole_table(spark):
    lib = library()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = op11_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = lib.encode(docs[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)))


def test_long_text(spark):
    text = " ".join(f"word{i % 977} naïve" for i in range(60_000)) + "q" * 300_000
    r = piece_codec.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), MODEL).select(F.size("ids"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)).first()
    want = library().encode(text, add_eos=True)
    assert tuple(r) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
