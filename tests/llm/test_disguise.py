"""Toxic words in disguise: what a reader takes them for, and scores of documents that hold them."""

import numpy as np
import pyarrow as pa
import pytest

from vitalgrid.llm import disguise, toxicity
from vitalgrid.llm.common import text_bytes

WAYS = ["5c0undr3l", "SC0UNDREL", "s.c.o.u.n.d.r.e.l", "s c o u n d r e l", "s*c*o*u*n*d*r*e*l", "scooouundrel", "scöundrèl", "sсоundrеl", "sco​und­rel", "scoun-drel", "$coundrel", "ｓｃｏｕｎｄｒｅｌ"]


def seen(*texts):
    code, letter, doc = disguise.letters(*text_bytes(pa.array(texts, pa.string())))
    text = "".join(chr(96 + c) if ok and c else "?" if ok else " " for c, ok in zip(code.tolist(), letter.tolist()))
    return [" ".join("".join(t if d == i else " " for t, d in zip(text, doc.tolist())).split()) for i in range(len(texts))]


@pytest.mark.parametrize("way", WAYS)
def test_disguised_words_are_read_as_the_word(way):
    assert seen(f"the {way}, of", "", None, way) == ["the scoundrel of", "", "", "scoundrel"]


def test_other_text_stays_in_its_words():
    assert seen("a b", "an $5 2008 fee!! Oh", "sc*undrel", "a", "b", "c", "e.g. no", "x\U0001f600y") == ["a b", "an fe oh", "sc?undrel", "a", "b", "c", "eg no", "x y"]


def test_stretches_equal_plain_python_and_used_only_leaves_out():
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdé 1.*"), int(rng.integers(0, 60)))) for _ in range(50)]
    raw, offsets = text_bytes(pa.array(texts))
    number = lambda s: sum(c << 5 * k for k, c in enumerate(reversed(s)))
    want = set()
    for i, t in enumerate(seen(*texts)):
        for w in t.split():
            c = [0 if x == "?" else ord(x) - 96 for x in w]
            want |= {(i, number(c[k : k + 3])) for k in range(len(c) - 2)}
            for k in range(len(c) - 3):
                a, b, d, e = c[k : k + 4]
                want |= {(i, number(x)) for x in ((a, b, d, e), (a, 0, d, e), (a, b, 0, e))}
    doc, code = disguise.stretches(raw, offsets)
    assert set(zip(doc.tolist(), code.tolist())) == want
    used = rng.random(1 << toxicity.BITS) < 0.5
    doc, bucket = toxicity.features(raw, offsets)
    some = toxicity.features(raw, offsets, used=used)
    assert np.array_equal(some[0], doc[used[bucket]]) and np.array_equal(some[1], bucket[used[bucket]])


def test_op10_finds_disguised_words(spark):
    rng = np.random.default_rng(4)
    syllables = ["the", "er", "in", "an", "ti", "re", "ea", "ou", "st", "ha"]
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))
    text = lambda *put: " ".join([word() for _ in range(20)] + list(put) + [word() for _ in range(20)])
    rows = [(i, text("scoundrel") if i % 5 == 0 else text()) for i in range(600)]
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int"))
    texts = [text() for _ in range(100)] + [text(w) for w in [*WAYS, "xxscoundrel", "scoundrelish", "superscoundrels", "scoumdrel"]]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert min(got[i] for i in range(100, len(texts))) > max(got[i] for i in range(100))
