import random

import pytest

from vitalgrid.llm import jaccard_join
from vitalgrid.llm.queries import QUERIES


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_links(texts, ids):
    s = {i: shingle_set(t or "") for i, t in zip(ids, texts)}
    near = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    return {i: (len(s[i]), sum(near(s[i], s[j]) for j in s if j != i)) for i in s}


def family(seed, n, words=80, edits=2):
    """Different near copies of one text, two equal ones, and strangers."""
    rng = random.Random(seed)
    base = [f"b{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return [*out, out[0], out[1], "", None, "two words", "Two words", *[" ".join(f"s{rng.randrange(10**6)}" for _ in range(40)) for _ in range(5)]]


@pytest.mark.parametrize("block", [512, 4])
def test_op2_pairs_and_links_equal_brute_force(spark, block):
    texts = family(1, 30) + family(2, 12, 30, 1)
    ids = random.Random(3).sample(range(1000), len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    want = brute_links(texts, ids)
    assert max(n for _, n in want.values()) > 5
    assert {r.doc_id: (r.n_shingles, r.n_links) for r in jaccard_join.near_links(docs, block=block).collect()} == want
    s = dict(zip(ids, (frozenset(shingle_set(t or "")) for t in texts)))
    first = sorted({min(j for j in ids if s[j] == s[i]) for i in ids if s[i]})
    pairs = {(a, b) for a in first for b in first if a < b and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])}
    signs = jaccard_join._classes(docs, "doc_id", "text").filter("n > 0")
    assert {(r.a, r.b) for r in jaccard_join.pairs(docs, signs, "doc_id", "text", hot=2, block=block).collect()} == pairs


def test_op2_links_are_registered(spark):
    assert QUERIES["op2_jaccard_links"](spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_shingles", "component_id", "n_links"]
