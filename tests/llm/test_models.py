"""Scores of language ID and toxicity recomputed in plain Python, and packing against the optimum of small instances."""

import math

import numpy as np
import pyarrow as pa
import pytest

from vitalgrid.llm import language_id, packing, toxicity
from vitalgrid.llm.common import text_bytes


def plain_word(model, w):
    if w in model.tables[0]:
        return model.tables[0][w]
    marked = f"^{w}$"
    for size in (4, 3, 2, 1):
        parts = [marked[i : i + size] for i in range(len(marked) - size + 1)]
        known = [p in model.tables[size] for p in parts]
        if any(known):
            return [sum(model.tables[size][p][k] if ok else model.floors[size][k] for p, ok in zip(parts, known)) / len(parts) for k in range(len(model.langs))]
    return [0.0] * len(model.langs)


def test_op7_scores_equal_plain_python(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "the house and the tree", "en"), (4, "das haus und der baum", "de")] * 3
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["the dog", "Der HUND!", "dogs katzen", "zzz qqq", "xyzhaus the", "the " * 5000, "haus1baum"]
    got = language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        words = "".join(c if c.isalpha() else " " for c in r.text.lower()).split()
        total = np.sum([plain_word(model, w) for w in words], axis=0) / math.sqrt(len(words))
        share = np.exp(total - total.max())
        assert r.lang_pred == model.langs[int(np.argmax(total))]
        assert r.score == pytest.approx(float(share.max() / share.sum()), abs=1e-9)
    assert got[0].lang_pred == "en" and got[1].lang_pred == "de"


def test_op10_scores_equal_the_sum_over_all_pairs(spark):
    rng = np.random.default_rng(3)
    table = np.zeros((1 << toxicity.BITS, 1 + toxicity.FACTORS), np.float32)
    texts = ["you absolute fool", "Fool FOOL you", "", None, "ünder wörds here", "a b c " * 400]
    terms = {}
    for t in texts:
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        own = set()
        for w in words:
            _, bucket = toxicity.features(*text_bytes(pa.array([w])))
            own |= set(bucket.tolist())
        terms[t] = sorted(own)
        table[terms[t]] = rng.normal(0, 0.5, (len(own), 1 + toxicity.FACTORS))
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (table, -0.3)).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        v = table[terms[t]].astype(float)
        pairs = sum(float(v[i, 1:] @ v[j, 1:]) for i in range(len(v)) for j in range(i))
        z = -0.3 + v[:, 0].sum() + pairs / max(len(v), 1)
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
        assert r.predicted == int(r.score >= 0.5)


def fewest(lengths, cap):
    """The least number of sequences, by trying all ways."""
    best = len(lengths)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i, room in enumerate(bins):
            if room >= lengths[k] and room not in bins[:i]:
                put(k + 1, [*bins[:i], room - lengths[k], *bins[i + 1 :]])
        put(k + 1, [*bins, cap - lengths[k]])

    put(0, [])
    return best


def test_op4_reduction_costs_no_sequence():
    rng = np.random.default_rng(11)
    for _ in range(120):
        cap = int(rng.integers(8, 40))
        lengths = sorted(rng.integers(1, cap + 1, int(rng.integers(1, 9))).tolist(), reverse=True)
        n = np.bincount(lengths, minlength=cap + 1)
        fixed = packing.reduce_dominant(n, cap)
        rest = [w for w in range(cap, 0, -1) for _ in range(n[w])]
        assert sum(many for _, many in fixed) + fewest(rest, cap) == fewest(lengths, cap)
