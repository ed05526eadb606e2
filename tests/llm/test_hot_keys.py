"""Words that sums of powers confuse, and joins that Spark can split by skew."""

import re

import numpy as np
import pytest

from vitalgrid.llm import common, decontaminate, jaccard_join, suffix_dedup, warc


def thue_morse(a, b, n=10):
    """Two strings of 2^n letters whose sums of letter times base^i agree modulo 2^64, whatever the odd base."""
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_confusable_words_stay_apart(spark):
    a, b = thue_morse("a", "b")
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()} == {(k, k) for k in (1, 2, 3, 4)}
    items = spark.createDataFrame([("q", a)], "item_id string, text string")
    assert {(r.doc_id, r.n_hit) for r in decontaminate.decontaminate(docs, items).collect()} == {(1, 1), (2, 0), (3, 1), (4, 0)}


def test_hashes_tell_all_strings_apart():
    rng = np.random.default_rng(1)
    texts = {bytes(rng.integers(0, 2, n).astype(np.uint8) + 97) for n in range(1, 90) for _ in range(60)} | {b"a" * n for n in range(1, 200)} | {b"ab" * 8, b"ba" * 8}
    texts |= {t.encode() for n in range(3, 11) for t in thue_morse("a", "b", n)}
    raw, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    ends = np.cumsum(size)
    found = common._hashes(raw, ends - size, ends)
    assert len(set(found.tolist())) == len(texts)
    for t, h in zip(list(texts)[:50], found):
        assert common._hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0] == h


def joins(plan):
    """For each sort-merge join of a plan, its keys and what feeds the sorts on both sides."""
    lines = [(re.match(r"[\s:+-]*", x).end(), re.sub(r"^[\s:+-]*(\*\(\d+\) )?", "", x)) for x in plan.splitlines() if x.strip()]
    for k, (depth, text) in enumerate(lines):
        if text.startswith("SortMergeJoin"):
            fed = []
            for j in range(k + 1, len(lines)):
                if lines[j][0] <= depth:
                    break
                if lines[j][1].startswith("Sort ") and not any(lines[i][1].startswith("SortMergeJoin") and lines[i][0] < lines[j][0] for i in range(k + 1, j)) and len(fed) < 2:
                    fed.append(lines[j + 1][1].split(" ")[0])
            yield text, fed


@pytest.mark.parametrize("name", ["op1", "op2", "op5"])
def test_hot_joins_come_from_exchanges(spark, monkeypatch, name):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(k, text) for k in range(30)] + [(100 + k, " ".join(f"w{k}x{j % 50}" for j in range(60))) for k in range(30)] + [(200 + k, text + f" {k}") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans, real = [], common.written

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label)

    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for module in (jaccard_join, suffix_dedup, warc):
            monkeypatch.setattr(module, "written", seen)
        out = {
            "op1": lambda: suffix_dedup.suffix_dedup(docs), "op2": lambda: jaccard_join.near_duplicates(docs),
            "op5": lambda: warc.deduplicate(docs.selectExpr("doc_id as page_id", "'u' as url", "text as html")),
        }[name]()
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        assert out.count() == len(rows)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    found = [j for p in plans for j in joins(p)]
    assert found
    one = r"\[(_id|id|sid|doc|_doc|a|b|doc_id|key#\d+L, mark)"  # a document's own number, or what first_documents made of a key
    for text, fed in found:
        if not re.search(one, text):
            assert fed and set(fed) == {"Exchange"}, (text, fed)
