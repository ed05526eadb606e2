"""Ids at both ends of the long range, batches of any size, texts longer than a batch, and columns named like an operator's own."""

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_llm import brute_components, brute_suffix, corpus, near_copies
from vitalgrid.llm import jaccard_join, suffix_dedup
from vitalgrid.llm.common import text_bytes

ENDS = [2**63 - 1, -(2**63), 2**62 + 5, -(2**62) - 3, 2**61, 0]


def wide_ids(n):
    return [ENDS[i] if i < len(ENDS) else (-1) ** i * (2**61 + i * 977) for i in range(n)]



def test_op1_and_op2_with_ids_of_the_whole_range(spark):
    texts = corpus(5)
    ids = wide_ids(len(texts))
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = suffix_dedup.suffix_dedup(docs).select("doc_id", "n_removed", "kept").collect()
    small = [sorted(ids).index(i) for i in ids]
    want = suffix_dedup.suffix_dedup(spark.createDataFrame(list(zip(small, texts)), "doc_id long, text string")).select("doc_id", "n_removed", "kept").collect()
    at = dict(zip(small, ids))
    assert sum(r.n_removed for r in got) > 0
    assert {r.doc_id: (r.n_removed, r.kept) for r in got} == {at[r.doc_id]: (r.n_removed, r.kept) for r in want}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()} == brute_components(texts, ids)


def test_op1_anchors_do_not_depend_on_the_batch():
    texts = [t or "" for t in corpus(6)] + ["a" * 200, "ab" * 90, "é" * 80]

    def keyed(batch):
        raw, offsets = text_bytes(pa.array(batch))
        out = {}
        for doc, first, last, key in zip(*suffix_dedup.anchors(raw, offsets)):
            for p in range(first, last + 1):
                out[batch[doc], p - int(offsets[doc])] = int(key)
        return out

    together = keyed(texts)
    for t in texts:
        alone = keyed([t])
        assert len(alone) == max(0, len(t.encode()) - 49)
        assert all(together[k] == v for k, v in alone.items())


@pytest.mark.parametrize("size", [100, 1 << 20])
def test_op1_shards_of_any_size_give_one_result(spark, size, monkeypatch):
    plain = suffix_dedup.first_documents
    monkeypatch.setattr(suffix_dedup, "first_documents", lambda distinct, length: plain(distinct, length, shard_bytes=size))
    texts = near_copies(8, 24)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (len(t.encode()), r.n_removed, r.n_spans, bytes(r.kept)) for r, t in ((r, texts[r.doc_id]) for r in suffix_dedup.suffix_dedup(docs).collect())}
    assert got == brute_suffix(texts, list(range(len(texts))))


def test_op1_and_op2_with_a_text_longer_than_a_batch(spark):
    rng = np.random.default_rng(4)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**9, 160_000))  # 1.7 MB, over the batches of 1 MB
    docs = spark.createDataFrame([(1, long), (2, "head " + long), (3, long[-400:]), (4, "short")], "doc_id long, text string")
    out = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert [out[i].n_removed for i in (1, 2, 3, 4)] == [0, len(long), 400, 0]
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_op1_keeps_columns_named_like_its_own(spark):
    names = ["_id", "_row", "_text", "row", "spans", "_spans", "key", "mark", "seg", "doc", "start", "firsts", "_in", "_doc", "_vg_0", "id"]
    docs = spark.createDataFrame([(1, "x" * 60, *range(len(names))), (2, "x" * 70, *range(len(names)))], ["doc_id", "text", *names])
    out = suffix_dedup.suffix_dedup(docs).orderBy("doc_id").collect()
    assert [[r[n] for n in names] for r in out] == [list(range(len(names)))] * 2
    assert [r.n_removed for r in out] == [0, 70]
