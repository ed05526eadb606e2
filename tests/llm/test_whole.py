import random

import pytest

from vitalgrid.llm import decontaminate


def longest_common(a, b, least):
    """The longest run of words of ``a`` that is one of ``b``, where it is a window at least; else 0."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0] + [row[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        best = max(best, max(row))
    return best if b and best >= min(least, len(b)) else 0


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_op9_longest_match_equals_brute_force(spark, block):
    rng = random.Random(4)
    w = [f"w{i}" for i in range(60)]
    few = [f"v{i % 3}" for i in range(25)]
    items = [("A", w[:20]), ("B", w[4:40]), ("C", w[10:30] + w[10:50]), ("D", few), ("D", w[20:35]), ("E", ["one"]), ("F", ["two"]), ("A", w[:20])]
    texts = [w[4:40], w[:60], ["x"] * 5 + w[2:33] + ["y"] + w[15:45], few + few, w[10:30], w[15:35] + w[15:35], ["one", "two"], ["x"]]
    for _ in range(20):
        texts.append([x for _ in range(4) for i in [rng.randrange(45)] for x in w[i : i + rng.randrange(5, 30)]])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id string, text string")
    got = {r.doc_id: r.longest_match for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect()}
    assert got == {i: max(longest_common(t, b, 10) for _, b in items) for i, t in enumerate(texts)}
