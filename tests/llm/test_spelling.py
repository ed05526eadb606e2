"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from vitalgrid.llm import spelling


def edits(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(counts, ratio=10):
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), None if form[w] is None else counts[form[w]])
    return out


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def rows(df):
    got = df.collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


def lexicon(seed):
    rng = random.Random(seed)
    letters = "abcé×ÀB" if seed % 2 else "aab"
    out = {}
    for _ in range(250):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        out[w] = rng.choice([1, 2, 3, 20, 30, 250, 3000])
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(w) + 1)
            v = rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k + 1 :]])
            if v:
                out.setdefault(v, rng.choice([1, 2, 30, 300]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_equal_all_pairs(spark, seed):
    counts = lexicon(seed)
    got = rows(spelling.variants(table(spark, counts)))
    assert got == brute(counts)
    assert any(v[3] > 1 for v in got.values()) and any(v[0] for v in got.values())


def test_chains_ties_and_middles(spark):
    counts = {"abcdefg": 10**6, "abcdefgh": 10**5, "abcdefghi": 10**4, "abcdefghij": 10**3, "abcdefghijk": 100, "abcdefghijkl": 10, "abcdefghijklm": 1, "zzzzzzz": 2, "zzzyzzz": 20, "zzzxzzz": 20, "aaaaaaa": 5, "aaaaaaaa": 5, "alone": 1}
    got = rows(spelling.variants(table(spark, counts)))
    assert got == brute(counts)
    assert got["abcdefghijklm"][1] == "abcdefg" and got["zzzzzzz"][0] == "zzzxzzz"


def test_a_crowd_with_one_beginning(spark):
    """Words that share their first half and differ by a letter or two in the last one."""
    rng = random.Random(4)
    counts = {"prefixprefix" + "".join(rng.choice("abc") for _ in range(rng.randint(4, 6))): rng.randint(1, 40) for _ in range(400)}
    assert rows(spelling.variants(table(spark, counts))) == brute(counts)


def test_counts_of_texts(spark):
    rng = random.Random(5)
    stems = ["Geschäft", "naïveté", "ÀRBITRARY", "Wörter×÷x", "international", "internation", "short"]
    texts = [None, "", "1234567 -- ...", *[" ".join(rng.choice(stems) + rng.choice(["", "s", ", ", "1"]) for _ in range(rng.randint(1, 60))) for _ in range(120)]]
    want = Counter()
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    docs = [(i // 2, t) for i, t in enumerate(texts)]
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = low(run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            want[run] += 1
    want = {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    counted = spelling.word_counts(frame, respell=spelling.misspelt)
    assert {r.word: r.n for r in counted.collect()} == want
    assert rows(spelling.variants(counted)) == brute(want)
    assert spelling.variants(spelling.word_counts(frame.limit(0))).count() == 0
    assert spelling.misspelt(None, "unchanged") == "unchanged"


def test_long_words_and_texts(spark):
    long = "x" * 200_000
    docs = spark.createDataFrame([(1, long), (2, long), (3, long + "y"), (4, long + "y"), (5, "wordword " * 100_000)], "doc_id long, text string")
    got = rows(spelling.variants(spelling.word_counts(docs)))
    assert {len(w): v[2:4] for w, v in got.items()} == {200_000: (2, 1), 200_001: (2, 1), 8: (100_000, 0)}


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    """Spark sizes them by their compressed files and takes an explode for one row a row: small tables for it, not for the driver."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans, keep = [], spelling.written

    def written(df, name):
        plans.append(plan(df))
        return keep(df, name)

    monkeypatch.setattr(spelling, "written", written)
    out = spelling.variants(table(spark, lexicon(1)))
    plans.append(plan(out))
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("BroadcastHashJoin" in p for p in plans)
