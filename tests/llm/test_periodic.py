"""Periodic runs against all stretches of all periods."""

import numpy as np

from vitalgrid.llm import periodic

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(w, shortest=12):
    """Every maximal stretch of equal words q apart; of stretches of the same words the smallest q."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(shortest, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def texts(seed=0):
    rng = np.random.default_rng(seed)
    out = [None, "", "  \n\t ", "one", "a " * 11, "a " * 12, "a\x0bb\x0c" * 6, "a b " * 5 + "a b c", "  x " * 20, "  " * 13]
    for n in range(150):
        some = [f"w{k}" for k in range(rng.integers(1, 6))]
        w = list(rng.choice(some, rng.integers(0, 90)))
        if n % 3 == 0:
            unit = [f"u{k}" for k in rng.integers(0, 40, rng.integers(1, 20))]
            at = int(rng.integers(0, len(w) + 1))
            w[at:at] = (unit * 6)[: int(rng.integers(5, 100))]
        if n % 5 == 0:
            w = w + [f"x{k}" for k in range(30)] + w
        out.append(" ".join(w))
    a, b = ["a"], ["a", "b"]
    for _ in range(9):
        a, b = b, b + a
    out.append(" ".join(b))  # a Fibonacci word: as many runs as can be
    t = "a"
    for _ in range(8):
        t = t + t.translate({97: 98, 98: 97})
    return [*out, " ".join(t), " ".join(t.replace("a", "abc"))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(rows)], "doc_id long, text string, runs string, collapsed long")


def test_runs_equal_brute_force(spark):
    rows = texts()
    for shortest in (12, 5):
        got = periodic.periodic_runs(frame(spark, rows), shortest).collect()
        assert len(got) == len(rows)
        for r in got:
            w = words(r.text)
            want = brute(w, shortest)
            assert r.n_words == len(w) and [tuple(x) for x in r.runs] == want, r.text
            gone = {k for s, n, q in want for k in range(s + q, s + n)}
            assert r.collapsed == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_runs_do_not_cross_documents_or_segments(spark):
    part = "a b c d e f "
    got = periodic.periodic_runs(frame(spark, [part, part, part + "x " + part + "y " + part])).collect()
    assert [len(r.runs) for r in got] == [0, 0, 0]


def test_empty_table_and_long_text(spark):
    assert periodic.periodic_runs(frame(spark, ["a"]).limit(0)).count() == 0
    unit = " ".join(f"w{k}" for k in range(40_000))
    long = " ".join([unit] * 5 + ["z"] * 50_000)
    r = periodic.periodic_runs(frame(spark, [long])).first()
    assert [tuple(x) for x in r.runs] == [(0, 200_000, 40_000), (200_000, 50_000, 1)]
    assert r.collapsed == unit + " z"


def test_main_lorentz_alone():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = rng.integers(0, 2, rng.integers(1, 70))
        want = brute(a.tolist(), 2)
        got = [(int(s), int(e - s), int(q)) for s, e, q in periodic.main_lorentz(a, 2, len(a))]
        assert got == want
