import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalgrid.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, quality_rules, suffix_dedup, toxicity, url_filter, warc
from vitalgrid.llm.components import components
from vitalgrid.llm.suffix_array import common_prefixes, suffix_array

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = np.random.default_rng(0)
WORDS = ["".join(RNG.choice(list("abcdefghéü"), RNG.integers(2, 7))) for _ in range(300)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


def corpus(seed=1, n=40):
    """Texts with exact and near copies, shared passages, repeated lines, nulls, empties, one long text."""
    rng = np.random.default_rng(seed)
    passage, line = sentence(rng, 30), "Shared boilerplate line of text"
    texts = [sentence(rng, int(rng.integers(1, 120))) for _ in range(n)]
    texts[3] = texts[30]
    texts[5] = texts[31] + " tail"
    words = texts[32].split()
    texts[6] = " ".join([*words[:-1], "changed"])
    for k in (8, 9, 20, 33):
        texts[k] += f"\n{line} \n {line.upper()}\n" + passage
    texts[10], texts[11], texts[12], texts[13] = None, "", "   \n ", "one two"
    texts[14], texts[15] = "x" * 70, "yy" + "x" * 60
    texts[16] = " ".join([texts[17]] * 60)
    texts[18] = "ab " * 200
    return texts


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in zip(ids or range(len(texts)), texts)], DOCS)


def words(text, chars=SPACE):
    out, now = [], ""
    for c in text or "":
        if c in chars:
            out += [now] * bool(now)
            now = ""
        else:
            now += c
    return out + [now] * bool(now)


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_suffix(texts, ids, length=50):
    first = {}
    for i, t in sorted(zip(ids, texts)):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = {}
    for i, t in zip(ids, texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1])), bytes(x for x, g in zip(b, gone) if not g))
    return out


def test_suffix_array_and_prefixes():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        t = np.concatenate([rng.integers(1, int(rng.integers(2, 5)), int(rng.integers(1, 80))), [0]]).astype(np.int16)
        order, plain = suffix_array(t), t.tolist()
        assert order.tolist() == sorted(range(len(t)), key=lambda i: plain[i:])
        shared = common_prefixes(t, order, 9)
        for k in range(1, len(t)):
            a, b = plain[order[k - 1] :], plain[order[k] :]
            assert shared[k] == next((n for n in range(9) if n >= len(a) or n >= len(b) or a[n] != b[n]), 9)


@pytest.mark.parametrize("most", [20_000, 1])
def test_op1_equals_brute_force(spark, most):
    texts = corpus()
    ids = list(range(len(texts)))
    docs = frame(spark, texts, ids).withColumn("kept", F.lit("clash"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(docs, most_segments=most).collect()}
    assert got == brute_suffix(texts, ids)


def brute_components(texts, ids):
    def shingles(t):
        w = words(low(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    s = {i: shingles(t) for i, t in zip(ids, texts)}
    comp = {i: i for i in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: (len(s[i]), root(i)) for i in ids}


def near_copies(seed, n=60):
    """A group of edited copies that link through their original, and texts that share a long passage without linking."""
    rng = np.random.default_rng(seed)
    base, passage = sentence(rng, 150).split(), sentence(rng, 60)
    out = [" ".join(base)]
    for _ in range(n // 2):
        w = list(base)
        at = int(rng.integers(0, 130))
        w[at : at + int(rng.integers(1, 12))] = sentence(rng, 3).split()
        out.append(" ".join(w))
    return out + [sentence(rng, 60) + " " + passage + " " + sentence(rng, 60) for _ in range(n // 2)]


@pytest.mark.parametrize("texts", [corpus(2), near_copies(3)])
def test_op2_equals_brute_force(spark, texts):
    rng = np.random.default_rng(9)
    ids = [int(x) for x in rng.permutation(len(texts))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, texts, ids)).collect()}
    assert got == brute_components(texts, ids)


def test_op2_common_keys_and_blocks(spark):
    texts = near_copies(4, 80)
    docs = frame(spark, texts)
    want = brute_components(texts, list(range(len(texts))))
    signs = jaccard_join.signatures(docs, "doc_id", "text").withColumn("rep", F.col("id")).filter("n > 0").cache()
    for hot, block, crowd in ((3, 512, 2), (64, 8, 2), (64, 8, 10**6)):  # the last one: cells of every two blocks find each link alone
        comp = {r.id: r.comp for r in jaccard_join.links(docs, signs, "doc_id", "text", hot=hot, block=block, crowd=crowd).collect()}
        assert {i: comp.get(i, i) for i in want} == {i: c for i, (_, c) in want.items()}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = rng.integers(0, 2**63, int(rng.integers(1, 900)), dtype=np.uint64)
        b = np.concatenate([a[: int(len(a) * 0.9)], rng.integers(0, 2**63, int(rng.integers(1, 400)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        assert jaccard_join.hamming(jaccard_join.sketch(a), jaccard_join.sketch(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)]
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(100, 140)} == {100}


def test_op3_rules(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("org", "/es/", "block")], "host string, path string, verdict string")
    urls = ["http://a.Example.COM/en/7x?q", "http://a.example.com/en/8", "https://com/en/", "http://notexample.com/EN/7", "ftp://x.org/es/#f", "x.org/es/", None, "://", "http://x.net?/en/", "http://example.com/en/7"] * 2
    got = [tuple(r) for r in url_filter.url_filter(spark.createDataFrame([(u, 1) for u in urls], "url string, rule int"), rules).select("url", "host", "path", "rule", "verdict").distinct().collect()]
    want = {
        ("http://a.Example.COM/en/7x?q", "a.example.com", "/en/7x", "example.com/en/7", "allow"), ("http://a.example.com/en/8", "a.example.com", "/en/8", "com/en/", "block"),
        ("https://com/en/", "com", "/en/", "com/en/", "block"), ("http://notexample.com/EN/7", "notexample.com", "/EN/7", None, "allow"), ("ftp://x.org/es/#f", "x.org", "/es/", "org/es/", "block"),
        ("x.org/es/", "", "", None, "allow"), (None, "", "", None, "allow"), ("://", "", "", None, "allow"), ("http://x.net?/en/", "x.net", "", None, "allow"), ("http://example.com/en/7", "example.com", "/en/7", "example.com/en/7", "allow"),
    }
    assert set(got) == want
    assert url_filter.url_filter(spark.createDataFrame([(u,) for u in urls], "url string"), rules.limit(0)).filter("verdict <> 'allow'").count() == 0


TOKENS = None


def encoder():
    global TOKENS
    from vitalgrid.llm.queries import vocabulary

    TOKENS = TOKENS or packing.Encoder(vocabulary(), most=50)
    return TOKENS


def test_op4_ids_equal_the_tokenizer(spark):
    e = encoder()
    odd = ["don't stop<|endoftext|>now", "Σίσυφος ΣΑΣ", "naïvé café", "a b c", "ÄÖÜ ß İstanbul", "12345 3.14!!", "日本語 テスト", "é́ x ́y", "", "\x1c\x85 tab\tend\x0b"]
    for t in [*odd, *[x for x in corpus(6) if x]]:
        assert np.frombuffer(e(t), "<u4").tolist() == e.whole.encode(t, add_special_tokens=False).ids, t


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_op4_packs_gaplessly_and_tight(spark):
    from vitalgrid.llm.queries import vocabulary

    texts = corpus(7, 60)
    got = packing.pack_documents(frame(spark, texts), vocabulary(), capacity=128, keep_ids=True).collect()
    e = encoder()
    for i, t in enumerate(texts):
        mine = sorted((r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got if r.doc_id == i)
        ids = (e.whole.encode(t or "", add_special_tokens=False).ids) + [0]
        cut = [np.array(ids[k : k + 128], "<u4").tobytes() for k in range(0, len(ids), 128)]
        assert mine == [(k, 128 * k, len(b) // 4, zlib.crc32(b), b) for k, b in enumerate(cut)]
    assert check_packing(got, 128) <= 1.05 * np.ceil(sum(r.length for r in got) / 128) + 1


def test_op4_plan_beats_or_equals_first_fit():
    rng = np.random.default_rng(8)
    for _ in range(30):
        cap = int(rng.integers(8, 60))
        lengths = rng.integers(1, cap + 1, int(rng.integers(1, 80))).tolist()
        t = packing.plan({w: lengths.count(w) for w in set(lengths)}, cap)
        bins = []
        for w in sorted(lengths, reverse=True):
            k = next((i for i, b in enumerate(bins) if b + w <= cap), None)
            if k is None:
                bins.append(w)
            else:
                bins[k] += w
        assert -(-sum(lengths) // cap) <= t["sequences"][0] <= len(bins)


def test_op4_common_length_and_empty_table(spark):
    pieces = spark.createDataFrame([(i, 0, 7 if i % 3 else 5) for i in range(500)], "doc_id long, piece int, length long")
    assert check_packing(packing.pack(pieces, 20, per_bucket=10).collect(), 20) >= 160
    assert packing.pack(pieces.limit(0), 20).count() == 0


def test_op5_round_trip(spark, tmp_path):
    long = "<p>" + "é\r\nWARC/1.1\r\n" * 30
    rows = [(5, "http://a", long), (3, "http://b", long), (9, "u\r\nx", long), (1, None, None), (2, "", "short"), (4, "", "short"), (7, "z", "tail\r\n" * 40), (None, "n", "only null " * 20)]
    got = {r.page_id: r for r in warc.deduplicate(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w")).collect()}
    assert len(got) == len(rows)
    for i, _, h in rows:
        b = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {5: 3, 9: 3}
    stored = {r.page_id: r.payload for r in warc.read_archives(spark, str(tmp_path / "w")).collect()}
    assert bytes(stored[3]) == long.encode() and stored[5] is None


def brute_lines(texts, ids):
    key = lambda x: low(x.strip(SPACE))
    holders = {}
    for i, t in zip(ids, texts):
        for k in {key(x) for x in (t or "").split("\n")}:
            holders.setdefault(k, set()).add(i)
    lost = {k: max(h) for k, h in holders.items() if len(k) >= 20 and len(h) >= 3}
    out = {}
    for i, t in zip(ids, texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in lost or lost[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("room", [32 << 20, 512])
def test_op6_equals_brute_force(spark, room):
    texts = [*corpus(10), "Ünïcödé line with twenty+ ", "x\nünïcödé line with twenty+", "Ünïcödé line with twenty+\n", "nineteen characters", "nineteen characters", "nineteen characters"]
    ids = list(range(len(texts)))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text or "") for r in line_dedup.line_dedup(frame(spark, texts), max_filter_bytes=room).collect()}
    assert got == brute_lines(texts, ids)


def test_op7_held_out_and_undetermined(spark):
    rng = np.random.default_rng(11)
    speak = {"aa": ["ba", "bo", "bi"], "bb": ["ke", "ku", "ki"], "cc": ["sø", "sæ", "må"]}
    say = lambda k, n: " ".join("".join(rng.choice(speak[k], 3)) for _ in range(n))
    rows = [(i, say(k, 40), k, "s", 0) for i, k in enumerate(list(speak) * 30)] + [(900, "no lang given", None, "s", 0), (901, None, "aa", "s", 0)]
    model = language_id.train(spark.createDataFrame(rows, DOCS))
    test = [(i, say(k, 5), k, "s", 0) for i, k in enumerate(list(speak) * 5)] + [(99, None, "aa", "s", 0), (98, "123 !?", "aa", "s", 0), (97, "", "aa", "s", 0), (96, "½ ²", "aa", "s", 0)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(test, DOCS), model).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k, _, _ in test[:15])
    assert {got[i].lang_pred for i in (96, 97, 98, 99)} == {"und"}
    empty = language_id.train(spark.createDataFrame([], DOCS))
    assert language_id.identify(spark.createDataFrame(test[:2], DOCS), empty).filter("lang_pred <> 'und'").count() == 0


def test_op8_equals_brute_force(spark):
    texts = [*corpus(12), "#tag *b* | x\n\n a \na", "a b c d e f a b c d e g", "é" * 5 + "\x1c z", "the of " * 100]
    for r, t in zip(quality_rules.quality_rules(frame(spark, texts)).orderBy("doc_id").collect(), texts):
        q, w = r.quality, words(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)} if len(w) < 400 else None
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines))), t
        if covered is not None:
            assert q.n_repeat_words == len(covered)
        assert q.base_failed == (len(w) < 10 or 100 * q.n_repeat_words > 20 * len(w)) and q.kept == (not q.base_failed and not q.failed)


def brute_hits(texts, items, window=10):
    word = lambda t: [x for x in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low(t)).split(" ") if x]
    owners = {}
    for i, t in items:
        w = word(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            owners.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for t in texts:
        w = word(t)
        hit, own = set(), set()
        for n in {len(k) for k in owners}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in owners:
                    hit |= set(range(k, k + n))
                    own |= owners[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(own)))
    return out


@pytest.mark.parametrize("block", [8 << 20, 300])
def test_op9_equals_brute_force(spark, block):
    rng = np.random.default_rng(13)
    items = [(i, sentence(rng, int(rng.integers(8, 40)))) for i in range(12)] + [(20, "One two, three!"), (21, None), (22, " ?! "), (23, sentence(rng, 10))]
    texts = corpus(14)
    texts[0] = "x " + "".join(c.upper() if c.isascii() else c for c in items[0][1]).replace(" ", ", ") + " y"
    texts[1] = " ".join(items[1][1].split()[:9])
    texts[2] = "and one-two three, four " + items[-1][1]
    texts[4] = items[2][1] + " " + items[2][1]
    got = decontaminate.decontaminate(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == brute_hits(texts, items)
    assert all(r.contaminated == (r.n_hit > 0) for r in got) and got[0].longest_match >= min(10, len(items[0][1].split()))


def test_op10_learns_words_and_pairs(spark):
    rng = np.random.default_rng(15)
    rows, labels = [], []
    for i in range(600):
        text, toxic = sentence(rng, 30).split(), 0
        kind = i % 4
        if kind == 0:
            text[4], toxic = "scoundrel", 1
        elif kind == 1:
            text[3] = "group"
        elif kind == 2:
            text[5] = "insult"
        rows.append((i, " ".join(text), "en", "s", 0))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(docs.filter("doc_id < 500"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs.filter("doc_id >= 500").withColumn("score", F.lit(9)), model).collect()}
    assert np.mean([got[i].predicted == labels[i][1] for i in got]) > 0.95
    odd = toxicity.score(spark.createDataFrame([(1, None, "", "", 0), (2, "", "", "", 0)], DOCS), model).collect()
    assert all(0 <= r.score <= 1 for r in odd)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs.limit(1), none).first().score == 0


def test_op10_pairs_alone():
    """A pair that is toxic only together: additive weights cannot tell, factor products can."""
    rng = np.random.default_rng(16)
    n = 2000
    a, b = rng.random(n) < 0.5, rng.random(n) < 0.5
    doc = np.concatenate([np.flatnonzero(a), np.flatnonzero(b)])
    bucket = np.concatenate([np.full(a.sum(), 1), np.full(b.sum(), 2)])
    order = np.argsort(doc, kind="stable")
    y = (a == b).astype(float)
    used, theta, bias = toxicity.fit(doc[order], bucket[order], y, epochs=60)
    table = np.zeros((4, theta.shape[1]), np.float32)
    table[used] = theta
    p = toxicity.scores(table, bias, doc[order], bucket[order], n)
    assert np.mean((p > 0) == (y > 0)) > 0.95


def test_empty_tables(spark):
    none = frame(spark, []).withColumn("_x", F.lit(1))
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert jaccard_join.near_duplicates(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert decontaminate.decontaminate(none, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.decontaminate(frame(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")).first().contaminated is False
    assert warc.deduplicate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_null_and_repeated_ids(spark):
    texts, ids = ["same text of some words here " * 4] * 4 + [None], [None, 7, 7, 9, None]
    docs = frame(spark, texts, ids)
    spans = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert spans == [(-1, 0), (-1, 0), (7, 0), (7, 0), (9, len(texts[0]))]
    comp = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_join.near_duplicates(docs).collect())
    assert comp == [(-1, -1), (-1, -1), (7, 7), (7, 7), (9, 7)]
    assert line_dedup.line_dedup(docs).count() == 5
