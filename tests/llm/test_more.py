"""Thresholds of the quality rules in plain Python, columns of any name for the newer operators, very long texts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.test_clashes import NAMES, RESULTS, TEXT, table
from tests.llm.test_llm import brute_hits, frame, words
from vitalgrid.llm import decontaminate, line_dedup, packing, periodic, piece_codec, quality_rules, spelling, warc
from vitalgrid.llm.queries import vocabulary


def broken(text):
    """Names of the rules a text breaks, from the text alone."""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    n = max(len(w), 1)
    stop = sum(x in quality_rules.STOP_WORDS for x in w)
    out = set()
    if not 2.0 <= sum(map(len, w)) / n <= 20.0:
        out.add("mean_word_length")
    if sum(c in "#*$%&|<>" for c in text) / n > 0.25:
        out.add("symbols_per_word")
    if text.count("!") / n > 0.9:
        out.add("shouts_per_word")
    if len(w) >= 50 and stop / n < 0.01:
        out.add("stop_word_share")
    if len(lines) >= 5 and (len(lines) - len(set(lines))) / len(lines) > 0.5:
        out.add("repeated_line_share")
    return out


def test_op8_thresholds_on_both_sides(spark):
    some = [f"word{k}" for k in range(120)]
    texts = [
        " ".join("abcdefghijkl"), " ".join(["ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr", "st"]), " ".join(f"{'x' * 19}{c}" for c in "abcdefghij"), " ".join(f"{'x' * 20}{c}" for c in "abcdefghij"),
        " ".join(some[:12]) + " ###", " ".join(some[:12]) + " # # # #", " ".join(some[:12]) + " # # # # #", " ".join(some[:10]) + "!" * 9, " ".join(some[:10]) + "!" * 10,
        " ".join(some[:49]), " ".join(some[:50]), " ".join([*some[:99], "the"]), " ".join([*some[:100], "the"]), " ".join([*some[:49], "THE"]),
        "\n".join(f"line {k} of the text" for k in range(4)), "\n".join(["one line of the text"] * 3 + ["two lines here", "three"]), "\n".join(["one line of the text"] * 4 + ["two lines here"]), "\n".join(["a b c", "a b c", "a b c", "d e f g h i j k"]),
    ]
    for r in quality_rules.quality_rules(frame(spark, texts)).collect():
        t = texts[r.doc_id]
        assert set(r.quality.failed) == broken(t), t
        assert r.quality.kept == (not r.quality.base_failed and not broken(t))
    assert {x for t in texts for x in broken(t)} == {r.name for r in quality_rules.RULES}


@pytest.mark.parametrize("name", ["codec", "periodic"])
def test_newer_operators_keep_columns_of_any_name(spark, name):
    names = NAMES + RESULTS
    run = {
        "codec": lambda d: piece_codec.round_trip(d, piece_codec.read_model(vocabulary("piece_bpe_32k.model"))), "periodic": periodic.periodic_runs,
    }[name]
    names = [n for n in names if name != "periodic" or n != "n_words"]
    out = run(table(spark, names)).collect()
    assert len(out) == 5 and all([r[n] for n in names] == list(range(len(names))) for r in out)
    twice = [r for r in out if r["doc_id"] == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    empty = run(table(spark, names, ((9, "x"),)).filter("doc_id = 0"))
    assert empty.count() == 0 and empty.columns == list(out[0].asDict())


def test_spelling_reads_its_columns_only(spark):
    docs = table(spark, NAMES + ["word", "n", "form", "root"], ((1, "spelling spelling spellin"), (2, "spellin"), (2, "spelling " * 20), (3, None), (4, "")))
    got = {r.word: (r.form, r.n) for r in spelling.variants(spelling.word_counts(docs)).collect()}
    assert got == {"spelling": (None, 22), "spellin": ("spelling", 2)}


def test_very_long_texts(spark):
    """A text longer than a batch of every operator, beside a short one."""
    long = "\n".join(f"line number {k % 5000} of a very long text, with words enough to be one {k}" for k in range(30_000)) + "\nthe same line as in all the others"
    short = "first words\nthe same line as in all the others\nTHE SAME LINE AS IN ALL THE OTHERS "
    texts = [long, short, short]
    docs = frame(spark, texts)
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {0: (30_001, 1), 1: (3, 2), 2: (3, 0)}
    q = {r.doc_id: r.quality for r in quality_rules.quality_rules(docs).collect()}
    assert q[0].n_words == len(words(long)) and q[0].word_chars == sum(map(len, words(long))) and q[0].base_failed and not q[0].kept  # its lines are much alike
    item = " ".join(words(long)[200_000:200_030])
    items = spark.createDataFrame([("a", item)], "item_id string, text string")
    hits = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontaminate.decontaminate(docs, items).collect()}
    assert [hits[k] for k in range(3)] == brute_hits(texts, [("a", item)])
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://x.org/").alias("url"), F.col("text").alias("html"))
    back = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type) for r in warc.deduplicate(pages.filter("page_id < 2")).collect()}
    assert back == {k: (len(texts[k]), hashlib.sha256(texts[k].encode()).hexdigest(), "response") for k in (0, 1)}
    pieces = packing.pack_documents(docs.select("doc_id", "text"), vocabulary()).collect()
    mine = sorted((r.piece, r.start, r.length) for r in pieces if r.doc_id == 0)
    assert mine[0][:2] == (0, 0) and all(a[1] + a[2] == b[1] and a[2] == 2048 for a, b in zip(mine, mine[1:])) and len(mine) > 200
    assert TEXT
