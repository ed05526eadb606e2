"""Columns named like an operator's own, repeated rows and empty tables, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vitalgrid.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, quality_rules, suffix_dedup, toxicity, url_filter, warc
from vitalgrid.llm.common import written
from vitalgrid.llm.queries import vocabulary

NAMES = [
    "_id", "_key", "_drop", "_hits", "_items", "_row", "_m", "_b", "_c", "_l", "_n", "_start", "_rank", "_keys", "_host", "_path", "_best", "_digest", "_first", "_uri", "_o", "_y", "_t", "_k",
    "id", "row", "spans", "key", "mark", "comp", "cell", "sid", "h", "shard", "_vg_0", "_vg_1", "_spans", "_in", "_doc", "i", "t",
]
RESULTS = ["quality", "n_lines", "n_dropped", "n_words", "n_hit", "items", "kept", "contaminated"]
TEXT = "The first line of this text is long enough\nand here are some more words of it, for all the rules there are to see that it is good"


def table(spark, names, rows=((1, TEXT), (2, TEXT + " and an end"), (2, TEXT + " and an end"), (3, None), (4, ""))):
    full = [(i, t, "en", *range(len(names))) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` long" for n in names))


@pytest.fixture(scope="module")
def operators(spark):
    items = spark.createDataFrame([("a", TEXT[:60]), ("a", TEXT[:60])], "item_id string, text string")
    rules = spark.createDataFrame([("com", "/", "block")], "host string, path string, verdict string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")

    def packed(d):
        pieces = written(packing.tokenize(d.select("doc_id", "text"), vocabulary()), "pieces")
        more = d.drop("doc_id", "text", "lang", "length", "start").limit(1)
        return packing.pack(pieces.crossJoin(F.broadcast(more)))  # one row on the one side

    return {
        "suffix_dedup": suffix_dedup.suffix_dedup, "line_dedup": line_dedup.line_dedup, "quality_rules": quality_rules.quality_rules,
        "decontaminate": lambda d: decontaminate.decontaminate(d, items), "decontaminate in blocks": lambda d: decontaminate.decontaminate(d, items, block_bytes=40),
        "url_filter": lambda d: url_filter.url_filter(d.withColumn("url", F.lit("http://x.com/a")), rules),
        "warc": lambda d: warc.resolve_revisits(d.withColumn("url", F.lit("u")), page_id="doc_id", html="text"), "pack": packed,
        "language_id": lambda d: language_id.identify(d, language_id.train(d)), "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
    }


@pytest.mark.parametrize("name", ["suffix_dedup", "line_dedup", "quality_rules", "decontaminate", "decontaminate in blocks", "url_filter", "warc", "pack", "language_id", "toxicity"])
def test_operators_keep_columns_of_any_name(spark, operators, name):
    out = operators[name](table(spark, NAMES)).collect()
    assert len(out) == 5
    for r in out:
        assert [r[n] for n in NAMES] == list(range(len(NAMES)))
    twice = [r for r in out if r["doc_id"] == 2]
    assert len(twice) == 2 and (name == "pack" or twice[0] == twice[1])
    empty = operators[name](table(spark, NAMES, ((9, "x"),)).filter("doc_id = 0"))
    assert empty.count() == 0 and empty.columns == list(out[0].asDict())


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    spark.createDataFrame([("a", "none of these words is in any text of the table above at all")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = NAMES + RESULTS
    docs = table(spark, names, ((1, TEXT), (2, TEXT + " and an end"), (3, None), (4, "")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", *names]
        for r in docs.collect():
            assert [r[n] for n in names] == list(range(len(names)))
    assert {r.doc_id for r in docs.collect()} == {1}  # 2 is a near copy of 1; 3 and 4 have no words
    assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == 1
    none = docs.filter("doc_id = 0")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = written(stage(spark, none, str(tmp_path)), name)
    assert corpus_pipeline.pack(spark, none, str(tmp_path)).count() == 0


def test_jaccard_reads_its_two_columns_only(spark):
    out = jaccard_join.near_duplicates(table(spark, NAMES + ["n_shingles", "component_id"])).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (2, 1), (2, 1), (3, 3), (4, 4)]
