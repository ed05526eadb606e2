from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_llm import brute_components, brute_hits, brute_lines, check_packing, corpus, frame, sentence
from vitalgrid.llm import quality_rules


def test_pipeline_equals_brute_force(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(21)
    texts = [("the of and " + t) if t and i % 2 else t for i, t in enumerate(corpus(20, 60))]
    items = [(i, sentence(rng, 20)) for i in range(3)]
    texts[40] = f"the of and {sentence(rng, 30)} {items[1][1]} {sentence(rng, 30)}"
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = {r.doc_id for r in quality_rules.quality_rules(frame(spark, texts)).filter("quality.kept").collect()}
    ids = sorted(good)
    kept = {i: v[2] for i, v in brute_lines([texts[i] for i in ids], ids).items()}
    one = {i for i, (_, c) in brute_components([kept[i] for i in ids], ids).items() if i == c}
    ids = sorted(one)
    clean = {i for i, (_, hit, _) in zip(ids, brute_hits([kept[i] for i in ids], items)) if not hit}
    assert clean == {r.doc_id for r in got} and 40 in good and 40 not in clean
    assert check_packing(got, 2048) >= 1


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = frame(spark, corpus(22, 40))
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
    assert docs.filter(F.col("text").isNull()).count() == 1
