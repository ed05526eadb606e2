"""The registered queries of the training-data operators: thin digests of each operator's result over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrid.llm import decontaminate, jaccard_join, language_id, line_dedup, packing, periodic, piece_codec, quality_rules, spelling, suffix_dedup, toxicity, url_filter, warc
from vitalgrid.llm.common import let, table

# The url rules (host, path, verdict).
URL_RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"),
    ("net", "/de/", "block"), ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _crc(key: str, mod: int):
    return F.crc32(F.col(key).cast("string").cast("binary")) % mod


def op1_suffix_dedup(spark, sf_dir):
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_jaccard_links(spark, sf_dir):
    return jaccard_join.near_links(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, vocabulary()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.deduplicate(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark, sf_dir):
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op7_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(_crc("doc_id", 3) != 1))
    held = F.coalesce(_crc("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held, "lang_pred", "score")


def op8_quality_rules(spark, sf_dir):
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op9_decontaminate(spark, sf_dir):
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op10_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(_crc("doc_id", 5) != 0))
    held = F.coalesce(_crc("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held, "score", "predicted")


def op11_sentencepiece(spark, sf_dir):
    model = piece_codec.read_model(vocabulary("piece_bpe_32k.model"))
    out = piece_codec.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _planted():
    """The contract's planted periods: in a tenth of the documents, by crc32 of doc_id, the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, a + (i - a) % p))), " ")).otherwise(F.lit(""))

    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+", -1), lambda x: x != "")
    return F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text"))


def op12_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", _planted().alias("text"))
    out = periodic.periodic_runs(docs)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    # The greatest length, then the smallest start, then the smallest period.
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    text = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    out = out.select("doc_id", "runs", "collapsed", F.when(F.size("runs") > 0, best).alias("best"), text.alias("lines"))
    length = -F.col("best.l")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(length * 1000 / F.col("best.period")).alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_spelling_variants(spark, sf_dir):
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), respell=spelling.misspelt))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_jaccard_join, op2_jaccard_links, op3_url_filter, op4_best_fit_packing, op5_warc, op6_line_dedup, op7_language_id, op8_quality_rules, op9_decontaminate, op10_toxicity, op11_sentencepiece, op12_periodic_runs, op13_spelling_variants)}
