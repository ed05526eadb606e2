"""From raw documents to packed training sequences: quality rules, line dedup, near-duplicate removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm import decontaminate, jaccard_join, line_dedup, packing, quality_rules
from vitalgrid.llm.common import hidden, table, written
from vitalgrid.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule. Null and empty texts go; repeated rows share their fate; an empty table stays empty; columns of any
    name stay as they are.
    """
    own = hidden(docs)
    return own.shown(quality_rules.quality_rules(own.frame, text=own.of("text")).filter("quality.kept"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that three documents or more hold, except in the largest id of each; ``n_chars``, where there is one, follows the
    text. All rows stay, null texts as null; columns of any other name stay as they are.
    """
    own = hidden(docs)
    out = line_dedup.line_dedup(own.frame, doc_id=own.of("doc_id"), text=own.of("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn(own.of("n_chars"), F.coalesce(F.length(own.of("text")), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return own.shown(out)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component; rows without an id stay, rows that share one stay together, and so do null and wordless
    texts. Columns of any name stay as they are.
    """
    own = hidden(docs)
    gone = jaccard_join.near_duplicates(docs.select("doc_id", "text")).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return own.shown(own.frame.join(gone, F.col(own.of("doc_id")) == F.col("_gone"), "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark. Null texts have none and stay; repeated rows share their fate; an empty benchmark removes
    nothing; columns of any name stay as they are.
    """
    own = hidden(docs)
    out = decontaminate.decontaminate(own.frame, table(spark, sf_dir, "benchmark"), doc_id=own.of("doc_id"), text=own.of("text"))
    return own.shown(out.filter("not contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece with its sequence and offset; a null text is empty and has the end mark alone, repeated rows are packed one by one."""
    return packing.pack_documents(docs.select("doc_id", "text"), vocabulary()).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", keep_one_of_near_copies),
    ("decontaminate", drop_contaminated),
    ("best_fit_packing", pack),
]

#: Tokens come from a vocabulary file, which SQL cannot read; tests/llm hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its table to the shared folder and the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
