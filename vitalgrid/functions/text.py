"""Names of workouts: folding, slugs, canonical types."""

from __future__ import annotations

import unicodedata

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalgrid.schema import workout_names


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def fold(name: Column, compatibility: bool = False) -> Column:
    """Lower case, white space (no-break spaces too) collapsed and stripped; ``compatibility`` adds full NFKC, which needs Python."""
    text = _compose(name) if compatibility else name
    return F.trim(F.regexp_replace(F.lower(text), r"[\s   ]+", " "))


def slug(value: Column) -> Column:
    """Letters and digits lower-cased, all else to single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def with_canonical_type(workouts: DataFrame, type_map: dict[str, str] | None = None, name: str = "name", out: str = "canonical_type") -> DataFrame:
    """``workouts`` with the type of each name: the given map first, then the built-in one, else null. Both maps are small dimensions."""
    spark = workouts.sparkSession
    built_in = workout_names(spark).withColumnRenamed("canonical_type", "_b")
    df = workouts.withColumn("_key", fold(F.col(name), compatibility=True))
    df = df.join(F.broadcast(built_in.withColumnRenamed("key", "_key")), "_key", "left")
    own = F.lit(None).cast("string")
    if type_map:
        extra = spark.createDataFrame(list(type_map.items()), "k string, _o string").select(fold(F.col("k"), compatibility=True).alias("_key"), "_o").dropDuplicates(["_key"])
        df = df.join(F.broadcast(extra), "_key", "left")
        own = F.col("_o")
    return df.withColumn(out, slug(F.coalesce(own, F.col("_b")))).drop("_key", "_b", "_o")
