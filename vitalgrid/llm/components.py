"""Connected components of an edge table by distributed label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every id of ``edges`` (a, b): the smallest id reachable. Rounds follow the logarithm of the longest path, about.

    Labels and edges stay in tables of the shared folder; only a count of changes reaches the driver. Hubs are summed before
    the shuffle on the one side and split by skewed-join handling on the other.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        seen = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("_a")).agg(F.min("comp").alias("_m"))
        step = labels.join(seen, labels.id == F.col("_a")).select("id", F.col("comp").alias("old"), F.least("comp", "_m").alias("comp"))
        step = written(step, "labels")
        up = step.select(F.col("id").alias("_p"), F.col("comp").alias("_up"))
        jumped = written(step.join(up, step.comp == F.col("_p"), "left").select("id", "old", F.least("comp", F.coalesce("_up", "comp")).alias("comp")), "labels")
        changed = jumped.filter("comp <> old").limit(1).count()
        labels = jumped.select("id", "comp")
        if not changed:
            return labels
