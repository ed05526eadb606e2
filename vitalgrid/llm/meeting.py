"""Finding the keys that two documents or more have, without gathering a common key in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key long, own long, mark byte"


def dealt(key: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """A batch (key, own, mark) of distinct (key, owner) pairs of one task. Of pairs with one key only the first goes to that key's
    task (mark 1: seen twice, 0: once); the others (mark 2) are known to be shared and dealt evenly.
    """
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    if len(key):
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        key, owner = key[fresh], owner[fresh]
    same = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.zeros(0, bool)
    twice = np.concatenate([same[1:], [False]]) if len(key) else same
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(owner), pa.array(np.where(same, 2, twice).astype(np.int8))], ["key", "own", "mark"])


def shared(keys: DataFrame) -> DataFrame:
    """(key, id) of the dealt keys that two owners or more have. A task reads its keys in order and holds one row back."""
    def only(batches):
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)  # the last row that may still meet its like
        give = lambda k, o: pa.RecordBatch.from_arrays([pa.array(k), pa.array(o)], ["key", "id"])
        for b in batches:
            key, own, mark = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            past = mark == 2
            k, o, kept = (np.concatenate([x, y[~past]]) for x, y in zip(held, (key, own, mark > 0)))
            same = k[1:] == k[:-1]
            kept[1:] |= same
            kept[:-1] |= same
            held = k[-1:], o[-1:], kept[-1:]
            k, o, kept = k[:-1], o[:-1], kept[:-1]
            yield give(np.concatenate([k[kept], key[past]]), np.concatenate([o[kept], own[past]]))
        yield give(held[0][held[2]], held[1][held[2]])

    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.when(F.col("mark") == 2, F.xxhash64("key", "own")).otherwise(F.col("key"))
    return keys.repartition(n, at).sortWithinPartitions("key").mapInArrow(only, "key long, id long")
