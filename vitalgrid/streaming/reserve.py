"""The energy reserve of a stream: a level a subject, kept in a keyed state store, that goes on where the last batch ended."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vitalgrid import config as C

#: The state of a subject: the last bucket, whose step waits for the next one, and the level before it.
STATE = "ts timestamp, rate double, level double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Reserve(StatefulProcessor):
    """Takes a bucket's step once the next bucket tells how long it lasted (ten minutes at most)."""

    def __init__(self, seed: float):
        self.seed = seed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("ts")
        level = self.seed
        if self.last.exists():
            ts, rate, level = self.last.get()
            ts = pd.Timestamp(ts).tz_localize(None)
            new = pd.concat([pd.DataFrame({"ts": [ts], "rate": [rate]}), new[new["ts"] > ts][["ts", "rate"]]])
        new = new.drop_duplicates("ts", keep="last")
        if not len(new):
            return
        gaps = np.diff(new["ts"].to_numpy()) / np.timedelta64(1, "m")
        out = []
        for step in new["rate"].to_numpy()[:-1] * np.minimum(gaps, C.GAP_CAP_MIN):
            level = min(100.0, max(0.0, level + step))
            out.append(level)
        self.last.update((new["ts"].iloc[-1].to_pydatetime(), float(new["rate"].iloc[-1]), float(level)))
        yield pd.DataFrame({"subject": key[0], "ts": new["ts"].iloc[:-1], "level": out})

    def close(self) -> None:
        pass


def levels(rates: DataFrame, seed: float = 50.0) -> DataFrame:
    """(subject, ts, level) after each bucket of a stream (subject, ts, rate), a bucket behind: its length shows with the next one.

    Buckets of a batch come in any order; one not later than the subject's last of an earlier batch comes too late and is passed over, of
    equal instants the last counts. Batches give the rows that one batch of all would give. Needs the RocksDB state store (``PROVIDER``).
    """
    kind = rates.schema["subject"].dataType.simpleString()
    return rates.select("subject", "ts", "rate").groupBy("subject").transformWithStateInPandas(Reserve(seed), f"subject {kind}, ts timestamp, level double", "append", "none")
