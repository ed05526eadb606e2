"""Helpers shared by the training-data operators: tables, durable intermediates, batches."""

from __future__ import annotations

import atexit
import functools
import inspect
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of the text contracts.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


class hidden:
    """A frame whose columns have names of their own (``_vg_0``, ...), so that an operator's names cannot clash with an input's.

    ``of`` gives the inner name of a column; ``shown`` selects the input's columns under their own names, and more beside them.
    """

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.frame = df.toDF(*[f"_vg_{i}" for i in range(len(self.names))])

    def of(self, name: str) -> str:
        found = self.names if name in self.names else [n.lower() for n in self.names]
        return f"_vg_{found.index(name if name in self.names else name.lower())}"

    def shown(self, df: DataFrame, *more: Column | str, without: tuple[str, ...] = ()) -> DataFrame:
        own = [F.col(f"_vg_{i}").alias(n) for i, n in enumerate(self.names) if n not in without]
        return df.select(*own, *more)


def shielded(results: tuple[str, ...], *roles: str):
    """Runs an operator on an input whose columns are renamed and gives them their names back, so an operator's own columns never clash
    with an input's. ``roles`` are the parameters that name columns; input columns named like ``results`` are replaced.
    """
    def wrap(operator):
        form = inspect.signature(operator)

        @functools.wraps(operator)
        def run(*args, **named):
            call = form.bind(*args, **named)
            call.apply_defaults()
            first = next(iter(form.parameters))
            own = hidden(call.arguments[first].drop(*results))
            call.arguments[first] = own.frame
            for r in roles:
                call.arguments[r] = own.of(call.arguments[r])
            return own.shown(operator(*call.args, **call.kwargs), *results)

        return run

    return wrap


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one, on a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="vitalgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the folder's owner cleans up
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the session's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the table replaces the shuffle files it was made from
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._vg_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that no later step reads."""
    for t in tables:
        _delete(t.sparkSession, t._vg_path)


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``size`` bytes at most; one longer value makes a batch of its own."""
    for batch in batches:
        lengths = np.nan_to_num(batch.column(column).cast(pa.large_binary()).to_pandas().str.len().to_numpy(dtype=float)) if batch.num_rows else np.zeros(0)
        group = (np.cumsum(lengths) // size).astype(np.int64)
        edges = np.flatnonzero(np.diff(group)) + 1
        for a, b in zip(np.r_[0, edges], np.r_[edges, batch.num_rows]):
            if b > a:
                yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values' UTF-8 bytes end to end, and the n+1 offsets; null counts as empty."""
    values = column.cast(pa.large_binary())
    if values.null_count:
        values = values.fill_null(b"")
    n = len(values)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, 1 << 19), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
        if n > 1 << 21:  # one very long text: not kept
            return _POWERS.pop(base)[:n]
    return _POWERS[base][:n]


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_SALT = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of bytes: eight bytes a round, each scrambled before and after it is joined; stretches of over 64 bytes by XXH3.

    Sums of bytes times powers would not do: modulo 2^64 whole families of strings have equal sums, whatever the base.
    """
    size = ends - starts
    eights = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(8, np.uint8)]), (len(data) + 1, 8), (1, 1))
    out = mix(size.astype(np.uint64) + np.uint64(0x51_7C_C1_B7))
    at = np.arange(len(size))
    for k in range(8):
        block = eights[starts[at] + 8 * k].view("<u8").ravel() & _KEEP[np.minimum(size[at] - 8 * k, 8)]
        out[at] = mix(out[at] ^ mix(block + _SALT[k]))
        at = at[size[at] > 8 * (k + 1)]
        if not len(at):
            return out
    for i in at.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].data)
    return out


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, heads: tuple[int, ...] = ()):
    """Words are maximal runs, within a value, of bytes that ``inside`` marks (256 booleans).

    Returns each word's start, end, 64-bit hash (A-Z lower-cased) and the n+1 offsets of the values' words; with ``heads`` also
    a (number, word) array of hashes of each word's first bytes, so many or all it has.
    """
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.int64)
        none = (empty, empty, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
        return (*none, np.zeros((len(heads), 0), np.uint64)) if heads else none
    mask = inside[data]
    starts = mask.copy()
    starts[1:] &= ~mask[:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    starts[cuts] = mask[cuts]
    ends[cuts - 1] = mask[cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    lowered = data.copy()
    upper = (data >= 65) & (data <= 90)
    lowered[upper] += 32
    out = (s, e, _hashes(lowered, s, e), np.searchsorted(s, offsets))
    if not heads:
        return out
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[lowered] * _powers(_BASE, n), out=sums[1:])
    scale = _powers(_UNBASE, n)[s]
    return *out, np.stack([mix((sums[np.minimum(s + k, e)] - sums[s]) * scale + np.uint64(1000 + k)) for k in heads])


_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(hashed: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each position on; positions too near the end are left out."""
    n = len(hashed) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashed[:n].copy()
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * _STEP + hashed[k : k + n]
    return mix(out)
