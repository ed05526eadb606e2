"""Line dedup: Bloom filters of once-seen and twice-seen line hashes; only suspected repeats shuffle for exact confirmation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import ASCII_SPACE, chunks, mix, shielded, written

_SPACE = ASCII_SPACE.encode()


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(_SPACE).lower()


def _long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)


class Bloom:
    """A Bloom filter of 64-bit hashes over a power of two of bits; three places a key."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.mask = np.uint64(bits - 1)
        self.bits = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    @classmethod
    def sized(cls, n: int, most: int = 1 << 40) -> Bloom:
        bits = 512
        while bits < 16 * n and bits * 2 <= most:
            bits *= 2
        return cls(bits)

    def _at(self, h: np.ndarray):
        step = mix(h) | np.uint64(1)
        for k in range(3):
            yield ((h >> np.uint64(7)) + step * np.uint64(k)) & self.mask

    def add(self, h: np.ndarray) -> None:
        for at in self._at(h):
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def test(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for at in self._at(h):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def twice_seen(docs: DataFrame, text: str, min_chars: int, shards: int, max_bytes: int) -> list[tuple[int, bytes]]:
    """(shard, filter) of the keys that may stand in two documents.

    A task sends each hash once, with a mark where it saw two documents hold it, so the commonest line is a row a batch.
    Each shard runs its once-seen and twice-seen filters over its hashes. What comes to the driver is filters only,
    ``max_bytes`` in all; with more repeats than fit them well, more lines are suspected and the exact step does more.
    """
    def hashes(batches):
        for batch in chunks(batches, text, 16 << 20):
            found = []
            for value in batch.column(0).cast(pa.large_binary()):
                raw = value.as_py()
                if raw and len(raw) >= min_chars:
                    keys = {k for k in map(line_key, raw.split(b"\n")) if _long(k, min_chars)}
                    found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(shards)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(n > 1)], ["shard", "h", "two"])

    def filters(batches):
        held: dict[int, list] = {}
        for b in batches:
            s, h, two = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            order = np.argsort(s, kind="stable")
            edges = np.flatnonzero(np.diff(s[order])) + 1
            for part in np.split(order, edges):
                if len(part):
                    held.setdefault(int(s[part[0]]), []).append((h[part].astype(np.int64).view(np.uint64), two[part].astype(bool)))
        for s, parts in held.items():
            n = sum(len(h) for h, _ in parts)
            once, twice, many = Bloom.sized(n), Bloom.sized(n), 0
            for h, two in parts:
                h, back = np.unique(h, return_inverse=True)
                again = (np.bincount(back) > 1) | (np.bincount(back, two) > 0) | once.test(h)
                once.add(h)
                many += int(again.sum())
                twice.add(h[again])
            out = Bloom.sized(min(many, n), most=max(512, max_bytes * 8 // shards))
            if len(out.bits) < len(twice.bits):  # fold: both sizes are powers of two
                bits = np.bitwise_or.reduce(twice.bits.reshape(-1, len(out.bits)), axis=0)
            else:
                bits = twice.bits
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["shard", "bits"])

    rows = docs.select(F.col(text)).mapInArrow(hashes, "shard int, h long, two boolean").repartition(shards, "shard").mapInArrow(filters, "shard int, bits binary")
    return [(r[0], bytes(r[1])) for r in rows.collect()]


def suspected(docs: DataFrame, doc_id: str, text: str, min_chars: int, filters: list[tuple[int, bytes]], shards: int) -> DataFrame:
    """(_id, _key): each distinct key of a document that may stand in two documents."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def keys(batches):
        table = {s: Bloom(len(b) * 8, b) for s, b in shared.value}
        for batch in chunks(batches, text):
            ids, out, at = batch.column(0), [], []
            for k, value in enumerate(batch.column(1).cast(pa.large_binary())):
                raw = value.as_py()
                if raw and len(raw) >= min_chars:
                    mine = {x for x in map(line_key, raw.split(b"\n")) if _long(x, min_chars)}
                    out += mine
                    at += [k] * len(mine)
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, out), np.uint64, len(out))
            hit, shard = np.zeros(len(h), bool), h % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(part) and int(shard[part[0]]) in table:
                    hit[part] = table[int(shard[part[0]])].test(h[part])
            where = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(at, np.int64)[where])), pa.array([out[k].decode() for k in where], pa.string())], ["_id", "_key"])

    return docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text)).mapInArrow(keys, "_id long, _key string")


@shielded(("n_lines", "n_dropped"), "doc_id", "text")
def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, doc_id: str = "doc_id", text: str = "text", max_filter_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with ``text`` rid of repeated lines, plus ``n_lines`` and ``n_dropped`` (columns of those names are replaced).

    A key of ``min_chars`` code points or more found in ``min_docs`` documents or more loses all its lines except in the largest
    doc_id that holds it. Each row is a document; rows that share a doc_id share its fate. A null doc_id is below all others.
    Null and empty texts are one empty line, which stays; a null text stays null. Any other column stays, whatever its name.
    """
    spark = docs.sparkSession
    shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    filters = twice_seen(docs, text, min_chars, shards, max_filter_bytes)
    lines = written(suspected(docs, doc_id, text, min_chars, filters, shards), "lines")
    repeated = lines.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_last")).filter(F.col("_n") >= min_docs)
    # Both sides of the join come from tables, so a key of a third of all rows is a skewed partition that Spark splits.
    lost = lines.join(written(repeated, "repeated"), "_key").filter(~F.col("_id").eqNullSafe(F.col("_last")))
    drops = lost.groupBy("_id").agg(F.collect_set("_key").alias("_drop"))
    df = docs.join(drops, F.col(doc_id).cast("long").eqNullSafe(F.col("_id")), "left").drop("_id")
    names = [c for c in df.columns if c != "_drop"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_drop"] + ["n_lines long", "n_dropped long"])

    def keep(batches):
        for batch in batches:
            texts, lines_, dropped = [], [], []
            for value, drop in zip(batch.column(text), batch.column("_drop")):
                t, d = value.as_py(), drop.as_py()
                raw = (t or "").split("\n")
                lines_.append(len(raw))
                if d:
                    d = set(d)
                    kept = [x for x in raw if line_key(x.encode()).decode() not in d]
                    dropped.append(len(raw) - len(kept))
                    texts.append("\n".join(kept))
                else:
                    dropped.append(0)
                    texts.append(t)
            arrays = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"])

    return df.mapInArrow(keep, schema)
