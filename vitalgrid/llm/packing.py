"""Best-fit packing of token pieces: dominance reduction and best fit on the histogram of lengths, placement by rank."""

from __future__ import annotations

import functools
import os
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.llm.common import shielded, written

CAPACITY = 2048
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value: the vocabulary file's own pre-tokenizer


def _little(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Little-endian 32-bit ids of a text by a word-level vocabulary file, with white-space-delimited chunks kept in a bounded cache.

    The file's tokenizer never joins characters across white space, so a text's ids are those of its chunks. Chunks of
    Latin letters go straight to the file's merge model; any other chunk goes through the whole tokenizer.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.split, self.most = self.whole.model.tokenize, regex.compile(SPLIT).findall, most
        self.plain = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]*").fullmatch  # no space or control; lower case as in any library
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = iter(range(256, 512))
        self.shown = {b: chr(b) if b in shown else chr(next(hidden)) for b in range(256)}
        self.cache, self.pieces = _Lazy(self._chunk), _Lazy(self._piece)

    def _piece(self, piece: str) -> bytes:
        text = piece if piece.isascii() else "".join(map(self.shown.__getitem__, piece.encode()))
        return _little([t.id for t in self.model(text)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha() and (chunk.isascii() or self.plain(chunk)):  # the common cases, without a search for pieces
            return self.pieces[chunk.lower()]
        if "<|" not in chunk and self.plain(chunk):
            if chunk[:-1].isalpha() and not chunk[-1].isalnum():
                return self.pieces[chunk[:-1].lower()] + self.pieces[chunk[-1]]
            return b"".join(map(self.pieces.__getitem__, self.split(chunk.lower())))
        return _little(self.whole.encode(chunk, add_special_tokens=False).ids)

    def __call__(self, text: str) -> bytes:
        for c in "\t\n\x0b\x0c\r":
            text = text.replace(c, " ")
        out = b"".join(map(self.cache.__getitem__, filter(None, text.split(" "))))
        for kept in (self.cache, self.pieces):
            if len(kept) > self.most:  # short words are the common ones
                for k in [k for k in kept if len(k) > 6]:
                    del kept[k]
                if len(kept) > self.most // 2:
                    kept.clear()
        return out


class _Lazy(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        self[key] = value = self.make(key)
        return value


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder a Python worker: Spark keeps its workers from task to task, and so the file is read and the caches are filled once."""
    return Encoder(path)


def tokenize(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids_crc32 (and ``ids`` as little-endian bytes where asked for).

    A document is its tokens and ``end_id``; null and empty texts are ``end_id`` alone. Only documents over ``capacity`` are cut.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches):
        encode = encoder(path)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = [[] for _ in range(6)]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(t.as_py() or "") + tail
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    for column, value in zip(rows, (d, k, a // 4, len(part) // 4, zlib.crc32(part), part)):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            n = 5 + keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows[:n], types[:n])], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:n])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(cut, schema)


def reduce_dominant(n: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Fixes, and takes out of the counts by length ``n``, sets that dominate every other set holding their longest piece.

    Alone where nothing else fits; with the longest partner where that fills the sequence, where two more never fit, or where
    at most two more fit and no pair of them is longer than the partner.
    """
    out = []
    changed = True
    while changed:
        changed = False
        for w in range(capacity, 0, -1):
            while n[w] > 0:
                room = capacity - w
                n[w] -= 1
                present = np.flatnonzero(n)
                fitting = present[present <= room]
                n[w] += 1
                if not len(fitting):
                    out.append((((w, 1),), int(n[w])))
                    n[w], changed = 0, True
                    break
                k = int(fitting[-1])
                small = [int(x) for x in fitting[:3] for _ in range(min(3, int(n[x] - (x == w))))][:3]
                fixed = k == room or len(small) < 2 or small[0] + small[1] > room
                if not fixed and (len(small) < 3 or sum(small) > room):
                    best = 0
                    for a in fitting:
                        rest = fitting[fitting <= room - a]
                        if len(rest):
                            b = int(rest[-1])
                            if b == a and n[a] - (a == w) < 2:
                                b = int(rest[-2]) if len(rest) > 1 else -a
                            best = max(best, int(a) + b)
                    fixed = best <= k
                if not fixed:
                    break
                many = int(n[w] // 2 if k == w else min(n[w], n[k]))
                out.append((((w, 2),) if k == w else ((w, 1), (k, 1)), many))
                n[w] -= many
                n[k] -= many
                changed = True
    return out


def best_fit(n: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit of the counts by length, longest first: each piece to the fullest sequence with room. Equal sequences move as one group."""
    by_room: dict[int, list[list]] = {}

    def put(content, many, room):
        if many:
            by_room.setdefault(room, []).append([content, many])

    for w in range(capacity, 0, -1):
        left = int(n[w])
        for room in sorted(r for r in by_room if r >= w):
            fits = room // w
            while left and by_room.get(room):
                content, many = by_room[room].pop()
                full = min(many, left // fits)
                put((*content, (w, fits)), full, room - fits * w)
                left -= full * fits
                if full < many:
                    rest = many - full
                    if left:
                        put((*content, (w, left)), 1, room - left * w)
                        rest, left = rest - 1, 0
                    put(content, rest, room)
                    break
            if not left:
                break
        if left:
            fits = capacity // w
            put(((w, fits),), left // fits, capacity - fits * w)
            if left % fits:
                put(((w, left % fits),), 1, capacity - (left % fits) * w)
    return [(tuple(c), m) for groups in by_room.values() for c, m in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank: intervals (length, first rank) with first sequence, pieces a sequence and first offset.

    Its size follows the number of lengths, not of pieces: each length splits a group at most once.
    """
    n = np.zeros(capacity + 1, np.int64)
    for w, c in counts.items():
        n[w] = c
    groups = reduce_dominant(n, capacity)
    groups += best_fit(n, capacity)
    rank = np.zeros(capacity + 1, np.int64)
    rows, base = [], 0
    for content, many in groups:
        offset = 0
        for w, each in content:
            rows.append((w, rank[w], base, each, offset))
            rank[w] += many * each
            offset += w * each
        base += many
    rows.sort()
    return {k: np.array([r[i] for r in rows], np.int64) for i, k in enumerate(("length", "rank", "sequence", "each", "offset"))} | {"sequences": np.array([base])}


@shielded(("sequence_id", "offset"), "doc_id", "piece", "length")
def pack(pieces: DataFrame, capacity: int = CAPACITY, per_bucket: int = 100_000, doc_id: str = "doc_id", piece: str = "piece", length: str = "length") -> DataFrame:
    """``pieces`` (doc_id, piece, length from 1 to ``capacity``, any more columns) with ``sequence_id`` and ``offset``, gapless from 0.

    Only the histogram of lengths reaches the driver. Ranks within a length count over hash buckets, so that a length of a third
    of all pieces is dealt to many tasks. Repeated rows are packed one by one; an empty table stays empty; other columns stay, whatever their names.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    table = plan(histogram, capacity)
    buckets = max(16, 2 * sum(histogram.values()) // per_bucket)
    dealt = pieces.withColumn("_b", F.pmod(F.xxhash64(doc_id, piece), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(length).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(length, "_b").count().select(F.col(length).alias("_l"), F.col("_b").alias("_c"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    ranked = dealt.join(starts, (F.col(length) == F.col("_l")) & (F.col("_b") == F.col("_c")))
    ranked = ranked.withColumn("_rank", F.col("_start") + F.row_number().over(Window.partitionBy(length, "_b").orderBy(doc_id, piece)) - 1)
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema] + ["sequence_id long", "offset long"])
    names = pieces.columns

    def place(batches):
        t = shared.value
        key = (t["length"] << 48) + t["rank"]
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (length, "_rank"))
            at = np.searchsorted(key, (size << 48) + rank, "right") - 1
            nth = rank - t["rank"][at]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(t["sequence"][at] + nth // t["each"][at]), pa.array(t["offset"][at] + nth % t["each"][at] * size)], [*names, "sequence_id", "offset"])

    return ranked.drop("_b", "_c", "_l", "_start").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenizes once (the pieces are written to the shared folder) and packs."""
    return pack(written(tokenize(docs, path, capacity, keep_ids=keep_ids), "pieces"), capacity)
