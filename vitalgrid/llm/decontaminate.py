"""Benchmark decontamination: suffix arrays of training shards, binary-searched by every test suffix."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import chunks, mix, shielded, text_bytes, words

WINDOW = 10
#: Bytes of a word: ASCII digits and letters and everything above ASCII.
INSIDE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


class Tests:
    """The test suffixes of one block of items: vocabulary, windows by length, and the (item, place) that own each window.

    Places of one row's next words are consecutive; those of different rows never are.
    """

    def __init__(self, items: list[tuple[str, str]], window: int):
        raw, offsets = text_bytes(pa.array([t or "" for _, t in items], pa.string()))
        _, _, hashed, at = words(raw, offsets, INSIDE)
        self.vocabulary = np.unique(hashed)
        ids = np.searchsorted(self.vocabulary, hashed).astype(np.int64) + 1
        by_length: dict[int, dict[bytes, list]] = {}
        for k, (name, _) in enumerate(items):
            own = ids[at[k] : at[k + 1]].astype(">u4")
            n = min(window, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                by_length.setdefault(n, {}).setdefault(own[i : i + n].tobytes(), []).append((name, int(at[k]) + k + i))
        self.windows = {n: sorted(w.items()) for n, w in by_length.items()}
        self.shortest = min(self.windows, default=window)
        self.window = window


def suffixes(ids: np.ndarray, ends: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a shard over ``starts`` (ordered by the first ``depth`` words, which is all a window compares) and its keys.

    ``ends`` is where each word's document ends: suffixes stop there.
    """
    key = np.zeros((len(starts), depth), ">u4")
    for k in range(depth):
        at = starts + k
        ok = at < ends[starts]
        key[ok, k] = ids[at[ok]]
    keys = np.ascontiguousarray(key).view(f"S{4 * depth}").ravel()
    order = np.argsort(keys, kind="stable")
    return starts[order], keys[order]


def shard_hits(tests: Tests, hashed: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(word positions, window numbers, window length) of every occurrence in a shard of documents whose words lie at ``at``."""
    n = len(hashed)
    if not n or not tests.windows:
        return []
    ids = np.searchsorted(tests.vocabulary, hashed)
    ids[ids == len(tests.vocabulary)] = 0
    known = tests.vocabulary[ids] == hashed
    ids = np.where(known, ids + 1, 0)
    ends = np.repeat(at[1:], np.diff(at))
    # A suffix can match only where the next words, as many as the shortest window has, are all in the test vocabulary.
    sums = np.concatenate([[0], np.cumsum(known)])
    stop = np.arange(n) + tests.shortest
    starts = np.flatnonzero((stop <= ends) & (sums[np.minimum(stop, n)] - sums[:n] == tests.shortest))
    if not len(starts):
        return []
    array, keys = suffixes(ids, ends, starts, tests.window)
    out = []
    for length, table in tests.windows.items():
        short = keys.astype(f"S{4 * length}") if length < tests.window else keys
        queries = np.array([w for w, _ in table], f"S{4 * length}")
        left, right = np.searchsorted(short, queries, "left"), np.searchsorted(short, queries, "right")
        size = right - left
        hit = np.flatnonzero(size)
        if len(hit):
            which = np.repeat(hit, size[hit])
            step = np.arange(len(which)) - np.repeat(np.cumsum(size[hit]) - size[hit], size[hit])
            out.append((array[left[which] + step], which, length))
    return out


def _pass(docs: DataFrame, items: list[tuple[str, str]], window: int, doc_id: str, text: str, full: bool) -> DataFrame:
    """Every row of ``docs`` (or, not ``full``, the id and whole texts' results only) with a struct-free set of result columns."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    keep = [f for f in docs.schema if full or f.name == doc_id]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + ["n_words long", "_hits array<int>", "_items array<string>", "longest_match long"])

    def scan(batches):
        tests = Tests(shared.value, window)
        for batch in chunks(batches, text):
            raw, offsets = text_bytes(batch.column(text))
            _, _, hashed, at = words(raw, offsets, INSIDE)
            hits = shard_hits(tests, hashed, at)
            found: dict[int, list] = {}
            for pos, which, length in hits:
                doc = np.searchsorted(at, pos, "right") - 1
                order = np.lexsort((which, pos, doc))
                pos, which, doc = pos[order], which[order], doc[order]
                for a, b in zip(np.r_[0, np.flatnonzero(np.diff(doc)) + 1], np.r_[np.flatnonzero(np.diff(doc)) + 1, len(doc)]):
                    found.setdefault(int(doc[a]), []).append((pos[a:b] - at[doc[a]], which[a:b], length))
            n = np.diff(at)
            spans, names, longest = [], [], []
            for k in range(batch.num_rows):
                if k not in found:
                    spans.append([]), names.append([]), longest.append(0)
                    continue
                mark, own, most = np.zeros(n[k] + 1, np.int64), set(), 0
                for pos, which, length in found[k]:
                    np.add.at(mark, pos, 1)
                    np.add.at(mark, pos + length, -1)
                    table = tests.windows[length]
                    for w in np.unique(which):
                        own.update(name for name, _ in table[w][1])
                    # Next windows at next places of one owner are one longer verbatim match, along any of the owners.
                    best, runs, last = 0, {}, -2
                    for p, w in zip(pos, which):
                        before, runs = runs if p == last + 1 else {}, {}
                        for _, place in table[w][1]:
                            runs[place] = before.get(place - 1, 0) + 1
                        best, last = max(best, max(runs.values())), p
                    most = max(most, best + length - 1)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(mark)[: n[k]] > 0).astype(np.int8), [0]])))
                spans.append(edges.tolist()), names.append(sorted(own)), longest.append(most)
            arrays = [batch.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(n.astype(np.int64)), pa.array(spans, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int64())], [*[f.name for f in keep], "n_words", "_hits", "_items", "longest_match"])

    return docs.mapInArrow(scan, schema)


RESULTS = ("n_words", "n_hit", "n_items", "items", "hit_spans", "longest_match", "contaminated")


@shielded(RESULTS, "doc_id", "text")
def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 8 << 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``n_hit``, ``n_items``, ``items``, ``hit_spans``, ``longest_match``, ``contaminated`` (such columns are replaced).

    A window is ``window`` consecutive words of an item, or all words of a shorter one; document words inside an occurrence are
    hit. ``hit_spans`` holds [start, end) word positions, flat. The items go to the tasks in blocks of at most ``block_bytes`` of text
    (by hash of the id; an item longer than that is a block); each block is searched against all documents.
    Null texts have no words, null or wordless items no windows; repeated rows are judged alike, repeated items count once; an item id is
    taken as a string; any other column stays, whatever its name.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce(F.col("text"), F.lit("")).alias("t")).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = int(total // (block_bytes // 2)) + 1
    block = lambda b: [(r[0], r[1]) for r in (items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b)).collect()]
    if blocks == 1:
        found = _pass(docs, block(0), window, doc_id, text, True)
    else:
        row = docs.withColumn("_row", F.sha2(F.concat_ws(":", F.col(doc_id).cast("string"), F.lit(""), F.col(text)), 256))
        parts = None
        for b in range(blocks):
            part = _pass(row.select("_row", text), block(b), window, "_row", text, False).filter(F.size("_hits") > 0).dropDuplicates(["_row"])
            parts = part if parts is None else parts.unionByName(part)
        parts = parts.groupBy("_row").agg(F.flatten(F.collect_list("_hits")).alias("_hits"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"), F.max("longest_match").alias("longest_match"))
        base = _pass(row, [], window, doc_id, text, True).drop("_hits", "_items", "longest_match")
        found = base.join(parts, "_row", "left").drop("_row")
        none = lambda t: F.array().cast(t)
        found = found.withColumns({"_hits": _merged(F.coalesce("_hits", none("array<int>"))), "_items": F.coalesce("_items", none("array<string>")), "longest_match": F.coalesce("longest_match", F.lit(0).cast("long"))})
    even = F.filter("_hits", lambda x, i: i % 2 == 0)
    odd = F.filter("_hits", lambda x, i: i % 2 == 1)
    n_hit = F.aggregate(F.zip_with(even, odd, lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    found = found.withColumns({"n_hit": n_hit, "n_items": F.size("_items").cast("long"), "items": F.array_sort("_items"), "hit_spans": F.col("_hits")})
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def _merged(flat: Column) -> Column:
    """[start, end) pairs of several blocks as one ascending list without overlaps."""
    pairs = F.array_sort(F.transform(F.filter(F.transform(flat, lambda x, i: F.struct(x.alias("a"), F.get(flat, i + 1).alias("b"), (i % 2).alias("odd"))), lambda p: p["odd"] == 0), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"))))
    last = lambda done: F.element_at(done, -1)
    join = lambda done, p: F.when((F.size(done) > 0) & (p["a"] <= F.try_element_at(done, F.lit(-1))), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(last(done), p["b"])))).otherwise(F.concat(done, F.array(p["a"], p["b"])))
    return F.aggregate(pairs, F.array().cast("array<int>"), join)
