"""Periodic runs of words within a document, found and collapsed.

A run is a stretch of words with smallest period q, of ``max(shortest, 2 q)`` words or more, that no neighbouring word extends. In
such a run at least ``k = ceil(shortest / 2)`` words agree with those q words on (the minimum overlap), and the overlap and its image
cover the run, so each of its words lies in a k-gram that the document holds twice. Words outside repeated k-grams are masked
(k-grams are told apart by hashes; an accident only leaves more words in), and the surviving segments alone are searched.

The search is Main and Lorentz's: a run that crosses the middle of a block, not longer than the block, has a period up to half of
it and a whole period on one side of the middle, so it shows as the common extensions of two places one period apart. All
blocks of a level are tested together; extensions are compared by exact names of the stretches of 2^j words, never by hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalgrid.llm.common import chunks, mix, shielded, shingles

SHORTEST = 12


class _Names:
    """Names of all stretches of 2^j words of an array: equal stretches, equal names."""

    def __init__(self, a: np.ndarray):
        self.n, self.of = len(a), [np.unique(a, return_inverse=True)[1].astype(np.int32)]
        size = 1
        while 2 * size <= self.n:
            last = self.of[-1].astype(np.int64)
            codes = last[:-size] * (int(last.max()) + 1) + last[size:]
            names = np.unique(codes, return_inverse=True)[1].astype(np.int32)
            if int(names.max()) + 1 == len(names):  # all differ: no longer stretch is found twice
                break
            self.of.append(names)
            size *= 2

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal those from ``j`` on."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.of) - 1, -1, -1):
            names = self.of[k]
            inside = np.flatnonzero((i < len(names)) & (j < len(names)))
            same = inside[names[i[inside]] == names[j[inside]]]
            i[same] += 1 << k
            j[same] += 1 << k
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to ``i`` equal those up to ``j``, both included."""
        i, j = i + 1, j + 1
        start = i.copy()
        for k in range(len(self.of) - 1, -1, -1):
            names, size = self.of[k], 1 << k
            inside = np.flatnonzero((i >= size) & (j >= size))
            same = inside[names[i[inside] - size] == names[j[inside] - size]]
            i[same] -= size
            j[same] -= size
        return start - i


def main_lorentz(a: np.ndarray, shortest: int, widest: int) -> np.ndarray:
    """Runs of ``a`` as rows (start, end, period), periods up to ``widest``, ordered; time about n log^2 n, memory n log n."""
    n, found = len(a), []
    names = _Names(a)
    half = 1
    while half < n:
        middles, periods = np.arange(half, n, 2 * half), np.arange(1, min(half, widest) + 1)
        c, p = np.repeat(middles, len(periods)), np.tile(periods, len(middles))
        at = np.flatnonzero(c + p <= n)
        at = at[a[c[at] - 1] == a[c[at] + p[at] - 1]]  # a period right of the middle, and a word left of it
        left, right = c[at], c[at] + p[at]
        found.append((left - names.behind(left - 1, right - 1), right + names.ahead(left, right), p[at]))
        at = np.flatnonzero(c >= p)
        at = at[a[c[at] - p[at]] == a[c[at]]]  # a period left of it, and a word right of it
        left, right = c[at] - p[at], c[at]
        found.append((left - names.behind(left - 1, right - 1), right + names.ahead(left, right), p[at]))
        for k in (-2, -1):
            s, e, q = found[k]
            long = e - s >= np.maximum(shortest, 2 * q)
            found[k] = (s[long], e[long], q[long])
        half *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    s, e, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])  # multiples of a period span the same words
    s, e, q = s[first], e[first], q[first]
    order = np.lexsort((q, s))
    return np.stack([s[order], e[order], q[order]], axis=1)


def runs(ids: np.ndarray, doc: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Runs of the words ``ids`` of documents ``doc`` (ascending) as rows (start, end, period) of places in ``ids``."""
    k = (shortest + 1) // 2
    none = np.zeros((0, 3), np.int64)
    if len(ids) < shortest:
        return none
    marks = mix(ids.astype(np.uint64) + (doc.astype(np.uint64) << np.uint64(32)))
    grams = shingles(marks, k)  # a gram over two documents matches none within one: its words are of both
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return none
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + k, -1)
    kept = np.cumsum(cover[:-1]) > 0
    cut = np.r_[True, doc[1:] != doc[:-1]]
    starts = np.flatnonzero(kept & (cut | ~np.r_[False, kept[:-1]]))
    ends = np.flatnonzero(kept & (np.r_[cut[1:], True] | ~np.r_[kept[1:], False])) + 1
    long = ends - starts >= shortest
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return none
    # The segments end to end, a word of its own between any two, so that no run goes over an end.
    sizes = ends - starts
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    place = np.repeat(starts - begin, sizes + 1) + np.arange(int(sizes.sum()) + len(sizes))
    stop = begin + sizes
    text = ids[np.minimum(place, len(ids) - 1)].astype(np.int64)
    text[stop] = -1 - np.arange(len(stop))
    out = main_lorentz(text, shortest, int(sizes.max()) // 2)
    out[:, :2] += (place[out[:, 0]] - out[:, 0])[:, None]
    return out


@shielded(("n_words", "runs", "collapsed"), "text")
def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``runs`` (array of start, length, period in words, by start, then period) and
    ``collapsed``: the words but those after the first period of a run, joined by one space. Such columns are replaced.

    Words are what ASCII white space parts, compared byte by byte. Null and empty texts have no words, no runs and an empty
    ``collapsed``. Rows are judged one by one: repeated rows get equal results, an empty table gives an empty one, other columns
    stay, whatever their names. Runs that overlap are all given. A text of n words takes memory n log n in one task.
    """
    names = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"])

    def search(batches):
        for b in chunks(batches, text):
            split = [t.split() if t else [] for t in b.column(text).cast(pa.large_binary()).to_pylist()]  # bytes split at ASCII white space
            sizes = np.array([len(w) for w in split], np.int64)
            first = np.r_[0, np.cumsum(sizes)]
            number: dict[bytes, int] = {}
            ids = np.array([number.setdefault(w, len(number)) for words in split for w in words], np.int64)
            found = runs(ids, np.repeat(np.arange(len(split)), sizes), shortest)
            owner = np.searchsorted(first, found[:, 0], "right") - 1
            drop = np.zeros(len(ids) + 1, np.int64)
            np.add.at(drop, found[:, 0] + found[:, 2], 1)
            np.add.at(drop, found[:, 1], -1)
            gone = np.cumsum(drop) > 0
            hit = np.zeros(len(split), bool)
            hit[owner] = True
            left = [b" ".join([w for w, g in zip(words, gone[at:]) if not g] if h else words).decode() for words, at, h in zip(split, first, hit)]
            start = found[:, 0] - first[owner]
            rows = pa.StructArray.from_arrays([pa.array(start), pa.array(found[:, 1] - found[:, 0]), pa.array(found[:, 2])], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(split) + 1)), pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(sizes), lists, pa.array(left, pa.string())], [*names, "n_words", "runs", "collapsed"])

    return docs.mapInArrow(search, schema)
