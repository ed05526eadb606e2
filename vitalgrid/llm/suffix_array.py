"""Suffix arrays by induced sorting, bucket by bucket on numpy arrays, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

SMALL = 1024  # letters up to which a bucket-wise pass pays


def _left_smaller(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than its right neighbour, and the positions of leftmost-smaller suffixes (the sentinel's included)."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    step[-1] = 1  # the sentinel
    at = np.where(step != 0, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    small = step[following] > 0
    left = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    return small, left


def _scatter(lists: list[list], letters: np.ndarray, items: np.ndarray) -> None:
    """Appends ``items`` to the lists of their ``letters``, each list in order."""
    order = np.argsort(letters, kind="stable")
    letters, items = letters[order], items[order]
    cuts = np.flatnonzero(np.diff(letters)) + 1
    for part, letter in zip(np.split(items, cuts), letters[np.concatenate([[0], cuts])]):
        lists[letter].append(part)


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in the order that the ordered leftmost-smaller suffixes ``seeds`` induce, in two linear passes over the buckets."""
    large_of, small_of, seeds_of = [[] for _ in range(size)], [[] for _ in range(size)], [[] for _ in range(size)]
    _scatter(seeds_of, text[seeds], seeds)

    def go(lists, now, letter, want):
        while len(now):
            before = now[now > 0] - 1
            before = before[small[before] == want]
            if not len(before):
                return
            letters = text[before]
            same = letters == letter
            if same.any():
                if not same.all():
                    _scatter(lists, letters[~same], before[~same])
                now = before[same]
                lists[letter].append(now)
            else:
                _scatter(lists, letters, before)
                return

    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    for letter in range(size):
        go(large_of, join(large_of[letter]), letter, False)
        go(large_of, join(seeds_of[letter]), letter, False)
    large = [join(x) for x in large_of]
    for letter in range(size - 1, -1, -1):
        go(small_of, join(small_of[letter]), letter, True)
        go(small_of, large[letter][::-1], letter, True)
    end = len(text) - 1  # nothing induces the sentinel
    return np.concatenate([[end], *[x for letter in range(size) for x in (large[letter], join(small_of[letter])[::-1])]]).astype(np.int64)


def _names(text: np.ndarray, order: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Rank of each leftmost-smaller substring, in text order; equal substrings have equal ranks. ``order``: their starts, sorted."""
    ends = np.empty(len(text), np.int64)
    ends[left[:-1]], ends[left[-1]] = left[1:], left[-1]
    a, b = order[:-1], order[1:]
    length = ends[a] - a
    differ = length != ends[b] - b
    active, k = np.flatnonzero(~differ), 0
    while len(active):
        bad = text[a[active] + k] != text[b[active] + k]
        differ[active[bad]] = True
        active = active[~bad]
        active = active[length[active] > k]
        k += 1
    rank = np.empty(len(text), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(differ)])
    return rank[left]


def _by_doubling(ranks: np.ndarray) -> np.ndarray:
    """Suffix array of a text of many letters by rank doubling."""
    n, width = len(ranks), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = ranks[width:] + 1
        key = ranks * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        ranks = np.empty(n, np.int64)
        ranks[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in ascending order. ``text`` holds small integers and ends in its one smallest.

    Classifies suffixes, sorts the leftmost-smaller substrings by an induction, sorts the text of their ranks recursively
    (by doubling where its alphabet is large), and induces all others from them.
    """
    n = len(text)
    if n < 3:
        return np.argsort(text, kind="stable")
    size = int(text.max()) + 1
    if size > SMALL:
        return _by_doubling(np.unique(text, return_inverse=True)[1].astype(np.int64))
    small, left = _left_smaller(text)
    order = _induce(text, small, left, size)
    is_left = np.zeros(n, bool)
    is_left[left] = True
    order = order[is_left[order]]
    names = _names(text, order, left)
    if names.max() + 1 < len(left):
        order = left[suffix_array(names)]
    return _induce(text, small, order, size)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each start in ``order`` but the first, letters (at most ``most``) its suffix shares with the one before; compared for all
    text positions at once, through each position's predecessor in the array (permuted common prefixes), four letters a step.

    Letters are small integers of up to 16 bits. No two suffixes agree up to the sentinel, so what lies beyond it is never compared.
    """
    n = len(text)
    phi = np.full(n, -1, np.int64)
    phi[order[1:]] = order[:-1]
    at = np.flatnonzero(phi >= 0)
    out = np.zeros(n, np.int64)
    padded = np.concatenate([text, np.zeros(most + 8, text.dtype)]).astype(np.uint64)
    four = padded[:-3] | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(32) | padded[3:] << np.uint64(48)
    p, q = at, phi[at]
    length = np.full(len(at), most, np.int64)
    active = np.arange(len(at))
    for k in range(0, most, 4):
        odd = four[p + k] ^ four[q + k]
        gone = odd != 0
        first = odd[gone]
        length[active[gone]] = k + (np.bitwise_count((first & (~first + np.uint64(1))) - np.uint64(1)) >> 4)
        active, p, q = active[~gone], p[~gone], q[~gone]
        if not len(active):
            break
    out[at] = np.minimum(length, most)
    return out[order]
