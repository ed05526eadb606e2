"""Spelling variants: words one edit apart, each led to its far commoner form.

A word's mask holds the parity of the count of each letter. One inserted or deleted letter flips one bit, one replaced letter at
most two, so of three bands of the mask at least one is the same in two near words: words meet in a hash join on an equal band and
the length of the shorter one. Bands of few letters hold many words, so the key has one thing more that near words share: one edit
leaves the first or the last half (of the shorter length) as it is. What meets passes the parity bound and is verified by its edit
distance, within the join; each near pair is put out once, at the first band and half that it shares.

Tables of words are joined by sorting, not broadcast on an estimate: Spark sizes them by their compressed files, and an explode as one row a
row, so that what it holds for 10 MB may be a gigabyte on the driver.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import UPPER, LOWER, chunks, free, written

BANDS = 3
#: Words: runs of Latin letters; only A-Z have a lower case.
WORD = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans(UPPER, LOWER)


def misspelt(doc_id, word: str, every: int = 31) -> str:
    """The planted slips of the contract: where ``every`` divides the crc32 of doc and word, the word loses a code point (never where doc_id is null)."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    k = h % len(word)
    return word if h % every else word[:k] + word[k + 1 :]


def word_counts(docs: DataFrame, shortest: int = 7, fewest: int = 2, respell: Callable[[object, str], str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Words (``word``, ``n``) of whole texts, of ``shortest`` code points and ``fewest`` occurrences or more.

    ``respell(doc_id, word)`` may change a word before it is counted. Null and empty texts have no words; each row counts, repeated or
    not; an empty table has no words; other columns are not read. Counts are summed in each task before they are shuffled.
    """
    def count(batches):
        held: Counter = Counter()
        for b in chunks(batches, "_t"):
            for key, t in zip(b.column("_d").to_pylist(), b.column("_t").to_pylist()):
                found = Counter(WORD.findall(t.translate(_LOWER))) if t else {}
                for word, n in found.items():
                    if respell is not None:
                        word = respell(key, word)
                    if len(word) >= shortest:
                        held[word] += n
            if len(held) > 200_000:  # what a task holds is bounded; Spark adds up
                yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    parts = docs.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= fewest)


def parity_bands(word: str) -> list[int]:
    """The bands of a word's mask: letter c flips bit ``c / 3 mod 31`` of band ``c mod 3``."""
    masks = [0] * BANDS
    for c in map(ord, word):
        masks[c % BANDS] ^= 1 << c // BANDS % 31
    return masks


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of ``words`` (word, n; each once, none null) one edit apart, each pair once: a, an, b, bn."""
    def masked(batches):
        for b in batches:
            masks = [parity_bands(x) for x in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([m[k] for m in masks], pa.int32()) for k in range(BANDS)]], ["word", "n", *[f"m{k}" for k in range(BANDS)]])

    w = words.select("word", "n").mapInArrow(masked, "word string, n long, " + ", ".join(f"m{k} int" for k in range(BANDS)))

    def placed(short: bool) -> DataFrame:
        """Rows of words as the shorter of a pair (or one of equal length), or as the longer: a key a band and half."""
        size = F.length("word") - (0 if short else 1)
        half = (size / 2).cast("int")
        sides = [F.substring("word", F.lit(1), half), F.right("word", half)]
        places = F.array(*[F.struct(F.lit(k).alias("band"), F.lit(s).alias("side"), F.xxhash64(F.lit(k), f"m{k}", size, F.lit(s), side).alias("key")) for k in range(BANDS) for s, side in enumerate(sides)])
        return w.select("*", F.lit(short).alias("short"), F.explode(places).alias("at")).select("at.*", "short", "word", "n", *[f"m{k}" for k in range(BANDS)])

    x, y = placed(True).alias("x").hint("merge"), placed(True).unionByName(placed(False)).alias("y")
    at = lambda side, c: F.col(f"{side}.{c}")
    differ = [at("x", f"m{k}") != at("y", f"m{k}") for k in range(BANDS)]
    flipped = sum((F.bit_count(at("x", f"m{k}").bitwiseXOR(at("y", f"m{k}"))) for k in range(1, BANDS)), F.bit_count(at("x", "m0").bitwiseXOR(at("y", "m0"))))
    half = (F.length(at("x", "word")) / 2).cast("int")
    first_band = (at("x", "band") == 0) | ((at("x", "band") == 1) & differ[0]) | (differ[0] & differ[1])
    first_half = (at("x", "side") == 0) | (F.substring(at("x", "word"), F.lit(1), half) != F.substring(at("y", "word"), F.lit(1), half))
    same = (at("x", "key") == at("y", "key")) & (at("x", "band") == at("y", "band")) & (at("x", "side") == at("y", "side"))
    once = ~at("y", "short") | (at("x", "word") < at("y", "word"))
    near = F.levenshtein(at("x", "word"), at("y", "word"), 1) == 1
    return x.join(y, same & once & (flipped <= 2) & first_band & first_half & near).select(at("x", "word").alias("a"), at("x", "n").alias("an"), at("y", "word").alias("b"), at("y", "n").alias("bn"))


def variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """Every word of ``words`` (word, n; each word once, none null) with ``form``, ``root``, ``n_near``, ``form_n``.

    ``form`` is the near word of largest n (ties: smallest in code-point order) if its n is at least ``ratio`` (2 or more) times the word's,
    else null; ``root`` is reached by following forms to the last. Words without a near word have n_near 0, no form, and themselves as
    root. An empty table gives an empty one; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("ratio below 2: forms might lead in a circle")
    w = written(words.select("word", "n"), "words")
    both = F.explode(F.array(F.struct(F.col("a").alias("w"), F.col("b").alias("o"), F.col("bn").alias("on")), F.struct(F.col("b").alias("w"), F.col("a").alias("o"), F.col("an").alias("on")))).alias("p")
    best = near_pairs(w).select(both).groupBy(F.col("p.w").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("p.on")).alias("less"), F.col("p.o").alias("o"))).alias("best"))
    led = -F.col("best.less") >= ratio * F.col("n")
    formed = written(w.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("best.o")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n")), "forms")
    # Each step doubles the forms that are followed; n grows by the ratio with each, so a few steps reach every root.
    roots = written(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = written(roots.join(onward.hint("merge"), F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        free(roots)
        roots = step
        if not roots.filter("moved").limit(1).count():
            break
    return formed.join(roots.select("word", "root").hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
