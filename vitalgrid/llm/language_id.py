"""Language ID by word-first backoff: known words score by their log frequency in each language, others by ever shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import written

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
UNKNOWN = "und"


def letters(text: str) -> list[str]:
    """Lower-cased runs of letters."""
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _count(batches):
    words: Counter = Counter()

    def flush():
        rows = [(k[0], k[1], 0, n) for k, n in words.items()]
        parts: Counter = Counter()
        for (lang, w), n in words.items():
            for size in range(1, LONGEST + 1):
                for g in grams(w, size):
                    parts[lang, g, size] += n
        rows += [(lang, g, size, n) for (lang, g, size), n in parts.items()]
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["lang", "term", "size", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.update((lang, w) for w in letters(text) if len(w) <= 64)
        if len(words) > 200_000:
            yield flush()
            words.clear()
    yield flush()


class Model:
    """Per-language log frequencies of words and of 1- to 4-grams; at most ``max_terms`` of each kind."""

    def __init__(self, langs: list[str], priors: np.ndarray, tables: list[dict[str, tuple]], floors: list[tuple]):
        self.langs, self.priors, self.tables, self.floors = langs, priors, tables, floors

    def word(self, w: str) -> tuple[float, ...]:
        """The word's score by language: as a whole if known, else the mean over the longest n-grams of which one is known."""
        known = self.tables[0].get(w)
        if known is not None:
            return known
        marked = f"^{w}$"
        for size in range(LONGEST, 0, -1):
            table = self.tables[size]
            parts = [marked[i : i + size] for i in range(len(marked) - size + 1)]
            found = [v for v in map(table.get, parts) if v is not None]
            if found:
                missing, n = len(parts) - len(found), len(parts)
                return tuple([(sum(x) + missing * low) / n for x, low in zip(zip(*found), self.floors[size])])
        return (0.0,) * len(self.langs)


def train(labelled: DataFrame, max_rows: int = 20_000, max_terms: int = 60_000, text: str = "text", lang: str = "lang", order: str = "doc_id") -> Model:
    """Fits on a sample of about ``max_rows`` labelled rows (by hash of ``order`` and the text, so always the same), keeps the ``max_terms`` commonest
    words and n-grams of each size: the model is of bounded size, whatever the corpus. Rows of null text or language teach nothing.
    """
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(order, text).alias("_o"))
    n = rows.count()
    sample = rows.filter(F.pmod("_o", F.lit(1 << 20)) < int(min(1.0, max_rows / max(n, 1)) * (1 << 20)) + 1).select("lang", "text")
    counts = written(sample.mapInArrow(_count, "lang string, term string, size int, n long").groupBy("lang", "term", "size").agg(F.sum("n").alias("n")), "counts")
    by_term = counts.groupBy("size", "term").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
    totals = counts.groupBy("size", "lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("terms")).collect()
    langs = sorted({r["lang"] for r in totals if r["size"] == 0})
    if not langs:
        return Model([], np.zeros(0), [{} for _ in range(LONGEST + 1)], [()] * (LONGEST + 1))
    tables, floors = [], []
    place = {x: i for i, x in enumerate(langs)}
    for size in range(LONGEST + 1):
        total, terms = np.ones(len(langs)), np.ones(len(langs))
        for r in totals:
            if r["size"] == size:
                total[place[r["lang"]]], terms[place[r["lang"]]] = r["n"], r["terms"]
        bottom = np.log(total + 0.5 * terms.max())
        table = {}
        for r in by_term.filter(F.col("size") == size).filter("size > 0 or total > 1").orderBy(F.desc("total"), "term").limit(max_terms).select("term", "by").collect():
            v = np.full(len(langs), 0.5)
            for x, n in r["by"].items():
                v[place[x]] += n
            table[r["term"]] = tuple((np.log(v) - bottom).tolist())
        tables.append(table)
        floors.append(tuple((np.log(0.5) - bottom).tolist()))
    return Model(langs, np.zeros(len(langs)), tables, floors)


class _Cache(dict):
    """Word to its row of a growing score matrix."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.matrix = model, np.zeros((4096, len(model.langs)))

    def __missing__(self, w: str) -> int:
        n = len(self)
        if n == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        self.matrix[n] = self.model.word(w)
        self[w] = n
        return n


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score`` (both replaced if there): the language of highest mean word score over the
    whole text and its share of probability. Null texts, texts without letters, and any text where nothing was learned get ``und`` and 0.
    Ties go to the first language in order of name. Only the text is read.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string", "score double"])
    names = docs.columns

    def predict(batches):
        model = shared.value
        cache = _Cache(model)
        for batch in batches:
            langs, scores = [], []
            for value in batch.column(text):
                t = value.as_py()
                found = letters(t) if t else []
                if not model.langs or not any(c.isalpha() for w in found for c in w):
                    langs.append(UNKNOWN), scores.append(0.0)
                    continue
                if len(cache) > 300_000:  # bounded memory
                    cache = _Cache(model)
                at = np.fromiter(map(cache.__getitem__, found), np.int64, len(found))
                s = cache.matrix[at].sum(axis=0)
                s = s / np.sqrt(len(found)) + model.priors
                best = int(np.argmax(s))
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp(s - s[best]).sum()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)
