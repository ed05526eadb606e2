"""Toxicity: a factorization machine over words, their beginnings and telling stretches of letters, whose factor products score pairs of terms found together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import disguise
from vitalgrid.llm.common import chunks, free, text_bytes, words, written

#: Bytes of a term: ASCII letters and everything above ASCII.
INSIDE = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Buckets: hashed words and beginnings below 2^WORD_BITS, stretches of letters by their code from there on.
WORD_BITS = disguise.BITS
BITS = WORD_BITS + 1
FACTORS = 4
HEADS = (4, 5, 6)


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every distinct term of the whole texts, in that order; with ``used`` (a boolean a bucket) only of those terms.

    Terms are words, their first 4, 5 and 6 bytes, and the stretches of ``disguise.stretches``.
    """
    _, _, hashed, at, heads = words(raw, offsets, INSIDE, HEADS)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    pairs = []
    for every in (hashed, *heads):
        bucket = (every >> np.uint64(64 - bits + 1)).astype(np.int64)
        ok = slice(None) if used is None else used[bucket]
        pairs.append((doc[ok] << bits) | bucket[ok])
    own, code = disguise.stretches(raw, offsets, None if used is None else used[1 << bits - 1 :])
    pairs = np.unique(np.concatenate([*pairs, (own << bits) | code | (1 << bits - 1)]))
    return pairs >> bits, pairs & ((1 << bits) - 1)


def scores(model: np.ndarray, bias: float, doc: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
    """Logits: bias, plus the terms' weights, plus the products of the factors of every pair over the number of terms (so long texts add no more noise)."""
    m = model[bucket]
    out = bias + np.bincount(doc, m[:, 0], n)
    many = np.maximum(np.bincount(doc[m[:, 1] != 0], minlength=n), 1)
    for k in range(1, model.shape[1]):
        s = np.bincount(doc, m[:, k], n)
        out += 0.5 * (s * s - np.bincount(doc, m[:, k].astype(np.float64) ** 2, n)) / many
    return out


def fit(doc: np.ndarray, bucket: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 1.0, decay: float = 2e-4, least: int = 5, sparse: float = 1e-3, seed: int = 7):
    """(buckets, their weight and factors, bias) by mini-batch adaptive gradient steps; terms of under ``least`` documents are left out."""
    rng = np.random.default_rng(seed)
    n = np.bincount(bucket)
    used = np.flatnonzero(n >= least)
    place = np.full(len(n), -1, np.int32)
    place[used] = np.arange(len(used))
    term = place[bucket]
    ok = term >= 0
    doc, term = doc[ok], term[ok]
    size = len(used)
    theta = np.concatenate([np.zeros((size, 1)), rng.normal(0, 0.05, (size, FACTORS))], axis=1)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias, seen, bias_seen = float(np.log(share / (1 - share))), np.full(theta.shape, 1e-2), 1e-2
    start = np.searchsorted(doc, np.arange(len(labels) + 1))
    for _ in range(epochs if size else 0):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), batch):
            mine = np.sort(order[a : a + batch])
            length = start[mine + 1] - start[mine]
            at = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
            row, t = np.repeat(np.arange(len(mine)), length), term[at]
            m = theta[t]
            sums = np.stack([np.bincount(row, m[:, k], len(mine)) for k in range(1, FACTORS + 1)], axis=1)
            squares = np.stack([np.bincount(row, m[:, k] ** 2, len(mine)) for k in range(1, FACTORS + 1)], axis=1)
            many = np.maximum(length, 1)
            z = bias + np.bincount(row, m[:, 0], len(mine)) + 0.5 * (sums**2 - squares).sum(axis=1) / many
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[mine]
            near, local = np.unique(t, return_inverse=True)
            grad = np.empty((len(near), FACTORS + 1))
            grad[:, 0] = np.bincount(local, g[row], len(near))
            for k in range(1, FACTORS + 1):
                grad[:, k] = np.bincount(local, (g / many)[row] * (sums[row, k - 1] - m[:, k]), len(near))
            grad = grad / len(mine) + decay * theta[near]
            seen[near] += grad**2
            pace = rate / np.sqrt(seen[near])
            moved = theta[near] - pace * grad
            moved[:, 0] = np.sign(moved[:, 0]) * np.maximum(np.abs(moved[:, 0]) - pace[:, 0] * sparse, 0)  # weights of chance terms go to 0
            theta[near] = moved
            b = g.mean()
            bias_seen += b * b
            bias -= rate * b / np.sqrt(bias_seen)
    return used, theta.astype(np.float32), bias


def telling(n: np.ndarray, toxic: np.ndarray, rows: int, share: float, least: int = 5, sure: float = 5.0) -> np.ndarray:
    """Which stretches, held by ``n`` of ``rows`` documents and by ``toxic`` toxic ones, toxic documents hold oftener, by ``sure`` standard deviations."""
    return (n >= least) & (toxic - n * share > sure * np.sqrt(n * share * (1 - share) * np.maximum(1 - n / rows, 0) + 1e-9))


def parted(doc: np.ndarray, bucket: np.ndarray, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents, and each once more with about half of its stretches and nothing else: so these tell without the words they are from."""
    own = np.flatnonzero(bucket >= 1 << WORD_BITS)
    own = own[np.random.default_rng(seed).random(len(own)) < 0.5]
    return np.concatenate([doc, doc[own] + len(labels)]), np.concatenate([bucket, bucket[own]]), np.concatenate([labels, labels])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, text: str = "text", label: str = "toxic", key: str = "doc_id") -> tuple[np.ndarray, float]:
    """The model table (2^BITS, 1 + FACTORS) and bias, fitted in one task on a sample of about ``max_rows`` labelled rows (by hash of ``key``,
    so always the same rows). Null labels and keys teach nothing; of repeated labels of a key the largest counts. Without labels every score is 0.
    """
    own = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("double").alias("_y"))
    n = own.count()
    sample = own.filter(F.pmod(F.xxhash64("_k"), F.lit(1 << 20)) < int(min(1.0, max_rows / max(n, 1)) * (1 << 20)) + 1)
    rows = docs.select(F.col(key), F.col(text).alias("_t")).join(F.broadcast(sample), F.col(key) == F.col("_k")).select(F.xxhash64("_k").alias("_o"), "_y", "_t")  # about max_rows of 16 bytes
    rows = written(rows, "toxicity")

    def counted(batches):
        found = np.zeros((2, 1 << WORD_BITS), np.int64)
        size = total = 0.0
        for b in chunks(batches, "_t"):
            y = b.column("_y").to_numpy(zero_copy_only=False)
            doc, code = disguise.stretches(*text_bytes(b.column("_t")))
            pairs = np.unique((doc << WORD_BITS) | code)
            code = pairs & ((1 << WORD_BITS) - 1)
            found[0] += np.bincount(code, minlength=1 << WORD_BITS)
            found[1] += np.bincount(code[y[pairs >> WORD_BITS] > 0.5], minlength=1 << WORD_BITS)
            size, total = size + len(y), total + (y > 0.5).sum()
        at = np.flatnonzero(found[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[0][at], int(size))), pa.array(np.append(found[1][at], int(total)))], ["c", "n", "y"])

    sums = rows.mapInArrow(counted, "c long, n long, y long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).filter("c < 0 or (n >= 5 and y > 0)").toArrow()
    c, n, y = (sums.column(k).to_numpy() for k in range(3))
    used = np.ones(1 << BITS, bool)
    used[1 << WORD_BITS :] = False
    if (c < 0).any() and n[c < 0][0]:
        used[(1 << WORD_BITS) + c[(c >= 0) & telling(n, y, n[c < 0][0], y[c < 0][0] / n[c < 0][0])]] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(used))

    def hashed(batches):
        used = np.unpackbits(shared.value).astype(bool)
        for b in chunks(batches, "_t"):
            doc, bucket = features(*text_bytes(b.column("_t")), used=used)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("_o"), b.column("_y"), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(bucket.astype(np.int32)))], ["o", "y", "b"])

    def learn(batches):
        y, lists = [], []
        for b in batches:
            y.append(b.column(1).to_numpy(zero_copy_only=False))
            lists += [x.values.to_numpy(zero_copy_only=False) for x in b.column(2)]
        if y:
            doc = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
            bucket = np.concatenate(lists)
            lists.clear()
            used, theta, bias = fit(*parted(doc, bucket, np.concatenate(y)))
            yield pa.RecordBatch.from_arrays([pa.array([used.astype(np.int32).tobytes()]), pa.array([theta.tobytes()]), pa.array([bias])], ["u", "t", "bias"])

    found = rows.mapInArrow(hashed, "o long, y double, b array<int>").orderBy("o", F.xxhash64("b")).coalesce(1).mapInArrow(learn, "u binary, t binary, bias double").collect()
    free(rows)
    table = np.zeros((1 << BITS, 1 + FACTORS), np.float32)
    if not found:
        return table, -np.inf
    table[np.frombuffer(found[0]["u"], np.int32)] = np.frombuffer(found[0]["t"], np.float32).reshape(-1, 1 + FACTORS)
    return table, found[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); such columns are replaced.

    Only the text is read. Null and empty texts get the score of the bias alone; repeated rows get equal scores.
    """
    docs = docs.drop("score", "predicted")
    used = np.flatnonzero(model[0].any(axis=1))
    shared = docs.sparkSession.sparkContext.broadcast((used.astype(np.int32), model[0][used], model[1]))
    names = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["score double", "predicted int"])

    def predict(batches):
        used, theta, bias = shared.value
        table = np.zeros((1 << BITS, 1 + FACTORS), np.float32)
        table[used] = theta
        told = np.zeros(1 << BITS, bool)
        told[used] = True
        for b in chunks(batches, text):
            doc, bucket = features(*text_bytes(b.column(text)), used=told)
            z = scores(table, bias, doc, bucket, b.num_rows)
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700))) if np.isfinite(bias) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(predict, schema)
