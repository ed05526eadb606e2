"""Suffix-array dedup: bytes of a text covered by a long string that also starts in an earlier document are removed.

Equal strings must meet in one shard. Every ``length``-byte window is filed under the smallest hash of the 24-byte strings in
it, which depends on the window alone; runs of windows of one document with the same such anchor make a segment. Only anchors that
two documents share go on. Shards of distinct segments are sorted by suffix arrays; where neighbours share ``length`` bytes, the
windows are equal and their smallest document is known. A key whose segments are all equal needs no sorting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm.common import _BASE, _BYTE, _UNBASE, _powers, chunks, free, hidden, mix, text_bytes, written
from vitalgrid.llm.meeting import SCHEMA, dealt, shared
from vitalgrid.llm.suffix_array import common_prefixes, suffix_array

LENGTH = 50
GRAM = 24


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
    """(document, first window start, last window start, anchor key) of every run of windows with one anchor."""
    n, wide = len(raw), length - GRAM + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.view(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_BASE, n), out=sums[1:])
    h = mix((sums[GRAM:] - sums[:-GRAM]) * _powers(_UNBASE, n)[: n - GRAM + 1])
    low = np.uint64(wide.bit_length())  # keys are hashes without their low bits, which hold the place modulo a power of two instead
    part = (np.uint64(1) << low) - np.uint64(1)
    code = (h & ~part) | (np.arange(len(h), dtype=np.uint64) & part)
    at, size = code, 1
    while size * 2 <= wide:
        at = np.minimum(at[: len(at) - size], at[size:])
        size *= 2
    if wide > size:
        at = np.minimum(at[: len(at) - (wide - size)], at[wide - size :])
    fresh = np.ones(len(at), bool)  # where the anchor's place changes, or a text starts
    fresh[1:] = at[1:] != at[:-1]
    begins, ends = offsets[:-1], offsets[1:]
    fresh[begins[begins < len(at)]] = True
    out = np.maximum(ends[:, None] - np.arange(1, length), begins[:, None]).ravel()  # windows that would leave their text
    held = np.repeat(ends > begins, length - 1) & (out < len(at))
    fresh[out[held]] = False
    where = np.flatnonzero(fresh)
    doc = np.searchsorted(offsets, where, side="right") - 1
    last = np.minimum(np.concatenate([where[1:] - 1, [len(at) - 1]]), offsets[doc + 1] - length) if len(where) else none
    return doc, where, last, at[where] & ~part


def anchor_keys(rows: DataFrame, length: int) -> DataFrame:
    """The dealt (anchor, document) pairs of ``rows`` (_id, _text)."""
    def make(batches):
        keys, own, size = [], [], 0
        for b in chunks(batches, "_text"):
            doc, _, _, key = anchors(*text_bytes(b.column("_text")), length)
            keys.append(key)
            own.append(b.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)[doc])
            size += len(key)
            if size > 1_500_000:
                yield dealt(np.concatenate(keys), np.concatenate(own))
                keys, own, size = [], [], 0
        if size:
            yield dealt(np.concatenate(keys), np.concatenate(own))

    return rows.select("_id", "_text").mapInArrow(make, SCHEMA)


def segments(rows: DataFrame, keys: DataFrame, length: int) -> DataFrame:
    """(key, mark, doc, row, start, seg): the segments of ``rows`` (_id, _row, _text) whose anchors are in ``keys`` (key, id)."""
    own = keys.groupBy("id").agg(F.collect_set("key").alias("_keys"))
    def cut(batches):
        for b in chunks(batches, "_text"):
            raw, offsets = text_bytes(b.column("_text"))
            doc, first, last, key = anchors(raw, offsets, length)
            at = np.searchsorted(doc, np.arange(b.num_rows + 1))
            keep = np.zeros(len(doc), bool)
            for k, mine in enumerate(b.column("_keys")):
                mine = mine.values.to_numpy(zero_copy_only=False).view(np.uint64)
                keep[at[k] : at[k + 1]] = np.isin(key[at[k] : at[k + 1]], mine)
            doc, first, last, key = doc[keep], first[keep], last[keep], key[keep]
            data = raw.tobytes()
            seg = [data[x : y + length] for x, y in zip(first.tolist(), last.tolist())]
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("_id").take(pick), b.column("_row").take(pick), pa.array(first - offsets[doc]), pa.array(seg, pa.binary())], ["key", "doc", "row", "start", "seg"])

    joined = rows.join(own, F.col("_id") == F.col("id")).select("_id", "_row", "_text", "_keys")
    return joined.mapInArrow(cut, "key long, doc long, row long, start long, seg binary").withColumn("mark", F.xxhash64("seg"))


def _first_documents(docs: np.ndarray, raw: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard of segments (owner documents, bytes end to end, sizes): runs of windows with one smallest document of all equal windows,
    as (segment, document, windows in the run).
    """
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    text = np.ones(len(owner) + 1, np.int16)
    inside = np.ones(len(text), bool)
    inside[ends] = inside[-1] = False
    text[inside] = raw.astype(np.int16) + 2
    text[-1] = 0
    order = suffix_array(text)
    prefix = common_prefixes(text, order, length)
    order, prefix = order[1:], prefix[1:]  # the sentinel is the first
    valid = order + length <= ends[owner[order]]
    # Between two equal windows in suffix order stand equal windows only, so the prefix shared with the suffix before tells groups apart.
    group = np.cumsum(prefix < length)[valid]
    order = order[valid]
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(docs[owner[order]], cut)
    first = np.empty(len(text), np.int64)
    first[order] = np.repeat(least, np.diff(np.concatenate([cut, [len(order)]])))
    at = np.sort(order)  # the windows in text order
    fresh = np.concatenate([[True], (owner[at[1:]] != owner[at[:-1]]) | (first[at[1:]] != first[at[:-1]])])
    edge = np.flatnonzero(fresh)
    return owner[at[edge]], first[at[edge]], np.diff(np.concatenate([edge, [len(at)]]))


def _lists(rows: int, owner: np.ndarray, *columns: np.ndarray) -> pa.Array:
    """A list for each of ``rows``: the interleaved values of ``columns`` whose ``owner`` (ascending) it is."""
    flat = np.stack(columns, axis=1).ravel() if len(owner) else np.zeros(0, np.int64)
    at = np.searchsorted(owner, np.arange(rows + 1)) * len(columns)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int64()))


def first_documents(distinct: DataFrame, length: int, shard_bytes: int = 2 << 20) -> DataFrame:
    """(key, mark, firsts) of ``distinct`` (key, mark, seg, doc): a suffix array for every ``shard_bytes`` or so of segments with whole keys.
    A key of one distinct segment needs none: its smallest document is known.
    """
    def make(batches):
        held: list = []
        size = 0

        def out(parts):
            b = pa.concat_batches(parts)
            raw, offsets = text_bytes(b.column("seg"))
            key, docs, sizes = b.column("key").to_numpy(), b.column("doc").to_numpy(), np.diff(offsets)
            fresh = np.concatenate([[True], key[1:] != key[:-1], [True]])
            alone = fresh[:-1] & fresh[1:]
            one, several = np.flatnonzero(alone), np.flatnonzero(~alone)
            owner, first, n = one, docs[one], sizes[one] - length + 1
            if len(several):
                runs = _first_documents(docs[several], raw[np.repeat(~alone, sizes)], sizes[several], length)
                owner, first, n = np.concatenate([owner, several[runs[0]]]), np.concatenate([first, runs[1]]), np.concatenate([n, runs[2]])
                order = np.argsort(owner, kind="stable")
                owner, first, n = owner[order], first[order], n[order]
            return pa.RecordBatch.from_arrays([b.column("key"), b.column("mark"), _lists(b.num_rows, owner, first, n)], ["key", "mark", "firsts"])

        last = None
        for b in batches:
            if not b.num_rows:
                continue
            key, ends = b.column("key").to_numpy(), text_bytes(b.column("seg"))[1]
            begin = 0
            for cut in np.flatnonzero(np.concatenate([[held != [] and key[0] != last], key[1:] != key[:-1]])).tolist():
                if size + ends[cut] - ends[begin] >= shard_bytes:  # full, and a key ends here
                    yield out([*held, b.slice(begin, cut - begin)])
                    held, size, begin = [], 0, cut
            held.append(b.slice(begin))
            size, last = size + int(ends[-1] - ends[begin]), key[-1]
        if held:
            yield out(held)

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.select("key", "mark", "seg", "doc").repartition(n, "key").sortWithinPartitions("key").mapInArrow(make, "key long, mark long, firsts array<long>")


def _covered(found: DataFrame, length: int) -> DataFrame:
    """(doc, row, spans) of the covered byte ranges [from, to) of each segment of (doc, row, start, firsts)."""
    def make(batches):
        for b in batches:
            doc, row, start = (b.column(c).to_numpy() for c in ("doc", "row", "start"))
            runs = b.column("firsts")
            at = runs.offsets.to_numpy().astype(np.int64)
            flat = runs.values.to_numpy()
            first, n = flat[at[0] : at[-1]][0::2], flat[at[0] : at[-1]][1::2]
            owner = np.repeat(np.arange(len(doc)), np.diff(at) // 2)
            before = np.cumsum(n) - n
            heads = (at[:-1] - at[0]) // 2
            place = before - before[np.minimum(heads, max(len(before) - 1, 0))][owner] + start[owner] if len(n) else n
            hit = first < doc[owner]
            owner, low, high = owner[hit], place[hit], (place + n - 1 + length)[hit]
            keep = np.unique(owner)
            pick = pa.array(keep)
            yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(row[keep]), _lists(len(doc), owner, low, high).take(pick)], ["doc", "row", "spans"])

    return found.select("doc", "row", "start", "firsts").mapInArrow(make, "doc long, row long, spans array<long>")


RESULTS = ("n_bytes", "n_removed", "n_spans", "removed_spans", "kept")


def repeated_spans(rows: DataFrame, length: int = LENGTH, most_segments: int = 20_000) -> DataFrame:
    """(doc, row, spans) of the byte ranges to remove from ``rows`` (_id, _row, _text), unmerged; ``_row`` tells the texts of one id apart."""
    rows = rows.filter(F.col("_id").isNotNull() & (F.octet_length("_text") >= length))
    # Equal texts are one document to the arrays: the smallest id stands for them, the others are covered from end to end.
    hashed = written(rows.select("_id", "_row", F.sha2(F.col("_text").cast("binary"), 256).alias("_hash"), F.octet_length("_text").cast("long").alias("_size")), "texts")
    first = written(hashed.groupBy(F.col("_hash").alias("_h")).agg(F.min("_id").alias("_first")), "firsts")  # written, so that a hot text is split in the join
    texts = written(hashed.join(first, F.col("_hash") == F.col("_h")).select("_id", "_row", "_size", (F.col("_id") == F.col("_first")).alias("_is_first")), "texts")
    copies = texts.groupBy("_id").agg(F.max("_is_first").alias("_any")).filter("not _any").select(F.col("_id").alias("_copy"))
    copies = written(copies, "copies")
    whole = texts.filter("not _is_first").select(F.col("_id").alias("doc"), F.col("_row").alias("row"), F.array(F.lit(0).cast("long"), F.col("_size")).alias("spans")).distinct()
    keys = written(shared(anchor_keys(rows, length)).join(copies, F.col("id") == F.col("_copy"), "left_anti"), "anchors")
    still = written(keys.groupBy(F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_k"), "still")
    found = tables = written(segments(rows, keys.join(still, F.col("key") == F.col("_k"), "left_semi"), length), "segments")
    free(keys, still, copies)
    distinct = several = written(found.groupBy("key", "mark", "seg").agg(F.min("doc").alias("doc")), "distinct")
    crowded = written(distinct.groupBy(F.col("key").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most_segments).select("_c"), "crowded")
    is_crowded = F.col("key") == F.col("_c")
    alone = None
    if crowded.limit(1).count():  # the end of a very common passage: many texts follow it, so its windows are dealt one by one
        single = F.explode(F.transform(F.sequence(F.lit(0), F.octet_length("seg") - length), lambda i: F.struct(i.cast("long").alias("i"), F.substring("seg", i + 1, F.lit(length)).alias("w"))))
        alone = found.join(crowded, is_crowded, "left_semi").withColumn("_w", single)
        alone = alone.select(F.xxhash64("_w.w").alias("key"), "doc", "row", (F.col("start") + F.col("_w.i")).alias("start"), F.col("_w.w").alias("seg"), F.xxhash64(F.lit(length), "_w.w").alias("mark"))
        alone = written(alone, "alone")
        found, distinct = found.join(crowded, is_crowded, "left_anti").unionByName(alone), distinct.join(crowded, is_crowded, "left_anti")
    firsts = first_documents(distinct, length)
    if alone is not None:
        firsts = firsts.unionByName(alone.groupBy("key", "mark", "seg").agg(F.min("doc").alias("doc")).select("key", "mark", F.array("doc", F.lit(1).cast("long")).alias("firsts")))
    firsts = firsts.select(F.col("key").alias("_k"), F.col("mark").alias("_m"), "firsts")
    met = found.select("key", "mark", "row", "doc", "start").join(firsts, (F.col("key") == F.col("_k")) & (F.col("mark") == F.col("_m")))
    spans = _covered(met, length).unionByName(whole).groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_in")).agg(F.flatten(F.collect_list("spans")).alias("_spans"))
    spans = written(spans, "spans")
    free(hashed, first, texts, tables, several, crowded, *([alone] if alone is not None else []))
    return spans


def suffix_dedup(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", most_segments: int = 20_000) -> DataFrame:
    """Every row of ``docs`` with ``n_bytes``, ``n_removed``, ``n_spans``, ``removed_spans`` ([from, to) byte pairs, flat) and ``kept`` (bytes).

    Texts are judged on the input as UTF-8 bytes, null as empty; what is kept need not be whole characters. Rows of one doc_id are one
    document among themselves; rows without a doc_id neither lose bytes nor make others lose any. Columns of those names are replaced,
    any other column stays, whatever its name. Keys of more than ``most_segments`` distinct segments are taken apart window by window.
    """
    docs = docs.drop(*RESULTS)
    cover = hidden(docs)
    own, names, inner = cover.of(text), docs.columns, cover.frame.columns
    rows = cover.frame.withColumns({"_id": F.col(cover.of(doc_id)).cast("long"), "_text": F.col(own)}).withColumn("_row", F.xxhash64(F.coalesce("_text", F.lit(""))))
    spans = repeated_spans(rows.select("_id", "_row", "_text"), length, most_segments)
    df = rows.join(spans, (F.col("_id") == F.col("_doc")) & (F.col("_row") == F.col("_in")), "left").select(*inner, "_spans")
    schema = ", ".join([f"{c} {f.dataType.simpleString()}" for c, f in zip(inner, docs.schema)] + ["n_bytes long, n_removed long, n_spans long, removed_spans array<long>, kept binary"])

    def remove(batches):
        for b in chunks(batches, own, 8 << 20):
            out = [[] for _ in range(5)]
            for t, s in zip(b.column(own).cast(pa.large_binary()), b.column("_spans")):
                t, flat = t.as_py() or b"", s.as_py() or []
                merged: list[int] = []
                for x, y in sorted(zip(flat[0::2], flat[1::2])):
                    if merged and x <= merged[-1]:
                        merged[-1] = max(merged[-1], y)
                    else:
                        merged += [x, y]
                edges = [0, *merged, len(t)]
                kept = b"".join(t[x:y] for x, y in zip(edges[0::2], edges[1::2]))
                for column, value in zip(out, (len(t), len(t) - len(kept), len(merged) // 2, merged, kept)):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in inner], *[pa.array(c, t) for c, t in zip(out, types)]], [*inner, *RESULTS])

    return df.mapInArrow(remove, schema).toDF(*names, *RESULTS)
