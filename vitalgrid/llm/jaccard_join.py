"""N-gram Jaccard join by parity sketches.

Each token (the hash of a word shingle) flips one bit of a document's sketch, so the Hamming distance of two sketches never
exceeds the symmetric difference of the sets. A sketch is cut into parts; documents of like size whose sets differ by at most d
agree on all but d parts, so with more parts than d at least one is equal (pigeonhole), and equal parts meet in a hash join.
Pairs that meet are tested by the Hamming distance of whole sketches, then by the sets themselves.

With similarity 4/5, linked sets A and B have |A xor B| <= (|A| + |B|) / 9 and sizes within a factor 5/4.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalgrid.llm.common import chunks, free, mix, shingles, text_bytes, words, written
from vitalgrid.llm.components import components
from vitalgrid.llm.meeting import SCHEMA, dealt, shared

WIDTH = 5
NUM, DEN = 4, 5  # similarity NUM / DEN
#: Bytes of a word: all but ASCII white space.
INSIDE = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
_EMPTY = 0x632BE59BD9B4E019


def _differ(total):
    """Most elements in which linked sets of together ``total`` elements differ."""
    return total * (DEN - NUM) // (DEN + NUM)


def level(n: int) -> int:
    """log2 of the number of parts of size band ``n``: a quarter above the largest difference, so that some parts may be empty or shared by many."""
    return int(_differ(2 * n) * 5 // 4 + 1).bit_length()


_TOPS = [0] * 64


def _top(lv: int) -> int:
    """The largest size whose level is ``lv``."""
    if not _TOPS[lv]:
        n = 1 << lv
        while level(n + 1) <= lv:
            n += max(1, n >> 6) if level(n + 1 + (n >> 6)) <= lv else 1
        _TOPS[lv] = n
    return _TOPS[lv]


def levels(n: int) -> list[int]:
    """Bands a set of ``n`` joins: its own, and the next ones if a larger partner may lie there."""
    return list(range(level(n), level(n * DEN // NUM) + 1))


def spare(n: int, lv: int) -> int:
    """Parts of band ``lv`` that surely agree with any partner there, less one: as many may be without use as keys."""
    return (1 << lv) - _differ(n + min(n * DEN // NUM, _top(lv))) - 1


def sets(raw: np.ndarray, offsets: np.ndarray):
    """Each text's tokens: sorted distinct hashes of its shingles; of a shorter text its whole word sequence, of a wordless one none."""
    _, _, hashed, at = words(raw, offsets, INSIDE)
    for a, b in zip(at[:-1], at[1:]):
        own = hashed[a:b]
        found = np.sort(shingles(own, WIDTH if len(own) >= WIDTH else max(1, len(own))))
        yield found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def parts(tokens: np.ndarray, lv: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts of the parity sketch that hold a token, and the numbers of those that hold none. A key's low 5 bits are its band."""
    n = 1 << lv
    at = (tokens & np.uint64(n - 1)).astype(np.int64)
    held = np.bincount(at, minlength=n) > 0
    xor = np.zeros(n, np.uint64)
    np.bitwise_xor.at(xor, at, mix(tokens >> np.uint64(lv)))
    where = np.flatnonzero(held)
    return _key(xor[where], where, lv), np.flatnonzero(~held)


def _key(content: np.ndarray, where: np.ndarray, lv: int) -> np.ndarray:
    return (mix(content + where.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) & ~np.uint64(31)) | np.uint64(lv)


def sketch(tokens: np.ndarray) -> bytes:
    """Parity bits, at least two for each token."""
    bits = 256
    while bits < 2 * len(tokens):
        bits *= 2
    flips = np.bincount((mix(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance after folding the larger sketch onto the size of the smaller one."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, n, h1, h2, empty, bits): size, two independent hashes of the set, its number of empty parts in each of its bands, and its sketch."""
    def sign(batches):
        for b in chunks(batches, text):
            n, h1, h2, empty, bits = [], [], [], [], []
            for t in sets(*text_bytes(b.column(1))):
                n.append(len(t))
                h1.append(int(np.bitwise_xor.reduce(mix(t ^ np.uint64(0xA5A5A5A5)))) if len(t) else 0)
                h2.append(int(mix(t + np.uint64(77)).sum()) if len(t) else 0)
                empty.append([(1 << lv) - len(np.unique(t & np.uint64((1 << lv) - 1))) for lv in levels(len(t))] if len(t) else [])
                bits.append(sketch(t))
            wrap = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), wrap(h1), wrap(h2), pa.array(empty, pa.list_(pa.int32())), pa.array(bits, pa.binary())], ["id", "n", "h1", "h2", "empty", "bits"])

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(sign, "id long, n long, h1 long, h2 long, empty array<int>, bits binary")


def keys(docs: DataFrame, doc_id: str, text: str, flush: int = 1_500_000) -> DataFrame:
    """The dealt keys of every part. Within a batch of a task only the smallest id of equal sets makes keys, so copies add nothing."""
    def make(batches):
        held, first, size = [], {}, 0
        flat = lambda: dealt(np.concatenate([k for k, _ in held]), np.concatenate([np.full(len(k), i, np.int64) for k, i in held]))
        for b in chunks(batches, text):
            for i, t in zip(b.column(0).to_pylist(), sets(*text_bytes(b.column(1)))):
                if i is None or not len(t):
                    continue
                whole = (len(t), int(np.bitwise_xor.reduce(mix(t ^ np.uint64(0xA5A5A5A5)))), int(t[0]))
                if first.get(whole, i + 1) <= i:
                    continue
                first[whole] = i
                for lv in levels(len(t)):
                    k, empty = parts(t, lv)
                    if len(empty) > spare(len(t), lv):  # might agree with a partner on empty parts alone
                        k = np.concatenate([k, _key(np.full(len(empty), _EMPTY, np.uint64), empty, lv)])
                    held.append((k, i))
                    size += len(k)
            if size > flush:
                yield flat()
                held, first, size = [], {}, 0
        if held:
            yield flat()

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(make, SCHEMA)


def token_sets(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(sid, tokens) of the documents in ``ids`` (one column), as a table. The ids are written first, so that Spark knows their size before it
    chooses between sending them to the texts and shuffling the texts.
    """
    def make(batches):
        for b in chunks(batches, text):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.tobytes() for t in sets(*text_bytes(b.column(1)))], pa.binary())], ["sid", "tokens"])

    ids = written(ids.distinct().toDF("_i"), "ids")
    mine = docs.select(F.col(doc_id).cast("long").alias("sid"), F.col(text)).join(ids, F.col("sid") == F.col("_i"), "left_semi")
    return written(mine.mapInArrow(make, "sid long, tokens binary"), "sets")


def _verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets are as similar as asked."""
    side = lambda s: held.select(F.col("sid").alias(s), F.col("tokens").alias(f"t{s}"))

    def test(batches):
        for b in chunks(batches, "ta"):
            ok = [similar(x.as_buffer(), y.as_buffer()) for x, y in zip(b.column("ta"), b.column("tb"))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(test, "a long, b long")


def similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    inter = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * inter >= NUM * (len(x) + len(y) - inter)


def _affordable(rows: DataFrame, signs: DataFrame, hot: int) -> DataFrame:
    """``rows`` (key, id, _n: documents of the key) without as many of a document's commonest keys (of more than ``hot`` documents) as it can spare.

    A partner agrees on at least spare + 1 parts, so on more than ``slack`` (spare less its empty parts) that hold a token. If each drops its
    ``slack`` commonest keys, by one order for all, the least common key they agree on stays with both. So no link is lost.
    """
    common = rows.filter(F.col("_n") > hot).withColumn("lv", F.col("key").bitwiseAND(31).cast("int"))

    def judge(batches):
        for b in batches:
            lv, n, empty = (b.column(c).to_pylist() for c in ("lv", "n", "empty"))
            slack = [spare(k, v) - e[v - level(k)] for v, k, e in zip(lv, n, empty)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lv"), pa.array(slack, pa.int64())], ["_i", "_l", "slack"])

    bands = common.select("id", "lv").distinct().join(signs.select(F.col("id").alias("_i"), "n", "empty"), F.col("id") == F.col("_i"))
    slack = bands.select("id", "lv", "n", "empty").mapInArrow(judge, "_i long, _l int, slack long").filter("slack > 0")
    place = F.row_number().over(Window.partitionBy("id", "lv").orderBy(F.desc("_n"), "key"))
    kept = common.withColumn("_at", place).join(slack, (F.col("id") == F.col("_i")) & (F.col("lv") == F.col("_l")), "left").filter(F.col("_at") > F.coalesce("slack", F.lit(0)))
    return rows.filter(F.col("_n") <= hot).select("key", "id").unionByName(kept.select("key", "id"))


def _candidates(docs: DataFrame, signs: DataFrame, doc_id: str, text: str, hot: int) -> DataFrame:
    """(key, id) of the keys that two class representatives or more have."""
    reps = signs.filter("id = rep").select("id", "n", "empty")
    rows = shared(keys(docs, doc_id, text)).join(reps.select(F.col("id").alias("_i")).distinct(), F.col("id") == F.col("_i"), "left_semi").distinct()
    every = written(rows, "keys")
    # Aggregates are written before they are joined: Spark splits a hot key only where both sides of a join come from an exchange.
    many = written(every.groupBy(F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "counts")
    met = written(every.join(many, F.col("key") == F.col("_k")).select("key", "id", "_n"), "keys")
    free(every, many)
    rows = written(_affordable(met, reps, hot), "keys")
    free(met)
    return rows


def _open_keys(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``rows`` with ``comp``, of the keys whose documents are of several components, and the key's number of documents ``size``. Of keys with
    one and the same documents one stays.
    """
    now = rows.withColumn("comp", F.col("id")) if comp is None else rows.join(comp.select(F.col("id").alias("_i"), "comp"), F.col("id") == F.col("_i"), "left").drop("_i").withColumn("comp", F.coalesce("comp", "id"))
    sizes = now.groupBy(F.col("key").alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.bit_xor(F.xxhash64("id")).alias("_x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("_y")).filter("_lo <> _hi")
    one = written(sizes.groupBy("_n", "_x", "_y").agg(F.min("_k").alias("_k")).select("_k", F.col("_n").alias("size")), "sizes")
    return written(now.join(one, F.col("key") == F.col("_k")).drop("_k"), "open")


def _block(block: int):
    """Documents of a block of the key or band in the column ``lv``: fewer of very long ones, so that a cell's sets fit a task."""
    return F.greatest(F.lit(16), F.least(F.lit(block), F.expr("shiftright(1073741824, lv + 9)")))


def _sampled_cells(now: DataFrame, block: int) -> DataFrame:
    """(cell, sid, comp, side): each key's documents dealt at random to cells of about ``block``."""
    now = now.withColumn("lv", F.col("key").bitwiseAND(31).cast("int"))
    home = F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("size") / _block(block)))
    return now.select(F.xxhash64("key", home).alias("cell"), F.col("id").alias("sid"), "comp", F.lit(-1).alias("side"))


def _all_cells(now: DataFrame, block: int) -> DataFrame:
    """(cell, sid, comp, side) in which any two documents of one key and different components meet; sides 0 and 1 meet each other, -1 any.

    A key of up to 2 * ``block`` documents is one cell. In a larger one, the documents outside its commonest component are dealt to blocks
    that meet each other and every block of that component, whose documents do not meet among themselves: with few outsiders each document
    is sent once.
    """
    tops = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("_m")).groupBy(F.col("key").alias("_k")).agg(F.max(F.struct("_m", "comp")).alias("_top"))
    tops = written(tops, "tops")
    rows = now.join(tops, F.col("key") == F.col("_k")).withColumn("lv", F.col("key").bitwiseAND(31).cast("int")).withColumn("block", _block(block))
    rows = rows.select("key", "id", "comp", "size", "block", (F.col("comp") == F.col("_top.comp")).alias("main"), F.ceil((F.col("size") - F.col("_top._m")) / F.col("block")).cast("int").alias("outer"), F.ceil(F.col("_top._m") / F.col("block")).cast("int").alias("inner"))
    rows = rows.withColumn("home", F.pmod(F.xxhash64("id"), F.when(F.col("main"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    cell = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    home, every = F.col("home"), F.lit(-1)
    among = F.transform(upto("outer"), lambda j: cell(1, F.least(home, j), F.greatest(home, j), F.when(home == j, every).otherwise((home > j).cast("int"))))
    to_main = F.transform(upto("inner"), lambda c: cell(2, home, c, F.lit(0)))
    from_outer = F.transform(upto("outer"), lambda i: cell(2, i, home, F.lit(1)))
    cells = F.when(F.col("size") <= 2 * F.col("block"), F.array(cell(0, F.lit(0), F.lit(0), every))).when(F.col("main"), from_outer).otherwise(F.concat(among, to_main))
    return rows.select("key", F.col("id").alias("sid"), "comp", F.explode(cells).alias("c")).select(F.xxhash64("key", "c.kind", "c.x", "c.y").alias("cell"), "sid", "comp", F.col("c.side").alias("side"))


def _by_cell(members: DataFrame, held: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows (cell, sid, comp, side, and the columns of ``held``) of each cell, a cell at a time; it gives a list of rows of ``schema``."""
    n_parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        group, found = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:
                        found += work(*map(list, zip(*group)))
                    group = []
                group.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names)
                found = []
        if len(group) > 1 and (found := work(*map(list, zip(*group)))):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names)

    rows = members.join(held, "sid").select("cell", "sid", "comp", "side", *held.columns[1:])
    return rows.repartition(n_parts, "cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def _stacked(bits: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, folded onto the smallest."""
    raw = [np.frombuffer(x, np.uint8) for x in bits]
    width = min(map(len, raw))
    return np.stack([np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in raw]).view(np.uint64)


def _distances(i: int, others: np.ndarray, n: np.ndarray, side: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Hamming distance over total size of document ``i`` and ``others``, infinite where the sizes, sides or sketches exclude a link."""
    total = n[others] + n[i]
    far = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
    ok = (far <= _differ(total)) & (DEN * np.minimum(n[others], n[i]) >= NUM * np.maximum(n[others], n[i])) & ((side[others] != side[i]) | (side[i] < 0))
    return np.where(ok, far / total, np.inf)


#: Documents up to which a cell's sketches are compared as whole numbers, one pair at a time.
FEW = 12


def _near_pairs(comp, side, n, bits):
    """(i, j, Hamming distance over total size) of a small cell's pairs of different components which may link."""
    whole = [int.from_bytes(x) for x in bits]
    for i in range(len(n) - 1):
        for j in range(i + 1, len(n)):
            if comp[i] != comp[j] and (side[i] != side[j] or side[i] < 0) and DEN * min(n[i], n[j]) >= NUM * max(n[i], n[j]):
                far = (whole[i] ^ whole[j]).bit_count() if len(bits[i]) == len(bits[j]) else hamming(bits[i], bits[j])
                if far <= _differ(n[i] + n[j]):
                    yield i, j, far / (n[i] + n[j])


def _forest(cell, sid, comp, side, n, bits):
    """The nearest pairs by sketch that span all pairs of different components which may link: fewer than the cell's documents."""
    sid, comp, side, n, bits = np.array(sid), np.array(comp), np.array(side), np.array(n), _stacked(bits)
    near, via = np.full(len(sid), np.inf), np.zeros(len(sid), np.int64)
    rest, i, found = np.arange(1, len(sid)), 0, []
    while len(rest):  # grows one tree after the other by its nearest document; documents of one component cling together for nothing
        weight = np.where(comp[rest] == comp[i], -1.0, _distances(i, rest, n, side, bits))
        closer = weight < near[rest]
        near[rest[closer]], via[rest[closer]] = weight[closer], i
        at = int(np.argmin(near[rest]))
        i = rest[at]
        if 0 <= near[i] < np.inf:
            a, b = int(sid[i]), int(sid[via[i]])
            found.append((min(a, b), max(a, b)))
        rest = np.delete(rest, at)
    return found


def _suspects(cell, sid, comp, side, n, bits):
    """The documents that may link, by sketch, with one of another component."""
    if len(sid) <= FEW:
        hit = {k for i, j, _ in _near_pairs(comp, side, n, bits) for k in (i, j)}
        return [(cell[k], sid[k], comp[k], side[k]) for k in hit]
    c, s, m, x = np.array(comp), np.array(side), np.array(n), _stacked(bits)
    hit = np.zeros(len(sid), bool)
    for i in range(len(sid) - 1):
        others = np.arange(i + 1, len(sid))
        found = others[(c[others] != c[i]) & np.isfinite(_distances(i, others, m, s, x))]
        hit[found] = True
        hit[i] |= len(found) > 0
    return [(cell[k], sid[k], comp[k], side[k]) for k in np.flatnonzero(hit)]


def _spanning(cell, sid, comp, side, n, bits, tokens):
    """Pairs that are as similar as asked and span all such pairs of different components in the cell; the nearest by sketch are tested first."""
    tried: list = []
    if len(sid) <= FEW:
        tried = [(v, i, j) for i, j, v in _near_pairs(comp, side, n, bits)]
    else:
        s, m, x = np.array(side), np.array(n), _stacked(bits)
        for i in range(len(sid) - 1):
            others = np.arange(i + 1, len(sid))
            w = _distances(i, others, m, s, x)
            tried += [(v, i, j) for v, j in zip(w.tolist(), others.tolist()) if v < np.inf and comp[i] != comp[j]]
    above: dict = {}

    def top(c):
        while c in above:
            c = above[c]
        return c

    found = []
    for _, i, j in sorted(tried):
        a, b = top(comp[i]), top(comp[j])
        if a != b and similar(tokens[i], tokens[j]):
            above[a] = b
            found.append((min(sid[i], sid[j]), max(sid[i], sid[j])))
    return found


def links(docs: DataFrame, signs: DataFrame, doc_id: str, text: str, hot: int = 64, block: int = 512, crowd: int = 8) -> DataFrame | None:
    """(id, comp) of every class representative that links with another one; None if none does. ``signs`` are those of _classes.

    First, the documents of each key of more than ``crowd`` meet in cells of ``block`` at most, and each cell offers the pairs that span its
    candidates, nearest first: a group of thousands of like texts becomes one component for about a test a document. Then every two
    documents of different components that share a key meet in a cell; those that may link by sketch are tested there by their sets, and
    a spanning forest of true links leaves the cell. So no pair that could join two components goes untested, however the first part went,
    and no step puts out more rows than documents entered its cells.
    """
    rows = _candidates(docs, signs, doc_id, text, hot)
    sketches = signs.filter("id = rep").select(F.col("id").alias("sid"), "n", "bits")
    found = comp = None

    def link(new):
        nonlocal found, comp
        new = written(new, "links")
        if new.limit(1).count():
            found = new if found is None else written(found.unionByName(new), "links")
            comp = components(found)

    crowded = _open_keys(rows, None)
    start = _sampled_cells(crowded.filter(F.col("size") > crowd), block)
    offers = written(_by_cell(start, sketches, _forest, "a long, b long").distinct(), "offers")
    link(_verified(offers, token_sets(docs, offers.select("a").union(offers.select("b")), doc_id, text)))
    still = _open_keys(rows, comp)
    free(crowded, rows)
    met = _all_cells(still, block)
    suspects = written(_by_cell(met, sketches, _suspects, "cell long, sid long, comp long, side long"), "suspects")
    free(still)
    held = sketches.join(token_sets(docs, suspects.select("sid"), doc_id, text), "sid")
    link(_by_cell(suspects, held, _spanning, "a long, b long").distinct())
    return comp


def _classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The signatures with ``rep``, the smallest id of an equal set."""
    signs = written(signatures(docs, doc_id, text), "signs")
    classes = signs.filter("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    same = [F.col(c) == F.col(f"_{c}") for c in ("n", "h1", "h2")]
    classes = written(classes.select(*[F.col(c).alias(f"_{c}") for c in ("n", "h1", "h2")], "rep"), "classes")
    return written(signs.join(classes, same, "left").drop("_n", "_h1", "_h2").withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id"))), "signs")


def _linked(n: np.ndarray, side: np.ndarray, bits: np.ndarray, tokens: list[bytes]) -> np.ndarray:
    """Which documents of a cell link (upper triangle). Sizes of intersections come from products of 0/1 matrices over the tokens of two documents or more."""
    ok = np.zeros((len(n), len(n)), bool)
    for i in range(len(n) - 1):
        ok[i, i + 1 :] = np.isfinite(_distances(i, np.arange(i + 1, len(n)), n, side, bits))
    if not ok.any():
        return ok
    own = [np.frombuffer(t, np.uint64) for t in tokens]
    _, token, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[token]
    doc = np.repeat(np.arange(len(own)), [len(t) for t in own])[place >= 0]
    place = place[place >= 0]
    order = np.argsort(place, kind="stable")
    doc, place = doc[order], place[order]
    inter = np.zeros(ok.shape, np.int64)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        a, b = np.searchsorted(place, [low, low + 4096])
        has = np.zeros((len(own), 4096), np.float32)
        has[doc[a:b], place[a:b] - low] = 1
        inter += (has @ has.T).astype(np.int64)
    return ok & (DEN * inter >= NUM * (n[:, None] + n[None, :] - inter))


def _pairs(cell, sid, size, side, n, bits, tokens):
    hit = np.argwhere(_linked(np.array(n), np.array(side), _stacked(bits), tokens))
    return [(min(sid[i], sid[j]), max(sid[i], sid[j])) for i, j in hit.tolist()]


def _counts(cell, sid, size, side, n, bits, tokens):
    ok = _linked(np.array(n), np.array(side), _stacked(bits), tokens)
    more = (ok | ok.T) @ np.array(size, np.int64)
    return [(sid[k], int(more[k])) for k in np.flatnonzero(more)]


def _within(comp: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """(cell, sid, comp, side) in which any two documents of a component meet once; ``comp`` holds the size of the document's class."""
    many = written(comp.groupBy(F.col("comp").alias("_c")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "blocks")
    rows = comp.join(many, F.col("comp") == F.col("_c")).join(sizes, F.col("id") == F.col("_r")).withColumn("home", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    side = lambda j: F.when(F.col("home") == j, F.lit(-1)).otherwise((F.col("home") > j).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("home", j).alias("x"), F.greatest("home", j).alias("y"), side(j).alias("side")))
    rows = rows.select("comp", F.col("id").alias("sid"), "_size", F.explode(met).alias("c"))
    return rows.select(F.xxhash64("comp", "c.x", "c.y").alias("cell"), "sid", F.col("_size").alias("comp"), F.col("c.side").alias("side"))


def _held(docs: DataFrame, signs: DataFrame, comp: DataFrame, doc_id: str, text: str) -> DataFrame:
    sketches = signs.filter("id = rep").select(F.col("id").alias("sid"), "n", "bits")
    return sketches.join(token_sets(docs, comp.select("id"), doc_id, text), "sid")


def _class_sizes(signs: DataFrame) -> DataFrame:
    some = signs.filter("n > 0 and id is not null")
    return written(some.select("id", "rep").distinct().groupBy(F.col("rep").alias("_r")).agg(F.count(F.lit(1)).alias("_size")), "sizes")


def pairs(docs: DataFrame, signs: DataFrame, doc_id: str, text: str, hot: int = 64, block: int = 512) -> DataFrame:
    """(a, b), a < b: every two class representatives whose sets are as similar as asked, also within one component."""
    comp = links(docs, signs, doc_id, text, hot, block)
    if comp is None:
        return docs.sparkSession.createDataFrame([], "a long, b long")
    return _by_cell(_within(comp, _class_sizes(signs), block), _held(docs, signs, comp, doc_id, text), _pairs, "a long, b long")


def near_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = 512) -> DataFrame:
    """Every row of ``docs`` (its id) with ``n_shingles``, ``component_id`` and ``n_links``, the number of other documents that link with it.

    The links are those of near_duplicates, all of them: a document links with the others of its class (equal sets) and with
    every document of the classes whose representatives pair with its own. Blocks of a component's representatives meet two by two and
    each meeting puts out a count a document, not pairs. Ids are taken to be of one text each.
    """
    signs = _classes(docs, doc_id, text)
    size = _class_sizes(signs)
    comp = links(docs, signs.filter("n > 0"), doc_id, text, block=block)
    total = size.withColumn("_more", F.lit(0).cast("long")).withColumn("_comp", F.col("_r"))
    if comp is not None:
        more = _by_cell(_within(comp, size, block), _held(docs, signs, comp, doc_id, text), _counts, "a long, m long").groupBy(F.col("a").alias("_a")).agg(F.sum("m").alias("_more"))
        total = size.join(more, F.col("_r") == F.col("_a"), "left").join(comp.select(F.col("id").alias("_i"), F.col("comp").alias("_comp")), F.col("_r") == F.col("_i"), "left")
    total = total.select("_r", F.coalesce("_comp", "_r").alias("_comp"), (F.col("_size") - 1 + F.coalesce("_more", F.lit(0))).alias("_links"))
    out = signs.join(total, (F.col("rep") == F.col("_r")) & (F.col("n") > 0), "left")
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("_comp", "id").alias("component_id"), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` (its id, no other column) with ``n_shingles`` and ``component_id``. The links themselves are in ``pairs`` and ``near_links``.

    Documents link where their sets of 5-word shingles are at least 4/5 similar; ``component_id`` is the smallest id reachable.
    Null, empty and wordless texts have no shingles and link with nothing; a null id links with nothing and is its own (null) component.
    Rows that share an id count as one document; equal texts are one class and compared once.
    """
    docs = docs.drop("n_shingles", "component_id")
    signs = _classes(docs, doc_id, text)
    comp = links(docs, signs.filter("n > 0"), doc_id, text)
    whole = signs if comp is None else signs.join(comp.select(F.col("id").alias("_r"), "comp"), F.col("rep") == F.col("_r"), "left")
    whole = whole.withColumn("comp", F.coalesce("comp", "rep") if comp is not None else F.col("rep"))
    return whole.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
