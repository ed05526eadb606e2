"""Encoding and decoding with a merge-type (BPE) SentencePiece model, without its library.

A sequence of pieces is what the merges make of a text exactly when every two neighbours are what the merges make of their joined
string: as long as no merge has crossed a boundary, the best pair within two neighbours is picked in the order in which it is
picked on its own, so the first merge to cross a boundary in the whole text would cross it in the two neighbours alone. The encoder
therefore walks a text once: at each place it takes the longest piece (found for all places by one Aho-Corasick pass), else the next
shorter one, that goes with the piece before it, and steps back where none does. A place from which no way leads on is marked
and never tried again; that is right for whatever leads there, since a text up to a place has one encoding only.

No piece of such a model has a space sign after another character, so a text is cut before each run of spaces, and at characters
that are in no piece; short stretches are remembered with their ids.
"""

from __future__ import annotations

import array
import codecs
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalgrid.llm.common import chunks, shielded

SPACE = "▁"
#: Bounds of what a worker remembers: stretches of at most so many characters, so many of them, and so many pairs of pieces.
LONGEST, STRETCHES, PAIRS = 48, 400_000, 300_000
# Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

codecs.register_error("vitalgrid.byte", lambda e: ("�", e.start + 1))


class Codec(dict):
    """The pieces of a model (the bytes of its file). As a dict it maps a stretch of text to its ids, as bytes of 32-bit numbers."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        norm, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE} or sum(p.type == BYTE for p in proto.pieces) != 256:
            raise ValueError("a merge-type model with byte fallback and without user-defined pieces is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a model that leaves texts as they are (identity normalization, spaces kept) is needed")
        self.scores = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.letters = {c for p in self.scores for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.scores) or not self.letters <= self.scores.keys():
            raise ValueError("pieces with inner spaces, or of characters that are no pieces, are not handled")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.end = next(i for i, p in enumerate(proto.pieces) if p.piece == proto.trainer_spec.eos_piece)
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        gaps = "".join(re.escape(c) for c in "\n\t\r" if c not in self.letters)
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}{gaps}]+|{SPACE}+|[{gaps}]" if gaps else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pieces = [p.piece for p in proto.pieces]
        self.size = len(self.pieces)
        self.pairs: dict[int, bool] = {}
        self.auto = ahocorasick.Automaton()
        whole = {p: i for p, (_, i) in self.scores.items() if self.merged(p) == [p]}  # others come out of no text
        for p, i in whole.items():
            self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()
        self.shorter = [-1] * self.size  # the longest piece that starts a piece
        for p, i in whole.items():
            self.shorter[i] = next((whole[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in whole), -1)
        self.lengths = [len(p) for p in self.pieces]
        self.shown = [
            b"" if p.type == CONTROL else bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE
            else proto.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode() for p in proto.pieces
        ]
        self.silent = np.array([p.type == CONTROL for p in proto.pieces])
        self.spaced = np.array([p.type == NORMAL and p.piece.startswith(SPACE) for p in proto.pieces])

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short string: the best pair first, of equals the leftmost."""
        parts, none = list(text), (float("inf"), -1)
        while len(parts) > 1:
            rank, k = min((self.scores.get(parts[k] + parts[k + 1], none)[0], k) for k in range(len(parts) - 1))
            if rank == none[0]:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def together(self, a: int, b: int) -> bool:
        key = a * self.size + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self.merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        return found

    def walk(self, text: str) -> list[int]:
        """Ids of a stretch whose characters are all in pieces."""
        n = len(text)
        longest = [-1] * n
        for at, (piece, k) in self.auto.iter(text):
            longest[at + 1 - k] = piece  # ends ascend, so the last one is the longest
        dead = bytearray(n + 1)
        lengths, shorter, size, pairs = self.lengths, self.shorter, self.size, self.pairs.get
        out: list[int] = []
        at, piece, last = 0, longest[0], -1
        while True:
            while piece >= 0:
                to = at + lengths[piece]
                if not dead[to]:
                    if last < 0:
                        break
                    fits = pairs(last * size + piece)
                    if self.together(last, piece) if fits is None else fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                if to == n:
                    return out
                at, last = to, piece
                piece = longest[at]
            else:
                dead[at] = 1
                piece = out.pop()  # a text has an encoding, so the first place never fails
                at -= lengths[piece]
                last = out[-1] if out else -1
                piece = shorter[piece]

    def __missing__(self, stretch: str) -> bytes:
        if self.letters.issuperset(stretch):
            ids = self.walk(stretch)
        else:
            ids, start = [], 0
            for k, c in enumerate(stretch):
                if c not in self.letters:
                    ids += self.walk(stretch[start:k]) if start < k else []
                    ids += [self.byte[b] for b in c.encode()]
                    start = k + 1
            if start < len(stretch):
                ids += self.walk(stretch[start:])
        out = array.array("i", ids).tobytes()
        if len(stretch) <= LONGEST:
            if len(self) >= STRETCHES:
                self.clear()
            self[stretch] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as bytes of 32-bit numbers, without the end id."""
        return b"".join(map(self.__getitem__, self.stretch.findall(self.prefix + text.replace(" ", SPACE)))) if text else b""

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids. Control ids show nothing and part byte runs; a byte that starts no character is U+FFFD; the first space goes."""
        silent = self.silent[ids]
        heard = ids[~silent]
        raw = [b"".join(map(self.shown.__getitem__, run.tolist())) for run in np.split(ids, np.flatnonzero(silent))]
        text = "".join(r.decode("utf-8", "vitalgrid.byte") for r in raw)
        return text[1:] if self.prefix and len(heard) and self.spaced[heard[0]] else text


@functools.lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str) -> bytes:
    """A model file's bytes (under a megabyte or so); they travel to the tasks, which need no file of their own."""
    with open(path, "rb") as f:
        return f.read()


def _lists(parts: list[bytes]) -> pa.Array:
    cuts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=cuts[1:])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _encoded(c: Codec, values: pa.Array, end: bool) -> pa.Array:
    tail = np.array([c.end], np.int32).tobytes() if end else b""
    parts = [c.encode(t) + tail for t in values.to_pylist()]
    cuts = np.cumsum([0, *[len(p) // 4 for p in parts]])
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _decoded(c: Codec, values: pa.Array) -> pa.Array:
    lists = [v.values.drop_null().to_numpy().astype(np.int64) if v.is_valid else np.zeros(0, np.int64) for v in values]
    return pa.array([c.decode(x) for x in lists], pa.string())


def _extended(df: DataFrame, more: str, model: bytes, make, column: str | None = None) -> DataFrame:
    """``df`` with the columns ``more`` (a schema) that ``make(codec, batch)`` gives."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [more])
    added = [m.split()[0] for m in more.split(", ")]

    def run(batches):
        c = codec(shared.value)
        for b in chunks(batches, column) if column else batches:
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], *make(c, b)], [*names, *added])

    return df.mapInArrow(run, schema)


@shielded(("ids",), "text")
def encode(docs: DataFrame, model: bytes, end: bool = True, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``ids`` (array<int>): what the library's encode gives for the whole text, with the end id if ``end``.

    Null and empty texts have no ids but the end id. Rows are encoded one by one: repeated rows get equal ids, an empty table gives
    an empty one; a column named ``ids`` is replaced, any other stays, whatever its name. A text of any length takes time and
    memory linear in it. Models that rewrite texts, have pieces of other kinds or inner spaces are refused with ValueError.
    """
    return _extended(docs, "ids array<int>", model, lambda c, b: [_encoded(c, b.column(text), end)], text)


@shielded(("decoded",), "ids")
def decode(docs: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """Every row of ``docs`` with ``decoded``: the library's decode of the whole column ``ids``.

    Null and empty lists are the empty text, nulls within a list are passed over; ids that the model has not raise IndexError.
    Repeated rows, empty tables and other columns as in ``encode``.
    """
    return _extended(docs, "decoded string", model, lambda c, b: [_decoded(c, b.column(ids))])


@shielded(("ids", "decoded"), "text")
def round_trip(docs: DataFrame, model: bytes, end: bool = True, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` of its ids in one pass of one worker."""
    def make(c, b):
        ids = _encoded(c, b.column(text), end)
        return [ids, _decoded(c, ids)]

    return _extended(docs, "ids array<int>, decoded string", model, make, text)
