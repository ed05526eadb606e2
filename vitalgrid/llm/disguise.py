"""Letters as a reader takes them: disguised words (digits for letters, dots or spaces between, marks, look-alikes, repeats) and short stretches of them."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

BREAK, LETTER, DIGIT, SYMBOL, JOINER, MASK, HIDDEN = range(7)
_LOOKS = dict(zip("авекмнорстухіјѕёԁαορντικευχß" + "æøłıđ", "abekmhopctyxijsedaopvtikeuxs" + "aolid"))
_DIGITS = dict(zip("01345789", "oieastbg"))
_SYMBOLS = dict(zip("@$!|€", "asiie"))
_TOP = 1 << 17
#: Codes of stretches: five bits a letter, so four letters are 20 bits.
BITS = 20


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(code, kind) of every code point below 2^17: a-z are 1 to 26, other letters 27 to 31."""
    code, kind = np.zeros(_TOP, np.uint8), np.zeros(_TOP, np.uint8)
    for cp in range(_TOP):
        char = chr(cp)
        group = unicodedata.category(char)
        base = unicodedata.normalize("NFKD", char)[:1].lower()
        base = _LOOKS.get(base, base)
        if group[0] == "L":
            kind[cp], code[cp] = LETTER, ord(base) - 96 if "a" <= base <= "z" else 27 + cp % 5
        elif base in _DIGITS:
            kind[cp], code[cp] = DIGIT, ord(_DIGITS[base]) - 96
        elif base in _SYMBOLS:
            kind[cp], code[cp] = SYMBOL, ord(_SYMBOLS[base]) - 96
        elif char in ".-_'’·~/:,":
            kind[cp] = JOINER
        elif char in "*#%?&":
            kind[cp] = MASK
        elif group in ("Mn", "Cf"):
            kind[cp] = HIDDEN
    return code, kind


def _points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the places of their first bytes; those from 2^17 on count as 0."""
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[at].astype(np.uint32)
    if len(at) == len(raw):
        return lead, at
    more = np.concatenate([raw, np.zeros(3, np.uint8)])
    for low, high, size, bits in ((0xC0, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, 0x100, 4, 0x07)):
        own = np.flatnonzero((raw[at] >= low) & (raw[at] < high))
        if len(own):
            point = raw[at[own]].astype(np.uint32) & bits
            for k in range(1, size):
                point = (point << 6) | (more[at[own] + k] & 0x3F)
            lead[own] = point
    return np.where(lead < _TOP, lead, 0), at


def _before(x: np.ndarray, n: int = 1) -> np.ndarray:
    return np.concatenate([np.zeros(n, x.dtype), x[:-n]])


def _after(x: np.ndarray, n: int = 1) -> np.ndarray:
    return np.concatenate([x[n:], np.zeros(n, x.dtype)])


def letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, is a letter, document) of what a reader sees, with breaks between words and around documents.

    Case and accents go, look-alikes and digits or symbols beside letters become letters, single marks between letters and spaces between three
    or more single letters go, a lone ``*`` or the like between letters is the unknown letter 0, repeated letters are one.
    """
    codes, kinds = _tables()
    points, at = _points(raw)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(np.searchsorted(at, offsets)))
    shown = kinds[points] != HIDDEN
    if not shown.all():
        points, doc = points[shown], doc[shown]
    place = np.arange(len(points)) + doc + 2
    size = len(points) + len(offsets) + 3
    code, kind, own, edge = np.zeros(size, np.uint8), np.zeros(size, np.uint8), np.zeros(size, np.int32), np.ones(size, bool)
    code[place], kind[place], own[place], edge[place] = codes[points], kinds[points], doc, False
    letter, digit, symbol = kind == LETTER, kind == DIGIT, kind == SYMBOL
    for _ in range(3):
        letter = letter | digit & (_before(letter) | _after(letter)) | symbol & _after(letter)
    between = _before(letter) & _after(letter)
    mask = kind == MASK
    apart = mask & (_before(mask, 2) | _after(mask, 2))
    gone = between & ((kind == JOINER) | apart)
    letter |= between & mask & ~apart
    if gone.any():
        code, letter, own, edge = code[~gone], letter[~gone], own[~gone], edge[~gone]
    alone = letter & ~_before(letter) & ~_after(letter)
    gap = _before(alone) & _after(alone) & ~edge
    gap &= _before(gap, 2) | _after(gap, 2)
    again = letter & _before(letter) & (code == _before(code)) & (code > 0)
    kept = ~(gap | again)
    code, letter, own = code[kept], letter[kept], own[kept]
    if gap.any():  # letters that the gaps kept apart
        kept = ~(letter & _before(letter) & (code == _before(code)) & (code > 0))
        code, letter, own = code[kept], letter[kept], own[kept]
    return code, letter, own


def stretches(raw: np.ndarray, offsets: np.ndarray, used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of the stretches of three and four letters and of four with an unknown letter in second or third place, repeats included;
    with ``used`` (a boolean a code) only those.
    """
    code, letter, own = letters(raw, offsets)
    if len(code) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = code.astype(np.int32)
    three = letter[:-2] & letter[1:-1] & letter[2:]
    four = three[:-1] & letter[3:]
    low = (c[:-2] << 10) | (c[1:-1] << 5) | c[2:]
    high = (low[:-1] << 5) | c[3:]
    docs, found = [], []
    for ok, x in ((three, low), (four, high), (four, high & ~(31 << 10)), (four, high & ~(31 << 5))):
        at = np.flatnonzero(ok if used is None else ok & used[x])
        docs.append(own[at])
        found.append(x[at])
    return np.concatenate(docs).astype(np.int64), np.concatenate(found).astype(np.int64)
