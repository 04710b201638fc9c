"""Words as byte ranges and 64-bit hashes, many texts at a time.

A word is a run of ASCII letters and digits and of bytes of non-ASCII
characters, in lower case.  Everything is array arithmetic over UTF-8 bytes.
``word_hashes`` goes by code points instead: words are runs of letters, marks
and digits of any script, and single characters in scripts without blanks.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

SLICE = 250_000
_IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
IN_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
_PRIME = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_GAP = re.compile(r"[ \n\t.,;]")
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; numerals of any kind are none."""
    return bool(text) and any(m.group().isalpha() for m in _LETTER.finditer(text))


_tables: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd constant and of its inverse, modulo 2**64, to the n-th at least; one table a worker, which grows."""
    if not _tables or len(_tables[0]) <= n:
        _tables.clear()
        for base in (_PRIME, pow(_PRIME, -1, 1 << 64)):
            p = np.full((1 << max(19, n.bit_length())) + 1, base, dtype=np.uint64)
            p[0] = 1
            _tables.append(np.cumprod(p, dtype=np.uint64))
    return _tables[0], _tables[1]


def mixed(keys: np.ndarray) -> np.ndarray:
    keys = (keys ^ (keys >> np.uint64(31))) * _MIX
    return keys ^ (keys >> np.uint64(29))


def parts(text: str):
    """A text in parts of bounded size, cut between words where there is a gap."""
    at = 0
    while len(text) - at > 2 * SLICE:
        cut = _GAP.search(text, at + SLICE)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def slices(texts: list[str | None]):
    """Groups of (text number, part), each of bounded size; every text occurs."""
    group: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for part in parts(text or ""):
            group.append((i, part))
            size += len(part)
            if size >= SLICE:
                yield group
                group, size = [], 0
    if group:
        yield group


def split(group: list[tuple[int, str]]):
    """(bytes, starts, ends, text number of each word) of one group."""
    coded = [p.lower().encode("utf-8", "replace") for _, p in group]
    raw = np.frombuffer(b"\n" + b"\n".join(coded) + b"\n", dtype=np.uint8)
    inside = _IN_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([len(c) + 1 for c in coded])
    which = np.array([i for i, _ in group])[np.searchsorted(bounds, starts, side="left")] if len(starts) else np.zeros(0, np.int64)
    return raw, starts, ends, which


OUT, WORD, SINGLE, MARK = range(4)
#: Blocks of scripts written without blanks (fixed by Unicode): Thai and Lao, Myanmar, Khmer, kana and bopomofo, Han, and their extensions.
_UNSPACED = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x303B), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = {"L": WORD, "N": WORD, "M": MARK}
    table = np.array([kind.get(unicodedata.category(chr(c))[0], OUT) for c in range(0x110000)], dtype=np.uint8)
    for a, b in _UNSPACED:
        table[a : b + 1][table[a : b + 1] == WORD] = SINGLE
    return table


def split_characters(group: list[tuple[int, str]]):
    """``split`` by code points; marks go with what they follow."""
    if all(p.isascii() for _, p in group):
        return split(group)
    coded = [p.lower().encode("utf-8", "replace") for _, p in group]
    joined = b"\n" + b"\n".join(coded) + b"\n"
    raw = np.frombuffer(joined, dtype=np.uint8)
    kind = _classes()[np.frombuffer(joined.decode().encode("utf-32-le"), dtype="<u4")]
    # A mark has the kind of the last character that is none.
    base = kind[np.maximum.accumulate(np.where(kind != MARK, np.arange(len(kind)), 0))]
    inside = (kind != OUT).copy()
    begins = inside.copy()
    begins[1:] &= (kind[1:] == SINGLE) | ~inside[:-1] | ((kind[1:] == WORD) & (base[:-1] == SINGLE))
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | begins[1:]
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    starts, ends = at[np.flatnonzero(begins)], at[np.flatnonzero(closes) + 1]
    bounds = np.cumsum([len(c) + 1 for c in coded])
    which = np.array([i for i, _ in group])[np.searchsorted(bounds, starts, side="left")] if len(starts) else np.zeros(0, np.int64)
    return raw, starts, ends, which


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    n = len(raw)
    power, inverse = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw + np.uint64(1)) * power[:n], out=sums[1:], dtype=np.uint64)
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def word_hashes(texts: list[str | None]):
    """Yield the word hashes of each text, in order."""
    waiting: list[np.ndarray] = []
    current = 0
    for group in slices(texts):
        raw, starts, ends, which = split_characters(group)
        keys = hashes(raw, starts, ends)
        first, last = group[0][0], group[-1][0]
        cuts = np.searchsorted(which, np.arange(first, last + 2))
        for i in range(first, last + 1):
            if i != current:
                yield waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
                waiting, current = [], i
            waiting.append(keys[cuts[i - first] : cuts[i - first + 1]])
    if waiting:
        yield waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
