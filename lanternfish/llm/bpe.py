"""Byte-level BPE over batches of texts, with the split into words vectorised.

A tokenizer file's vocabulary is read once on the driver and sent out (a fixed
size).  Texts are cut into words by array operations over code points under the
usual byte-level rule; each distinct word is merged once and kept in a bounded
table.  Words are told apart by a 64-bit hash of their code points.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections import deque
from functools import lru_cache

import numpy as np

from lanternfish.llm.words import powers

#: Fixed by Unicode: the code points with property White_Space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)
_SAFE_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85\xa0])[ \n]")
_SLICE = 250_000
_KEEP = 200_000
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], dtype=np.uint8)
    table[SPACES] = SPACE
    return table


def word_starts(cps: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Positions where a word starts; ``doc_starts`` are those of non-empty texts."""
    n = len(cps)
    kind = _classes()[cps]
    new_doc = np.zeros(n + 1, dtype=bool)
    new_doc[doc_starts] = True
    new_doc[n] = True
    change = new_doc[:n].copy()
    change[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n)
    what = kind[starts]
    first = change.copy()
    inner = (what == SPACE) & ~new_doc[ends]
    first[ends[inner] - 1] = True
    joined = ends[inner][cps[ends[inner] - 1] == 0x20]
    first[joined] = False
    quotes = starts[(what == OTHER) & (ends - starts == 1) & (cps[starts] == 0x27) & first[starts] & ~new_doc[ends]]
    if len(quotes):
        tail = np.zeros(len(quotes), dtype=np.int64)
        a = cps[quotes + 1]
        tail[np.isin(a, [ord(x) for x in "stmd"])] = 1
        two = quotes + 2 < n
        two[two] = ~new_doc[quotes[two] + 2]
        b = np.where(two, cps[np.minimum(quotes + 2, n - 1)], 0)
        for x, y in ("re", "ve", "ll"):
            tail[(a == ord(x)) & (b == ord(y))] = 2
        quotes, tail = quotes[tail > 0], tail[tail > 0]
        first[quotes + 1] = False
        after = quotes + 1 + tail
        first[after[after < n]] = True
    return np.flatnonzero(first)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, back to bytes."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_ranks(path: str) -> dict[bytes, int]:
    """Vocabulary of a byte-level tokenizer file whose ids follow merge order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError("a plain byte-level tokenizer is needed")
    model, back = spec["model"], _byte_of()
    vocab = model["vocab"]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])):
        raise ValueError("ids must follow the order of the merges")
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}


def load_added(path: str) -> dict[str, int]:
    """The tokenizer file's added tokens, which a text is split at first."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that look at their neighbours are not supported")
    return {t["content"]: t["id"] for t in added}


class Encoder:
    """Ids of whole texts.  Strings of ``added`` tokens get their ids; without them they are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], added: dict[str, int] | None = None):
        from tiktoken import _tiktoken

        self._added = added or {}
        # Of tokens that start at one place the longest is taken.
        self._at_added = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if added else None

        self._core = _tiktoken.CoreBPE(ranks, {}, r"[\s\S]")
        self._known: dict[int, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array("I", self._core.encode_single_piece(text.encode())).tobytes()

    def encode(self, texts: list[str]):
        """Yield one uint32 array for each text, in order."""
        if not self._at_added:
            yield from self._encode(texts)
            return
        tokens: deque[list[str]] = deque()

        def sections():
            for text in texts:
                parts = self._at_added.split(text)
                tokens.append(parts[1::2])
                yield from parts[::2]

        ids = self._encode(sections())
        for first in ids:
            out = [first]
            for token in tokens.popleft():
                out += [np.array([self._added[token]], dtype=np.uint32), next(ids)]
            yield np.concatenate(out) if len(out) > 1 else first

    def _encode(self, texts):
        pending: list[str] = []
        size = 0
        for text in texts:
            if len(text) > 2 * _SLICE:
                if pending:
                    yield from self._slice(pending)
                    pending, size = [], 0
                yield np.concatenate([x for part in self._parts(text) for x in self._slice([part])])
                continue
            pending.append(text)
            size += len(text)
            if size >= _SLICE:
                yield from self._slice(pending)
                pending, size = [], 0
        if pending:
            yield from self._slice(pending)

    @staticmethod
    def _parts(text: str):
        """Cut a long text where a blank follows a non-blank, which always ends a word."""
        at = 0
        while len(text) - at > 2 * _SLICE:
            cut = _SAFE_CUT.search(text, at + _SLICE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def _slice(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if not joined:
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        cps = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        starts = word_starts(cps, bounds[:-1][sizes > 0])
        n = len(cps)
        ends = np.append(starts[1:], n)
        power, inverse = powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((cps + np.uint64(1)) * power[:n], out=sums[1:], dtype=np.uint64)
        keys = (sums[ends] - sums[starts]) * inverse[starts]
        keys ^= keys >> np.uint64(32)
        keys *= _MIX
        distinct, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self._known) > _KEEP:
            self._known.clear()
        known, found = self._known, []
        for key, s, e in zip(distinct.tolist(), starts[where].tolist(), ends[where].tolist()):
            ids = known.get(key)
            if ids is None:
                ids = known[key] = self._ids(joined[s:e])
            found.append(ids)
        flat = np.frombuffer(b"".join(found), dtype=np.uint32)
        lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        offsets = np.cumsum(lengths) - lengths
        each = lengths[which]
        before = np.cumsum(each) - each
        ids = flat[np.repeat(offsets[which] - before, each) + np.arange(int(each.sum()))]
        total = np.append(before, len(ids))
        return [ids[a:b] for a, b in zip(*(total[np.searchsorted(starts, x)] for x in (bounds[:-1], bounds[1:])))]
