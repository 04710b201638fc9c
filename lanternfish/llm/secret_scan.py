"""Secrets in text: known patterns, and strings that a tokenizer finds random.

A vocabulary learned from text spells words and names with few tokens but has
to spell random strings nearly letter by letter.  Long unbroken strings with
few characters a token are reported as ``random``, unless they are digests or
UUIDs; words joined to them, such as the name before a value, are left out.
Pattern findings are always reported.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEXADECIMAL = re.compile(r"(0x)?[0-9A-Fa-f]+")
_DIGEST_SIZES = {32, 40, 48, 56, 64, 96, 128}
_SIGNS = "=-_/+"
#: UUIDs stay whole; all else is cut at signs.
_PIECE = re.compile(rf"(?<![A-Za-z0-9]){_UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9]+")
_WORD = re.compile(r"[A-Z]?[a-z]{3,}")

Span = tuple[int, int, int]


def load_encoding(ranks_path: str):
    """A tiktoken encoding from a file of base64 tokens and ranks."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return ranks, lambda r: tiktoken.Encoding("secret-scan", pat_str=r"\S+|\s+", mergeable_ranks=r, special_tokens={})


def is_known(run: str) -> bool:
    """Digests and UUIDs: long strings that are no secrets."""
    bare = run.removeprefix("0x")
    return bool(_HEXADECIMAL.fullmatch(run) and len(bare) in _DIGEST_SIZES or _UUID.fullmatch(run))


def random_parts(run: str, count_tokens, max_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run of letters, digits and signs."""

    def is_random(a: int, b: int) -> bool:
        return b - a >= 20 and b - a <= max_ratio * count_tokens(run[a:b])

    def is_word(a: int, b: int) -> bool:
        return b - a >= 4 and b - a > max_ratio * count_tokens(run[a:b])

    def of(a: int, b: int) -> list[tuple[int, int]]:
        """Random stretches between known pieces; words at their ends are left out where enough stays."""
        stretches: list[list[tuple[int, int, bool]]] = [[]]
        for m in _PIECE.finditer(run, a, b):
            if is_known(m[0]):
                stretches.append([])
            else:
                stretches[-1].append((*m.span(), is_word(*m.span())))
        out = []
        for pieces in filter(None, stretches):
            plain = [i for i, x in enumerate(pieces) if not x[2]]
            inner = (pieces[plain[0]][0], pieces[plain[-1]][1]) if plain else None
            # The name may have a part too short to judge, as in sk_live_...: it goes with the word after it.
            lead = 0
            for i, (s, e, word) in enumerate(pieces):
                if word:
                    lead = i + 1
                elif e - s >= 4:
                    break
            after = (pieces[lead][0], pieces[plain[-1]][1]) if plain and lead <= plain[-1] else None
            whole = (pieces[0][0], pieces[-1][1])
            if is_random(*whole):
                out.append(next((x for x in (after, inner) if x and is_random(*x)), whole))
                continue
            group: list[tuple[int, int, bool]] = []
            for x in [*pieces, (b, b, True)]:
                if not x[2]:
                    group.append(x)
                elif group:
                    if is_random(group[0][0], group[-1][1]):
                        out.append((group[0][0], group[-1][1]))
                    group = []
                if x[2]:
                    # Words may stand before a random rest without a sign between.
                    at, end = x[0], x[1]
                    while (m := _WORD.match(run, at, end)) and is_word(*m.span()):
                        at = m.end()
                    if at > x[0] and is_random(at, end):
                        out.append((at, end))
        return out

    found, at = [], 0
    for part in run.split("="):
        if len(part) >= 20:
            found += of(at, at + len(part))
        at += len(part) + 1
    return found or ("=" in run.strip(_SIGNS) and of(0, len(run))) or []


def find_spans(text: str, count_tokens, max_ratio: float) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start and kind; ends are exclusive, in code points."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    runs = [m.span() for m in _RUN.finditer(text)]
    if any(b - a >= 32 for a, b in runs):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    # Of the pattern spans by start, the furthest end so far: a span is met by one of those that start before its end.
    starts = sorted(x for x, _, _ in found)
    furthest = list(accumulate((y for _, _, y in sorted(found)), max))
    for a, b in runs:
        for s, e in random_parts(text[a:b], count_tokens, max_ratio):
            before = bisect_left(starts, a + e)
            if not before or furthest[before - 1] <= a + s:
                found.append((a + s, 3, a + e))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def _scan(batches, ranks, make, max_ratio: float):
    encoding = make(ranks)
    count = lambda s: len(encoding.encode_ordinary(s))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = [
            [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t or "", count, max_ratio)]
            for t in batch.column(1).to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])


def scan(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = 2.0) -> DataFrame:
    """One row per input row: doc_id, spans array<struct<kind, start, end>>.

    A null text counts as empty; texts without findings have an empty array.
    Repeated rows and null ids each give their row.  Spans are sorted by start,
    then by kind as listed in ``KINDS``; ``random`` spans never overlap pattern
    spans.  Whole texts are read, however long.  An empty table gives an empty
    result; other columns are ignored.
    """
    ranks, make = load_encoding(ranks_path)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(lambda it: _scan(it, sent.value, make, max_ratio), "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each stretch of findings replaced by ``[SECRET]``."""
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _redact(batches, position: int, ranks, make, max_ratio: float):
    encoding = make(ranks)
    count = lambda s: len(encoding.encode_ordinary(s))
    for batch in batches:
        texts = [t and masked(t, find_spans(t, count, max_ratio)) for t in batch.column(position).to_pylist()]
        columns = [*batch.columns]
        columns[position] = pa.array(texts, pa.string())
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)


def redact(docs: DataFrame, ranks_path: str, text_col: str = "text", max_ratio: float = 2.0) -> DataFrame:
    """``docs`` with secrets in the text masked; all rows and columns stay.

    Findings that overlap or touch in their order become one mask.  Null and
    empty texts and texts without findings come back as they are; whole texts
    are read, however long.  Repeated rows are masked alike; other columns,
    null or not and of any names, pass through.  An empty table stays empty.
    """
    ranks, make = load_encoding(ranks_path)
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    position = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _redact(it, position, sent.value, make, max_ratio), docs.schema)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
