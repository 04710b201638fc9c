"""Packing documents into training sequences: dominance reduction, then best fit.

Documents become pieces of at most ``capacity`` tokens.  Only the histogram of
piece lengths (``capacity`` numbers, however large the corpus) is planned on the
driver.  Reduction fixes a set of up to three lengths for good where it
dominates every other set that holds the longest of them; what is left is packed
best-fit decreasing.  Equal lengths are interchangeable, so the plan is a short
list of patterns with multiplicities, and each piece finds its place from its
rank among the pieces of its length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.llm import bpe
from lanternfish.llm.scratch import materialize

Pattern = tuple[list[tuple[int, int]], int]


class _Lengths:
    """Counts by length with quick answers on which lengths remain."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = [0] * (capacity + 1)
        for length, count in counts.items():
            self.n[length] = count

    def largest(self, most: int, without: dict[int, int]) -> int:
        return next((x for x in range(most, 0, -1) if self.n[x] > without.get(x, 0)), 0)

    def smallest(self, k: int, without: dict[int, int]) -> list[int]:
        out: list[int] = []
        for x in range(1, len(self.n)):
            out += [x] * min(k - len(out), max(0, self.n[x] - without.get(x, 0)))
            if len(out) == k:
                break
        return out


def _add(counts: dict[int, int], x: int) -> dict[int, int]:
    return counts | {x: counts.get(x, 0) + 1}


def _dominating(have: _Lengths, length: int, capacity: int) -> list[int] | None:
    """Companions that make the dominating set of ``length``, if one can be proved."""
    room, used = capacity - length, {length: 1}
    k = have.largest(room, used)
    if k == 0 or k == room:
        return [k] if k else []
    low = have.smallest(3, used)
    if len(low) < 2 or low[0] + low[1] > room:
        return [k]
    if len(low) == 3 and sum(low) <= room:
        return None
    # Two companions at most: look at every feasible pair x >= y.
    best_sum = best_y = 0
    for x in range(k, 0, -1):
        if have.n[x] > used.get(x, 0):
            y = have.largest(min(x, room - x), _add(used, x))
            if y:
                best_sum, best_y = max(best_sum, x + y), max(best_y, y)
    if best_sum <= k:
        return [k]
    b = have.largest(room - k, _add(used, k))
    return [k, b] if b and b >= best_y else None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """(patterns fixed for good, lengths left over)."""
    have, fixed = _Lengths(counts, capacity), []
    for length in range(capacity, 0, -1):
        while have.n[length]:
            others = _dominating(have, length, capacity)
            if others is None:
                break
            need: dict[int, int] = {}
            for x in [length, *others]:
                need = _add(need, x)
            times = min(have.n[x] // c for x, c in need.items())
            for x, c in need.items():
                have.n[x] -= c * times
            fixed.append((sorted(need.items(), reverse=True), times))
    return fixed, {x: c for x, c in enumerate(have.n) if c}


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over whole groups of equal lengths."""
    open_by_room: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = next((r for r in range(length, capacity + 1) if open_by_room[r]), None)
            items, times = open_by_room[room].pop() if room is not None else ([], left)
            room = capacity if room is None else room
            each = room // length
            used = min(times, left // each)
            if used:
                open_by_room[room - each * length].append(([*items, (length, each)], used))
                left -= used * each
                times -= used
            if times and left and items and left < each:
                open_by_room[room - left * length].append(([*items, (length, left)], 1))
                left, times = 0, times - 1
            elif not items and left:
                open_by_room[room - left * length].append(([(length, left)], 1))
                left = 0
            if items and times:
                open_by_room[room].append((items, times))
    return [p for group in open_by_room for p in group]


def plan(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns (lengths with repeats, number of sequences) that use every piece once."""
    fixed, rest = reduce_instance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, pieces a sequence, offset)."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for items, times in patterns:
        offset = 0
        for length, each in items:
            rows.setdefault(length, []).append((used.get(length, 0), sequence, each, offset))
            used[length] = used.get(length, 0) + each * times
            offset += each * length
        sequence += times
    return {length: np.array(r, dtype=np.int64) for length, r in rows.items()}


def _cut(batches, ranks: dict[bytes, int], added: dict[str, int], end_id: int, capacity: int):
    encoder, part, seen = bpe.Encoder(ranks, added), TaskContext.get().partitionId(), {}
    last = np.array([end_id], dtype=np.uint32)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
    for batch in batches:
        rows: list[list[int | None]] = [[] for _ in names]
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode([t or "" for t in batch.column(1).to_pylist()])):
            ids = np.concatenate([ids, last]).astype("<u4", copy=False)
            n = len(ids)
            bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                rank = seen[b - a] = seen.get(b - a, -1) + 1
                for column, x in zip(rows, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), part, rank)):
                    column.append(x)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)


def _place(batches, places: dict[int, np.ndarray]):
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy() + batch.column("base").to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length).tolist():
            at = np.flatnonzero(length == x)
            t = places[x][np.searchsorted(places[x][:, 0], rank[at], side="right") - 1]
            nth = rank[at] - t[:, 0]
            sequence[at] = t[:, 1] + nth // t[:, 2]
            offset[at] = t[:, 3] + nth % t[:, 2] * x
        keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = 1024, end_id: int = 2,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are documents of the end id alone.  A text longer than
    ``capacity`` gives pieces of that size after a first, shorter one.  Every
    row is a document of its own, repeated rows and null ids too.  Sequences
    have no gaps, and which of several pieces of equal length goes where is
    settled by the order in which the input is read.  An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ranks, added = spark.sparkContext.broadcast(bpe.load_ranks(tokenizer_path)), bpe.load_added(tokenizer_path)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"
    pieces = materialize(slim.mapInArrow(lambda it: _cut(it, ranks.value, added, end_id, capacity), schema), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(plan(histogram, capacity)))
    out = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return pieces.join(bases, ["part", "length"]).mapInArrow(lambda it: _place(it, places.value), out)
