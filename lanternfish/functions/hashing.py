"""Content hashes, SimHash, and duplicate detection over them."""

from __future__ import annotations

import hashlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word may hold + # . inside, but starts and ends with a word character.
_FEATURE_WORDS = re.compile(r"[\p{L}\p{M}\p{N}_]+(?:[\p{L}\p{M}\p{N}_+#.]*[\p{L}\p{M}\p{N}_]+)?")


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class SimHasher:
    """SimHash of many texts: features are looked up in a table of bits, so each is hashed once a worker.

    A 4-gram weighs 1 and a word 2 for each time it occurs, so a text's sums are
    those of its features' bits in whatever order.
    """

    #: Features kept at once; the table starts afresh beyond.
    MOST = 1 << 18

    def __init__(self):
        self.place: dict[str, int] = {}
        self.bits = np.zeros((1024, 64), np.uint8)
        self.grams: dict[int, int] = {}

    def _row(self, feature: str) -> int:
        at = self.place.get(feature)
        if at is None:
            at = self.place[feature] = len(self.place)
            if at == len(self.bits):
                self.bits = np.concatenate([self.bits, np.zeros_like(self.bits)])
            self.bits[at] = np.unpackbits(np.frombuffer(hashlib.md5(feature.encode()).digest()[:8], np.uint8))
        return at

    def _grams(self, text: str) -> tuple[list[int], list[int]]:
        """(table rows, times) of the 4-grams of ``text``, which has four characters or more."""
        if text.isascii():
            c = np.frombuffer(text.encode(), np.uint8).astype(np.uint64)
        else:
            c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            if c.max() > 0xFFFF:
                times = Counter(text[i : i + 4] for i in range(len(text) - 3))
                return [self._row(g) for g in times], list(times.values())
        keys = c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]
        unique, first, times = np.unique(keys, return_index=True, return_counts=True)
        known, rows = self.grams, []
        for key, i in zip(unique.tolist(), first.tolist()):
            at = known.get(key)
            if at is None:
                at = known[key] = self._row(text[i : i + 4])
            rows.append(at)
        return rows, times.tolist()

    def of(self, text: str | None) -> int:
        """The 64-bit SimHash of a text, as a signed number; 0 without features."""
        text = " ".join((text or "").split()).lower()
        if len(self.place) > self.MOST:
            self.__init__()
        words = Counter(_FEATURE_WORDS.findall(text))
        rows, times = self._grams(text) if len(text) > 3 else ([], [])
        rows += [self._row(w) for w in words]
        times += [2 * n for n in words.values()]
        if not rows:
            return 0
        weights = np.array(times, np.float64)
        sums = weights @ self.bits[rows].astype(np.float64)
        return int.from_bytes(np.packbits(2 * sums > weights.sum()).tobytes(), "big", signed=True)


def simhash_of(text: str | None) -> int:
    """The 64-bit SimHash of one text."""
    return SimHasher().of(text)


def _simhashes(batches):
    hasher = SimHasher()
    for batch in batches:
        values = [hasher.of(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "simhash"])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, simhash): 64-bit SimHash of character 4-grams and words, by MD5.

    Features never leave their row: no explode and no shuffle.  Sums are matrix
    products over a text's distinct features; MD5 runs once for each feature a
    worker meets.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_simhashes, "doc_id bigint, simhash bigint")


def unsigned(value: Column) -> Column:
    """A 64-bit pattern as an unsigned decimal string."""
    return F.conv(F.hex(value), 16, 10)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_pairs(hashes: DataFrame, distance: int = 3) -> DataFrame:
    """(a, b, distance): pairs of different hashes within ``distance`` bits.

    Each hash is stood for by the least doc_id that has it; ``hashes`` tells who
    else does.  A hash of 0 (no features) matches nothing.  Of twice as many
    blocks of bits as ``distance`` says, at least half agree in such a pair, so
    a join on every choice of half the blocks misses none.  A choice is 32 of
    the 64 bits, so unrelated hashes seldom meet.
    """
    blocks = max(2 * distance, 1)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    known = hashes.where("simhash <> 0").groupBy("simhash").agg(F.min("doc_id").alias("rep"))

    def part(choice: tuple[int, ...]) -> Column:
        mask = sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in choice)
        return F.col("simhash").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    choices = list(combinations(range(blocks), blocks - distance))
    parts = F.array(*(F.struct(F.lit(n).alias("choice"), part(c).alias("part")) for n, c in enumerate(choices)))
    banded = known.select("simhash", "rep", F.explode(parts).alias("p")).select("simhash", "rep", "p.*")
    left = banded.select("choice", "part", F.col("simhash").alias("x"), F.col("rep").alias("a"))
    right = banded.select("choice", "part", F.col("simhash").alias("y"), F.col("rep").alias("b"))
    near = hamming(F.col("x"), F.col("y"))
    met = left.join(right, ["choice", "part"]).where((F.col("a") < F.col("b")) & (near <= distance))
    return met.select("a", "b", near.alias("distance")).distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(content_hash, keep_id, copies) of the texts found more than once."""
    hashed = docs.select(F.col(id_col).alias("doc_id"), sha256(F.col(text_col)).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1")
