"""Near-duplicate documents by weighted min-hashing of TF-IDF shingles.

A shingle is five words in a row; its weight is its frequency in the text times
the mean inverse document frequency of its words.  (A shingle's own document
frequency would fall with every copy that is to be found, and large groups of
copies would lose their links.)  Improved consistent weighted sampling draws
samples that two texts share with a probability equal to their weighted Jaccard
similarity; bands of samples name buckets, and pairs in a bucket are verified
on their whole weighted shingle sets.

Texts with the same words are one class from the start.  A bucket is led by its
most central class, and all others are compared with that one, so the pairs are
as many as the buckets' members.  Two members x and y may still be similar
although x is not similar to their leader p.  For those an exact filter works on
the differences from p.  With D(x) = x - p, taken shingle by shingle,

    |x - y| = |D(x)| + |D(y)| - 2 * (what D(x) and D(y) share, sign by sign),

and x and y are similar just if |x - y| <= c * (|x| + |y|), c = (1 - s) / (1 + s).
As |D(x)| > c * (|x| + |p|), both must share part of their differences, a signed
shingle among the rarest at that, and must have enough left of either after it.
Texts that differ from their leader each in its own way are never paired.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm import words as W
from lanternfish.llm.graph import components
from lanternfish.llm.scratch import materialize, numbered, passing, quoted, small_batches, without

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: Words share 2**DF_BITS counters, so the table of frequencies has a fixed size.
DF_BITS = 20
#: Bits of the filter that keeps texts without a candidate from being moved: at least, at most, and for each class let through.
FILTER_BITS, MOST_FILTER_BITS, BITS_EACH = 20, 26, 16
#: Shingles share 2**RANK_BITS counters by which texts order them from rare to common.
RANK_BITS = 20
#: For sums of rounded weights.
_SLACK = 1e-6
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_BLOCK = 2048
#: Bytes of shingle sets sent at once.
_SEND = 4 << 20


def _df_slot(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - DF_BITS)).astype(np.int64)


def _count_words(batches):
    seen = np.zeros(1 << DF_BITS, dtype=np.int64)
    rows = 0
    for batch in batches:
        rows += batch.num_rows
        for keys in W.word_hashes(batch.column(0).to_pylist()):
            if len(keys):
                seen[np.unique(_df_slot(keys))] += 1
    yield from _counters(seen, rows)


def _counters(seen: np.ndarray, rows: int = 0):
    """(slot, n) of the counters above 0, and of slot -1 with the number of rows."""
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([rows], pa.int64())], ["slot", "n"])
    slots = np.flatnonzero(seen)
    for at in range(0, len(slots), 10_000):
        part = slots[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(seen[part])], ["slot", "n"])


def _gathered(counters: DataFrame, bits: int) -> tuple[np.ndarray, int]:
    """The sums of all tasks' counters, a table of fixed size, and the number of rows."""
    rows = counters.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = rows.column("slot").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(1 << bits, dtype=np.int64)
    out[slot[slot >= 0]] = n[slot >= 0]
    return out, int(n[slot < 0].sum())


def word_idf(docs: DataFrame, text_col: str) -> np.ndarray:
    """Smoothed inverse document frequency of each word slot, over all documents."""
    df, total = _gathered(docs.select(F.col(quoted(text_col)).cast("string").alias("text")).mapInArrow(_count_words, "slot int, n bigint"), DF_BITS)
    return (np.log((1.0 + total) / (1.0 + df)) + 1.0).astype(np.float32)


def weighted_shingles(keys: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, weights); fewer words than five are one shingle."""
    n = len(keys)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    size = min(SHINGLE, n)
    count = n - size + 1
    code = np.zeros(count, dtype=np.uint64)
    mean = np.zeros(count, dtype=np.float32)
    rarity = idf[_df_slot(keys)]
    for j in range(size):
        code += keys[j : j + count] * _STEP[j]
        mean += rarity[j : j + count]
    shingles, first, times = np.unique(W.mixed(code), return_index=True, return_counts=True)
    return shingles, times.astype(np.float32) * mean[first] / np.float32(size)


@lru_cache(maxsize=1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers of the hash functions, and Gamma(2, 1) quantiles: r, 1/r, ln c."""
    rng = np.random.default_rng(20240229)
    odd = rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    x = np.geomspace(1e-6, 60, 200_000)
    cdf = 1 - (1 + x) * np.exp(-x)
    r = np.interp((np.arange(1 << 12) + 0.5) / (1 << 12), cdf, x)
    c = np.interp((np.arange(1 << 16) + 0.5) / (1 << 16), cdf, x)
    return odd[:, None], r.astype(np.float32), (1 / r).astype(np.float32), np.log(c).astype(np.float32)


def weighted_samples(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One consistent weighted sample for each hash function, as a 64-bit number."""
    odd, r_of, inverse_of, lnc_of = _draws()
    k = len(odd)
    every = np.arange(k)
    best = np.full(k, np.inf, dtype=np.float32)
    out = np.zeros(k, dtype=np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        h = shingles[at : at + _BLOCK]
        x = h[None, :] * odd
        slot = (x >> np.uint64(52)).astype(np.int32)
        r = r_of[slot]
        beta = ((x >> np.uint64(20)).astype(np.uint32) & np.uint32(0xFFFF)).astype(np.float32)
        beta *= np.float32(1 / 65536)
        t = np.log(weights[at : at + _BLOCK])[None, :] * inverse_of[slot]
        t += beta
        np.floor(t, out=t)
        value = lnc_of[(x >> np.uint64(36)).astype(np.int32) & 0xFFFF]
        beta -= t
        beta -= 1
        beta *= r
        value += beta
        low = value.argmin(axis=1)
        found = value[every, low]
        wins = found < best
        best[wins] = found[wins]
        step = t[every, low].astype(np.int64).astype(np.uint64)
        out[wins] = (h[low] ^ step * _STEP[1])[wins]
    return W.mixed(out)


def _band_keys(samples: np.ndarray) -> np.ndarray:
    code = np.arange(BANDS, dtype=np.uint64) * _STEP[4]
    for j in range(ROWS):
        code = W.mixed(code + samples[j::ROWS] * _STEP[j])
    return code.view(np.int64)


def class_of(keys: np.ndarray) -> tuple[int, int]:
    """Name of a word sequence: 128 bits as two signed numbers."""
    name = hashlib.blake2b(keys.tobytes(), digest_size=16).digest()
    return int.from_bytes(name[:8], "little", signed=True), int.from_bytes(name[8:], "little", signed=True)


def _sign(batches, idf):
    for batch in batches:
        one, two, bands = [], [], []
        for keys in W.word_hashes(batch.column(2).to_pylist()):
            if not len(keys):
                for column in (one, two, bands):
                    column.append(None)
                continue
            a, b = class_of(keys)
            one.append(a)
            two.append(b)
            bands.append(_band_keys(weighted_samples(*weighted_shingles(keys, idf))))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "row_no", "h1", "h2", "bands"],
        )


def _sets(batches, idf, bits):
    """Weighted shingle sets of texts whose class the filter lets through, once a task."""
    done: set[tuple[int, int]] = set()
    mask = 64 * len(bits) - 1
    for batch in batches:
        rows: list[tuple[int, int, bytes, bytes]] = []
        size = 0
        for keys in W.word_hashes(batch.column(0).to_pylist()):
            name = class_of(keys) if len(keys) else None
            if name is None or name in done:
                continue
            slot = name[0] & mask
            if not bits[slot >> 6] >> np.uint64(slot & 63) & np.uint64(1):
                continue
            done.add(name)
            shingles, weights = weighted_shingles(keys, idf)
            rows.append((*name, shingles.tobytes(), weights.tobytes()))
            size += 12 * len(shingles)
            if size > _SEND:
                yield _set_rows(rows)
                rows, size = [], 0
        yield _set_rows(rows)


def _set_rows(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["h1", "h2", "shingles", "weights"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (sorted hashes, weights)."""
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    values = np.concatenate([a[1], b[1]]).astype(np.float64)
    shared = np.minimum(values[order[same]], values[order[same + 1]]).sum()
    return float(shared / max(values.sum() - shared, 1e-300))


def _pairs_of_sets(batch: pa.RecordBatch):
    """((shingles, weights), (shingles, weights)) of each row."""
    columns = [(batch.column(n), kind) for n, kind in (("sa", np.uint64), ("wa", np.float32), ("sb", np.uint64), ("wb", np.float32))]
    for i in range(batch.num_rows):
        sa, wa, sb, wb = (np.frombuffer(c[i].as_buffer(), kind) for c, kind in columns)
        yield (sa, wa), (sb, wb)


def _verify(batches, least: float):
    for batch in batches:
        near = pa.array([similarity(a, b) >= least for a, b in _pairs_of_sets(batch)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), near], ["a", "b", "near"])


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    one = sets.select(F.col("class").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa"))
    two = sets.select(F.col("class").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb"))
    return pairs.join(one, "a").join(two, "b")


def _verified(pairs: DataFrame, sets: DataFrame, least: float, label: str) -> DataFrame:
    """(a, b, near) for each pair of classes."""
    with small_batches(pairs.sparkSession):
        return materialize(_with_sets(pairs, sets).mapInArrow(lambda it: _verify(it, least), "a bigint, b bigint, near boolean"), label)


def _filter_bits(classes: DataFrame) -> np.ndarray:
    """A bitmap of bounded size of the classes' names; built by aggregation."""
    n = classes.count()
    size = min(max(FILTER_BITS, (BITS_EACH * n).bit_length()), MOST_FILTER_BITS)
    slot = F.col("h1").bitwiseAND(F.lit((1 << size) - 1))
    words = classes.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h1 & 63 as int)))").alias("bits")).toArrow()
    bits = np.zeros(1 << size - 6, dtype=np.uint64)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bits


def _buckets(classes: DataFrame) -> DataFrame:
    """(key, class, h1, h2, n) of the classes that share a bucket of n classes."""
    entries = classes.select("class", "h1", "h2", F.explode("bands").alias("key"))
    shared = materialize(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    return materialize(entries.join(shared, "key"), "buckets")


def _led(buckets: DataFrame) -> DataFrame:
    """(a, b): each class and the leaders of its buckets, once each.

    The class with the most company in all its buckets leads a bucket; in a
    group of copies that is the text from which the others differ least.
    """
    known = buckets.join(buckets.groupBy("class").agg(F.sum("n").alias("company")), "class")
    leaders = materialize(known.groupBy("key").agg(F.max(F.struct("company", "class")).alias("top")).select("key", F.col("top.class").alias("b")), "leaders")
    return materialize(buckets.select("key", F.col("class").alias("a")).join(leaders, "key").where("a <> b").select("a", "b").distinct(), "led")


def _rank_slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - RANK_BITS)).astype(np.int64)


def _count_shingles(batches):
    seen = np.zeros(1 << RANK_BITS, dtype=np.int64)
    for batch in batches:
        for value in batch.column(0):
            np.add.at(seen, _rank_slot(np.frombuffer(value.as_buffer(), np.uint64)), 1)
    yield from _counters(seen)


def differences(x: tuple[np.ndarray, np.ndarray], p: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, x's weight less p's) where the two sets differ, by shingle."""
    keys = np.concatenate([x[0], p[0]])
    values = np.concatenate([x[1].astype(np.float64), -p[1].astype(np.float64)])
    keys, at = np.unique(keys, return_inverse=True)
    by = np.bincount(at, weights=values, minlength=len(keys))
    there = np.flatnonzero(by)
    return keys[there], by[there]


def signed_prefix(keys: np.ndarray, by: np.ndarray, ranks: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """The first signed shingles up to a weight of ``limit``, and what weight is left from each on.

    All texts order theirs alike: added ones first, then missing ones, each from
    rare to common.
    """
    order = np.lexsort((keys, ranks[_rank_slot(keys)], by < 0))
    size = np.abs(by[order])
    until = np.cumsum(size)
    before = until - size
    some = order[: np.searchsorted(before, limit, side="right")]
    signed = keys[some] & ~np.uint64(1) | (by[some] < 0).astype(np.uint64)
    return signed.view(np.int64), until[-1] - before[: len(some)]


_ENTRY = "leader bigint, key bigint, class bigint, c bigint, far boolean, differs double, mass double, left double"


def _emit_differences(batches, ranks, least: float):
    c = (1 - least) / (1 + least)
    names = [x.split()[0] for x in _ENTRY.split(", ")]
    for batch in batches:
        rows, found = [], []
        for i, (x, p) in enumerate(_pairs_of_sets(batch)):
            keys, by = differences(x, p)
            if not len(keys):
                continue
            mass, leads, differs = float(x[1].sum(dtype=np.float64)), float(p[1].sum(dtype=np.float64)), float(np.abs(by).sum())
            far = not batch.column("near")[i].as_py()
            # What a partner need not share: of a far text whatever the partner, of a near text only with far partners.
            limit = mass * (1 - least) / least if far else (differs + c * (mass - leads)) / 2
            found.append(signed_prefix(keys, by, ranks, limit + _SLACK * mass))
            rows.append((i, far, differs, mass))
        sizes = np.array([len(k) for k, _ in found], dtype=np.int64)
        which = np.repeat(np.array([r[0] for r in rows], dtype=np.int64), sizes)
        far, differs, mass = (np.repeat(np.array([r[j] for r in rows], dtype=t), sizes) for j, t in ((1, bool), (2, float), (3, float)))
        key, left = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, t) for j, t in ((0, np.int64), (1, float)))
        leader, own, part = (batch.column(n).take(pa.array(which)) for n in ("b", "a", "c"))
        yield pa.RecordBatch.from_arrays([leader, pa.array(key), own, part, pa.array(far), pa.array(differs), pa.array(mass), pa.array(left)], names)


def _open(met: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b, near, c): the classes of leaders whose company spans several components."""
    here = met.join(parts.select(F.col("class").alias("a"), "c"), "a").join(parts.select(F.col("class").alias("b"), F.col("c").alias("c_b")), "b")
    mixed = materialize(here.groupBy("b").agg(F.max(F.col("c") != F.col("c_b")).alias("mixed")).where("mixed").select("b"), "mixed")
    return here.select("a", "b", "near", "c").join(mixed, "b")


def _apart(entries: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of different components, with one leader, that the filter cannot tell apart."""
    side = lambda x: [F.col(n).alias(f"{n}_{x}") for n in ("class", "c", "far", "differs", "mass", "left")]
    one = entries.where("far").select("leader", "key", *side("a"))
    two = entries.select("leader", "key", *side("b"))
    c = (1 - least) / (1 + least)
    both = F.col("mass_a") + F.col("mass_b")
    shared = (F.col("differs_a") + F.col("differs_b") - c * both) / 2
    fits = (F.least("mass_a", "mass_b") >= least * F.greatest("mass_a", "mass_b") * (1 - _SLACK)) & (F.least("left_a", "left_b") >= shared - _SLACK * both)
    once = (F.col("c_a") != F.col("c_b")) & (~F.col("far_b") | (F.col("class_a") > F.col("class_b")))
    met = one.join(two, ["leader", "key"]).where(once & fits)
    return met.select(F.greatest("class_a", "class_b").alias("a"), F.least("class_a", "class_b").alias("b")).distinct()


def _linked(classes: DataFrame, texts: DataFrame, idf, least: float) -> DataFrame:
    """(h1, h2, in_group): the component of each class that is similar to another."""
    spark = classes.sparkSession
    buckets = _buckets(classes)
    crowded = materialize(buckets.select("class", "h1", "h2").distinct(), "crowded")
    bits = spark.sparkContext.broadcast(_filter_bits(crowded))
    found = texts.mapInArrow(lambda it: _sets(it, idf.value, bits.value), "h1 bigint, h2 bigint, shingles binary, weights binary")
    found = found.groupBy("h1", "h2").agg(F.first("shingles").alias("shingles"), F.first("weights").alias("weights"))
    with small_batches(spark):
        sets = materialize(found.join(crowded, ["h1", "h2"]).select("class", "shingles", "weights"), "sets")

    met = _verified(_led(buckets), sets, least, "met")
    links = met.where("near").select("a", "b")
    parts = materialize(components(links), "parts")
    parts = crowded.select("class").join(parts, crowded["class"] == parts["node"], "left").select("class", F.coalesce("component", "class").alias("c"))
    parts = materialize(parts, "parts")
    with small_batches(spark):
        ranks = spark.sparkContext.broadcast(_gathered(sets.select("shingles").mapInArrow(_count_shingles, "slot int, n bigint"), RANK_BITS)[0])
        opened = _with_sets(_open(met, parts), sets)
        entries = materialize(opened.mapInArrow(lambda it: _emit_differences(it, ranks.value, least), _ENTRY), "differences")
    more = _verified(_apart(entries, least), sets, least, "more").where("near").select("a", "b")
    joined = parts.where("class <> c").select(F.col("class").alias("a"), F.col("c").alias("b")).union(more)
    groups = materialize(components(joined), "groups")
    return classes.join(groups, classes["class"] == groups["node"]).select("h1", "h2", F.col("component").alias("in_group"))


def _groups(slim: DataFrame, least: float) -> DataFrame:
    """(row_no, doc_id, group_id, group_size, kept) for each row of (doc_id, row_no, text)."""
    spark = slim.sparkSession
    with passing(spark):
        with small_batches(spark):
            idf = spark.sparkContext.broadcast(word_idf(slim, "text"))
            signed = slim.mapInArrow(lambda it: _sign(it, idf.value), "doc_id bigint, row_no bigint, h1 bigint, h2 bigint, bands array<bigint>")
            signed = materialize(signed, "signed")
        classes = signed.where("h1 is not null").groupBy("h1", "h2").agg(F.min("row_no").alias("class"), F.first("bands").alias("bands"))
        linked = materialize(_linked(materialize(classes, "classes"), slim.select("text"), idf, least), "linked")
        # Linked classes by component, others by name, texts without a word each alone.
        own = F.struct(
            F.when(F.col("in_group").isNotNull(), 2).when(F.col("h1").isNotNull(), 1).otherwise(0).alias("kind"),
            F.coalesce("in_group", "h1", "row_no").alias("g1"), F.when(F.col("in_group").isNull() & F.col("h2").isNotNull(), F.col("h2")).otherwise(F.lit(0).cast("long")).alias("g2"),
        )
        rows = signed.select("doc_id", "row_no", "h1", "h2").join(linked, ["h1", "h2"], "left")
        rows = materialize(rows.select("doc_id", "row_no", own.alias("group")), "members", lasting=True)
        best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_no")).alias("best")
        best = materialize(rows.groupBy("group").agg(best, F.count("*").alias("group_size")), "best", lasting=True)
    return rows.join(best, "group").select("row_no", "doc_id", F.col("best.doc_id").alias("group_id"), "group_size", (F.col("best.row_no") == F.col("row_no")).alias("kept"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, group_id, group_size, kept.

    A group is a connected component of texts with a weighted similarity of
    ``least`` or more; ``group_id`` is its least doc_id, and that row stays.
    Texts with the same words are always together.  Texts without a word (null,
    empty, punctuation) are groups of one.  Rows repeated with one id form a
    group by their text as other rows do; one of them stays.  Whole texts are
    compared, however long.  An empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    slim = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.col(quoted(text_col)).cast("string").alias("text"))
    return _groups(slim, least).drop("row_no")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group, that of the least id; all columns stay.

    Rows are told apart as rows: of rows repeated with one id, equal or not, only
    those stay that ``near_groups`` keeps.  Null and empty texts and texts
    without a word all stay.  Columns may have any names.  An empty table stays
    empty.
    """
    rows, number = numbered(docs)
    slim = rows.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(number).alias("row_no"), F.col(quoted(text_col)).cast("string").alias("text"))
    return without(rows, number, _groups(slim, least).where("not kept").select("row_no"))
