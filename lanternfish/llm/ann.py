"""Approximate nearest neighbours by inner product, with collision counting.

Vectors get one more coordinate that makes their norms equal, so the largest
inner product is the least distance.  Each of many random lines holds a sorted
array of projections.  A query opens a window around its own projection on
every line and widens all windows together (virtual rehashing); vectors that
fall into enough windows are verified with their true inner product, until as
many verified vectors as asked for lie within the radius that the windows stand
for.  Windows that cover a whole line verify everything, so no case is cut off.

Windows are found by binary search in the sorted arrays.  Of each vector its
place on every line is kept, and a vector collides where its place lies in the
window, so collisions are counted by comparing places.

The table is dealt by id into shards of bounded size, each with its own arrays,
and the query set into blocks; every block meets every shard.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 16_384
BLOCK_ROWS = 4_096
LINES = 192
#: Half a window in units of the radius, and the share of lines that must collide.
HALF_WIDTH = 1.5
THRESHOLD = 0.84
GROWTH = 1.03
#: Vectors from which a query's first radius is guessed; a wrong guess changes the work, not what is reached.
SAMPLE = 256
#: Queries looked at together, and vectors whose places are compared at once.
_CHUNK, _SPAN = 128, 1024


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, dims) of the rows that take part, ``v`` in double precision."""
    v = F.col(vector_col).cast("array<double>")
    slim = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return slim.where(F.col("vec_id").isNotNull() & ~bad & F.exists("v", lambda x: x != 0)).withColumn("dims", F.size("v"))


def _largest(vectors: DataFrame) -> list:
    """(dims, n, top) by length of vector: how many there are, and the largest norm.

    Norms go by way of each vector's largest component, so no square runs over or under.
    """
    units = vectors.select("dims", "v", F.array_max(F.transform("v", lambda x: F.abs(x))).alias("unit"))
    scaled = units.select("dims", "unit", F.transform("v", lambda x: x / F.col("unit")).alias("w"))
    norm = F.col("unit") * F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, x: s + x * x))
    return scaled.groupBy("dims").agg(F.count("*").alias("n"), F.max(norm).alias("top")).collect()


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors), one row for each id, by id; of one id's vectors the least in component order."""
    ids = table.column("vec_id").to_numpy()
    x = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    order = np.argsort(ids, kind="stable")
    if (ids[order][1:] == ids[order][:-1]).any():
        order = np.lexsort((*x.T[::-1], ids))
    ids = ids[order]
    first = np.append(True, ids[1:] != ids[:-1])[: len(ids)]
    return ids[first], x[order[first]]


class Lines:
    """Sorted projections of the vectors of one shard."""

    def __init__(self, vectors: np.ndarray, top_norm: float, lines: int = LINES, seed: int = 11):
        n, d = vectors.shape
        # In units of the largest norm.
        self.vectors = vectors / top_norm
        extra = np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", self.vectors, self.vectors), 0))
        rng = np.random.default_rng(seed)
        self.directions = rng.standard_normal((lines, d))
        at = self.directions @ self.vectors.T + rng.standard_normal(lines)[:, None] * extra[None, :]
        order = np.argsort(at, axis=1)
        self.sorted = np.take_along_axis(at, order, axis=1)
        #: The place of each vector on each line, in slices of ``_SPAN`` vectors.
        places = np.empty((lines, n), dtype=np.uint16 if n <= 1 << 16 else np.uint32)
        np.put_along_axis(places, order, np.arange(n, dtype=places.dtype)[None, :], axis=1)
        self.places = [np.ascontiguousarray(places[:, i : i + _SPAN]) for i in range(0, n, _SPAN)]
        self.lines = lines
        self.sample = rng.permutation(n)[:SAMPLE]
        #: Vectors verified so far, over all queries.
        self.verified = 0

    def _colliding(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many windows each vector lies in."""
        kind = self.places[0].dtype
        low_, width = low.astype(kind)[:, None], (high - low).astype(kind)[:, None]
        out = np.concatenate([np.add.reduce((p - low_) < width, axis=0, dtype=np.uint16) for p in self.places])
        whole = int(np.count_nonzero(high - low > np.iinfo(kind).max))
        return out + whole if whole else out

    def search(self, queries: np.ndarray, k: int, skip: np.ndarray) -> list[np.ndarray]:
        """For each query, positions of verified vectors, among them the ``k`` nearest found.

        ``skip`` has the query's own position in the shard, or -1.
        """
        out: list[np.ndarray] = []
        for i in range(0, len(queries), _CHUNK):
            out += self._search(queries[i : i + _CHUNK], k, skip[i : i + _CHUNK])
        return out

    def _search(self, queries: np.ndarray, k: int, skip: np.ndarray) -> list[np.ndarray]:
        n, m = len(self.vectors), len(queries)
        q = queries / np.abs(queries).max(axis=1, keepdims=True)
        q /= np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
        here = self.directions @ q.T
        need = max(1, math.ceil(THRESHOLD * self.lines))
        wanted = np.minimum(k, n - (skip >= 0))
        near = np.sqrt(np.maximum(2 - 2 * (q @ self.vectors[self.sample].T), 0))
        near[self.sample[None, :] == skip[:, None]] = np.inf
        # About where the last neighbour lies, if distances are spread normally.
        finite = np.isfinite(near)
        count = np.maximum(finite.sum(axis=1), 1)
        mean = np.where(finite, near, 0).sum(axis=1) / count
        spread = np.sqrt((np.where(finite, near - mean[:, None], 0) ** 2).sum(axis=1) / count)
        share = np.clip((wanted + 0.5) / n, 1e-9, 0.5)
        guess = mean + np.array([NormalDist().inv_cdf(float(x)) for x in share]) * spread
        radius = np.maximum(np.minimum(guess, near.min(axis=1)), 1e-6)
        done = wanted <= 0
        verified = [np.zeros(n, dtype=bool) for _ in range(m)]
        distance = [np.full(n, np.inf) for _ in range(m)]
        while not done.all():
            active = np.flatnonzero(~done)
            half = HALF_WIDTH * radius[active]
            low = np.stack([row.searchsorted(x - half, "left") for row, x in zip(self.sorted, here[:, active])])
            high = np.stack([row.searchsorted(x + half, "right") for row, x in zip(self.sorted, here[:, active])])
            for j, i in enumerate(active.tolist()):
                fresh = self._colliding(low[:, j], high[:, j]) >= need
                fresh &= ~verified[i]
                if skip[i] >= 0:
                    fresh[skip[i]] = False
                at = np.flatnonzero(fresh)
                if len(at):
                    verified[i][at] = True
                    distance[i][at] = 2 - 2 * (self.vectors[at] @ q[i])
                    self.verified += len(at)
                done[i] = np.count_nonzero(distance[i] <= radius[i] ** 2) >= wanted[i] or (low[:, j] == 0).all() and (high[:, j] == n).all()
            radius *= GROWTH
        out = []
        for d, most in zip(distance, wanted.tolist()):
            found = np.flatnonzero(np.isfinite(d))
            if len(found) > most:
                # Keep all that may be among the nearest, equal vectors included.
                edge = np.partition(d[found], most - 1)[most - 1] + 1e-9 if most > 0 else -1.0
                found = found[d[found] <= edge]
            out.append(found)
        return out


def _meet(vectors: pa.Table, queries: pa.Table, k: int, top: dict[int, float]) -> pa.Table:
    out: list[list] = [[], [], []]
    if vectors.num_rows and queries.num_rows:
        ids, x = _matrix(vectors)
        q_ids, asked = _matrix(queries)
        at = np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)
        own = np.where(ids[at] == q_ids, at, -1)
        for q_id, q, found in zip(q_ids, asked, Lines(x, top[x.shape[1]]).search(asked, k, own)):
            # Added up one coordinate after another, so that equal vectors score equally.
            score = (x[found].T * q[:, None]).sum(axis=0)
            best = np.lexsort((ids[found], -score))[:k]
            out[0].append(np.full(len(best), q_id))
            out[1].append(ids[found][best])
            out[2].append(score[best])
    columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
    return pa.table({"query_id": pa.array(columns[0].astype(np.int64)), "vec_id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(np.float64))})


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, nearest first.

    ``queries`` has the columns of ``vectors``; a query never finds its own id.
    Vectors that are null, zero or hold a null or non-finite component take no
    part, nor do rows with a null id; a query only meets vectors of its own
    length.  Rows repeated with one id count once, with the least of their
    vectors if those differ.  Equal scores are ordered by id.  A query without
    candidates has no rows, so empty tables give empty results.  Other columns
    are ignored.
    """
    pool, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    stats = _largest(pool)
    shards = max(1, math.ceil(max((r["n"] for r in stats), default=0) / SHARD_ROWS))
    blocks = max(1, math.ceil(asked.count() / BLOCK_ROWS))
    top = {r["dims"]: r["top"] for r in stats}
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    left = pool.select("vec_id", "v", "dims", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = asked.select("vec_id", "v", "dims", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), block.alias("block"))
    keys = ["dims", "shard", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda a, b: _meet(a, b, k, top), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
