"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.scratch import materialize

#: From this many edges at one node on, least neighbours are written out before they are joined:
#: a join of two plain exchanges is one whose large partitions Spark splits.
HUB = 100_000


def _apart(least: DataFrame, hubs: bool) -> DataFrame:
    return materialize(least, "least") if hubs else least


def _large_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Tie each node's larger neighbours to the least node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _apart(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), hubs)
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, hubs: bool) -> DataFrame:
    """Tie each node and its smaller neighbours to the least of them; here a > b."""
    least = _apart(edges.groupBy("a").agg(F.min("b").alias("m")), hubs)
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its least node.

    Self-loops name a node without linking it; edges with a null end are no
    edges; repeated edges change nothing.  ``edges`` is evaluated once, and
    every round is written to the shared folder, so no lineage grows; the number
    of rounds is logarithmic.  Nodes with very many edges are split over tasks.
    """
    edges = materialize(edges.select("a", "b").where("a is not null and b is not null").distinct(), "given")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    ends = now.select("a").union(now.select("b"))
    most = ends.groupBy("a").count().agg(F.max("count")).first()[0] or 0
    before = None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        hubs = most >= HUB
        now = materialize(_small_star(_large_star(now, hubs), hubs), "edges")
        # A star's centre gathers edges, so later rounds are split wherever one may have become a hub.
        most = max(most, state[0] if state[0] >= HUB else 0)
    tied = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(tied, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
