"""Tables of documents and pages seen as the engine's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.functions.urls import domain, normalized
from lanternfish.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def as_documents(documents: DataFrame) -> DataFrame:
    """Engine documents: the first line is the title, dates and ranks follow from the id."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        "doc_id", F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("lang"), F.lit("/"), F.col("doc_id")).alias("url"),
        F.concat("source", F.lit(".example.org")).alias("domain"), F.substring(F.split(text, "\n")[0], 1, 80).alias("title"),
        F.lit("").alias("description"), text.alias("content"), F.col("lang").alias("language"),
        F.timestamp_add("DAY", (-(F.col("doc_id") % 400)).cast("int"), F.lit("2025-12-31 00:00:00").cast("timestamp")).alias("published_at"),
        (1.0 + (F.col("doc_id") % 5) * 0.5).alias("page_rank"), F.lit(0.0).alias("spam_score"), F.lit(1.0).alias("quality_score"),
    )


def as_search_log(events: DataFrame) -> DataFrame:
    """The search log: each event is a query of its type with its value as latency."""
    return events.select("event_id", F.col("event_type").alias("query"), F.lower("event_type").alias("normalized_query"), F.col("value").alias("latency_ms"), "ts")


def as_queue(pages: DataFrame) -> DataFrame:
    """A crawl queue of the pages; priority and age follow from the id."""
    url = normalized(F.col("url"))
    return pages.select(
        url.alias("url"), domain(url).alias("domain"), (F.col("page_id") % 100 + 1).alias("priority"), (F.col("page_id") % 8).cast("int").alias("depth"),
        F.lit("pending").alias("status"), F.timestamp_add("SECOND", F.col("page_id").cast("int"), F.lit("2025-01-01 00:00:00").cast("timestamp")).alias("discovered_at"),
    )


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): parts to suppliers to nations to regions, which lead nowhere."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    item, supplier, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    edge = lambda df, a, b: df.select(name(*a).alias("src"), name(*b).alias("dst"))
    edges = edge(item, ("p", "l_partkey"), ("s", "l_suppkey")).unionAll(edge(supplier, ("s", "s_suppkey"), ("n", "s_nationkey"))).unionAll(edge(nation, ("n", "n_nationkey"), ("r", "n_regionkey")))
    kinds = (("p", table(spark, sf_dir, "part"), "p_partkey"), ("s", supplier, "s_suppkey"), ("n", nation, "n_nationkey"), ("r", region, "r_regionkey"))
    nodes = [df.select(name(k, c).alias("node")) for k, df, c in kinds]
    return nodes[0].unionAll(nodes[1]).unionAll(nodes[2]).unionAll(nodes[3]), edges
