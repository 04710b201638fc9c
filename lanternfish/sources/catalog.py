"""The stored tables: schemas, and set-based insert, update and delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "documents": "doc_id bigint, url string, canonical_url string, domain string, title string, description string, content string, language string, mime_type string, status_code int, "
    "word_count bigint, content_hash string, simhash bigint, first_seen timestamp, last_crawled timestamp, last_modified timestamp, next_crawl timestamp, crawl_count int, "
    "page_rank double, spam_score double, quality_score double, is_indexed boolean",
    "crawl_queue": "url string, domain string, priority int, depth int, retry_count int, status string, discovered_at timestamp, last_attempt timestamp, error_message string, referrer_url string",
    "page_links": "source_url string, target_url string, anchor_text string, created_at timestamp",
    "postings": "term string, doc_id bigint, tf bigint, positions array<int>",
    "term_stats": "term string, doc_frequency bigint, total_occurrences bigint",
    "image_documents": "doc_id bigint, image_url string, page_url string, alt_text string, title string, width int, height int, surrounding_text string",
    "news_articles": "doc_id bigint, headline string, publisher string, author string, published_date timestamp",
    "crawl_events": "url string, domain string, title string, status string, status_code int, word_count bigint, links_count int, error string, at timestamp",
    "tasks": "task_id string, type string, payload string, enqueued_at timestamp, taken_by string",
    "search_logs": "query string, normalized_query string, results_count bigint, latency_ms double, ts timestamp",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{path}/{name}")


def write(df: DataFrame, path: str, name: str, mode: str = "append") -> None:
    """Write rows with exactly the table's columns and types."""
    shaped(df, name).write.mode(mode).parquet(f"{path}/{name}")


def shaped(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the table's columns and types; columns it lacks are null."""
    fields = [f.strip().split(" ") for f in TABLES[name].split(", ")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields))


def enqueued(tasks: DataFrame, new: DataFrame, now) -> DataFrame:
    """The task table with new tasks (type, payload) at its end."""
    fresh = new.select(F.expr("uuid()").alias("task_id"), "type", "payload", now.alias("enqueued_at"), F.lit(None).cast("string").alias("taken_by"))
    return tasks.unionByName(shaped(fresh, "tasks"))


def taken(tasks: DataFrame, worker: str, n: int = 1) -> DataFrame:
    """The task table after ``worker`` took the ``n`` oldest tasks that no one has."""
    first = tasks.where("taken_by is null").orderBy("enqueued_at", "task_id").limit(n).select("task_id", F.lit(worker).alias("__worker"))
    rows = tasks.join(F.broadcast(first), "task_id", "left")
    return rows.select(*(F.coalesce("taken_by", "__worker").alias(c) if c == "taken_by" else F.col(c) for c in tasks.columns))


def upsert_documents(old: DataFrame, new: DataFrame, now) -> DataFrame:
    """``old`` with the crawled pages ``new`` merged in by URL.

    A page seen before keeps its id, first_seen and, where the new ones are
    empty, title and description; its count grows and it waits for indexing.
    New pages have url, title, description, content, language, word_count,
    content_hash and simhash; ids follow the greatest in use.
    """
    fresh = new.dropDuplicates(["url"])
    take = ["title", "description", "content", "language", "word_count", "content_hash", "simhash"]
    n = fresh.select("url", *(F.col(c).alias(f"__{c}") for c in take)).withColumn("__hit", F.lit(True))
    rows = old.join(n, "url", "left")
    hit = F.coalesce("__hit", F.lit(False))
    changed = {c: F.when(hit, F.coalesce(F.nullif(f"__{c}", F.lit("")), F.col(c)) if c in ("title", "description") else F.col(f"__{c}")).otherwise(F.col(c)) for c in take}
    changed |= {"crawl_count": F.col("crawl_count") + hit.cast("int"), "is_indexed": F.col("is_indexed") & ~hit, "last_crawled": F.when(hit, now).otherwise(F.col("last_crawled"))}
    kept = rows.select(*(changed.get(c, F.col(c)).alias(c) for c in old.columns))
    added = fresh.join(old.select("url"), "url", "left_anti")
    top = old.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("top"))
    added = added.crossJoin(F.broadcast(top)).withColumn("doc_id", F.col("top") + 1 + F.monotonically_increasing_id())
    first = {"first_seen": now, "last_crawled": now, "crawl_count": F.lit(1), "page_rank": F.lit(1.0), "spam_score": F.lit(0.0), "quality_score": F.lit(1.0), "is_indexed": F.lit(False), "status_code": F.lit(200)}
    types = dict(old.dtypes)
    filled = [(F.col(c) if c in added.columns else first.get(c, F.lit(None))).cast(types[c]).alias(c) for c in old.columns]
    return kept.unionByName(added.select(*filled))


def upsert_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """Links unique by source and target; those known stay as they are."""
    fresh = new.dropDuplicates(["source_url", "target_url"]).join(old, ["source_url", "target_url"], "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def delete_documents(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the documents and what belongs to them."""
    gone = doc_ids.select("doc_id").distinct()
    return {name: df.join(gone, "doc_id", "left_anti") if "doc_id" in df.columns else df for name, df in tables.items()}
