"""Statistics, suggestions, log and metric reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.operators.index import Index, vocabulary_prefix

#: Upper bounds of the search latency histogram, in milliseconds.
LATENCY_BOUNDS = [5, 10, 25, 50, 100, 250, 500, 1000]
SECRET_KEYS = ["pass", "token", "secret", "auth", "key"]


def top_domains(docs: DataFrame, k: int = 5) -> DataFrame:
    return docs.groupBy("domain").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "domain").limit(k)


def popular_queries(log: DataFrame, prefix: str = "", k: int = 8) -> DataFrame:
    """(query, n) of the logged queries that start with ``prefix``, most frequent first."""
    hits = log.where(F.col("normalized_query").startswith(prefix.strip().lower()))
    return hits.groupBy("normalized_query", "query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(k).select("query", "n")


def suggest(index: Index, log: DataFrame, prefix: str, k: int = 8) -> DataFrame:
    """(place, suggestion): popular queries first, then index terms; the first of equals stays."""
    prefix = prefix.strip().lower()
    asked = popular_queries(log, prefix, k).select(F.lit(0).alias("part"), F.col("query").alias("suggestion"), F.col("n"))
    terms = vocabulary_prefix(index, prefix, k).select(F.lit(1).alias("part"), F.col("term").alias("suggestion"), F.col("doc_frequency").alias("n"))
    # At most 2 k rows are left here.
    both = asked.union(terms).withColumn("nth", F.row_number().over(Window.partitionBy("suggestion").orderBy("part")))
    order = Window.orderBy("part", F.desc("n"), "suggestion")
    return both.where("nth = 1").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("place", "suggestion")


def recent_searches(log: DataFrame, k: int = 10) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(k)


def corpus_overview(index: Index, docs: DataFrame, log: DataFrame, queue: DataFrame, links: DataFrame) -> DataFrame:
    """One row of totals, each a single-row aggregate."""
    one = lambda df, e, name: df.agg(e.alias(name))
    parts = [
        one(docs, F.count("*"), "pages_crawled"), one(index.doc_stats, F.count("*"), "pages_indexed"),
        one(index.postings, F.count_distinct("term"), "unique_terms"), one(log, F.count("*"), "searches"),
        one(queue, F.count(F.when(F.col("status") == "failed", 1)), "failed_urls"),
        one(queue, F.count(F.when(F.col("status") == "pending", 1)), "queued_urls"), one(links, F.count("*"), "links"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def health(index: Index, crawling: bool = False) -> DataFrame:
    """One row: status, app, whether a crawl runs, and how many documents are indexed."""
    return index.doc_stats.agg(F.count("*").alias("indexed_docs")).select(F.lit("healthy").alias("status"), F.lit("lanternfish").alias("app"), F.lit(crawling).alias("crawler_running"), "indexed_docs")


def histogram(values: DataFrame, value: Column, keys: list[str], bounds: list[float] = LATENCY_BOUNDS) -> DataFrame:
    """Cumulative counts up to each bound, with sum and count, per key."""
    counts = [F.count(F.when(value <= b, 1)).alias(f"le_{b}") for b in bounds]
    return values.groupBy(*keys).agg(*counts, F.count(value).alias("count"), F.round(F.sum(value), 4).alias("sum"))


def redacted(fields: Column) -> Column:
    """A map of log fields with the values of telling keys masked."""
    tells = lambda k: F.exists(F.array(*map(F.lit, SECRET_KEYS)), lambda s: F.lower(k).contains(s))
    return F.transform_values(fields, lambda k, v: F.when(tells(k), F.lit("[REDACTED]")).otherwise(v))


def cached_results(entries: DataFrame, now: Column, most: int | None = None) -> DataFrame:
    """Entries (key, value, expires_at, inserted_at) still valid; null expires_at never ends.

    Where ``most`` or more are left, the oldest fifth of ``most`` goes, as before
    one more is put in.
    """
    live = entries.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    if most is None:
        return live
    count = live.agg(F.count("*").alias("__count"))
    gone = live.orderBy("inserted_at", "key").limit(most // 5).select("key", "inserted_at")
    full = gone.crossJoin(F.broadcast(count)).where(F.col("__count") >= most)
    return live.join(full, ["key", "inserted_at"], "left_anti").select(*entries.columns)


def remembered(entries: DataFrame, new: DataFrame, now: Column, most: int = 10_000) -> DataFrame:
    """The cache after ``new`` entries came in: of a key the latest stays."""
    rest = cached_results(entries, now, most).join(new.select("key"), "key", "left_anti")
    return rest.select(*entries.columns).unionByName(new.select(*entries.columns))


#: Upper bounds of the fetch latency histogram, in seconds.
FETCH_BOUNDS = [0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def metrics(fetches: DataFrame, searches: DataFrame, docs: DataFrame, queue: DataFrame, cache: DataFrame, workers: DataFrame) -> DataFrame:
    """(name, labels, value): the counters, gauges and histogram buckets of the engine, from its tables.

    ``fetches`` has domain, status, error, latency_s; ``searches`` latency_ms;
    ``docs`` is_indexed; ``queue`` status; ``cache`` cache_type, hit;
    ``workers`` worker_type, active.
    """

    def label(**of: Column) -> Column:
        return F.concat_ws(",", *(F.concat(F.lit(f'{k}="'), v.cast("string"), F.lit('"')) for k, v in of.items()))

    def counted(df: DataFrame, name: str, **of: Column) -> DataFrame:
        return df.groupBy(label(**of).alias("labels")).agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("name"), "labels", "value")

    def one(df: DataFrame, name: str, value: Column) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), F.lit("").alias("labels"), "value")

    def buckets(df: DataFrame, name: str, value: Column, bounds: list[float], **of: Column) -> DataFrame:
        ends = [F.struct(F.lit(f"{b:g}").alias("le"), (value <= b).alias("within")) for b in bounds] + [F.struct(F.lit("+Inf").alias("le"), value.isNotNull().alias("within"))]
        rows = df.select(label(**of).alias("of") if of else F.lit("").alias("of"), value.alias("v"), F.explode(F.array(*ends)).alias("e"))
        counts = rows.groupBy("of", "e.le").agg(F.count(F.when(F.col("e.within"), 1)).cast("double").alias("value"))
        le = F.concat(F.lit('le="'), F.col("le"), F.lit('"'))
        counts = counts.select(F.lit(f"{name}_bucket").alias("name"), F.when(F.col("of") == "", le).otherwise(F.concat_ws(",", "of", le)).alias("labels"), "value")
        sums = df.groupBy(label(**of).alias("labels") if of else F.lit("").alias("labels")).agg(F.round(F.coalesce(F.sum(value), F.lit(0.0)), 6).alias("value"))
        return counts.unionByName(sums.select(F.lit(f"{name}_sum").alias("name"), "labels", "value"))

    status, where = F.coalesce(F.col("status").cast("string"), F.lit("0")), F.col("domain")
    parts = [
        counted(fetches, "crawl_requests_total", status=status, domain=where),
        counted(fetches.where(F.col("error").isNotNull()), "crawl_errors_total", error_type=F.col("error"), domain=where),
        one(docs, "pages_indexed_total", F.count(F.when(F.col("is_indexed"), 1))),
        one(queue, "crawler_queue_size", F.count(F.when(F.col("status") == "pending", 1))),
        buckets(fetches, "crawl_latency_seconds", F.col("latency_s"), FETCH_BOUNDS, domain=where),
        one(searches, "search_requests_total", F.count("*")),
        buckets(searches, "search_latency_seconds", F.col("latency_ms") / 1000.0, [b / 1000 for b in LATENCY_BOUNDS]),
        counted(cache.where("hit"), "cache_hits_total", cache_type=F.col("cache_type")),
        counted(cache.where("not hit"), "cache_misses_total", cache_type=F.col("cache_type")),
        workers.groupBy(label(worker_type=F.col("worker_type")).alias("labels")).agg(F.sum(F.col("active").cast("double")).alias("value")).select(F.lit("active_workers").alias("name"), "labels", "value"),
    ]
    return reduce(DataFrame.unionByName, parts)


def exposition(values: DataFrame) -> DataFrame:
    """(line) of each metric in the text form that scrapers read."""
    labels = F.when(F.col("labels") == "", "").otherwise(F.concat(F.lit("{"), "labels", F.lit("}")))
    return values.select(F.concat("name", labels, F.lit(" "), F.col("value").cast("string")).alias("line"))


def activity(events: DataFrame, k: int = 50, keep: int = 100) -> DataFrame:
    """The last ``k`` crawl events (url, domain, title, status, at and more), newest first; ``keep`` are remembered."""
    return events.orderBy(F.desc("at"), "url").limit(min(k, keep))


def cache_key(query: str, page: int, limit: int, safe_search: bool) -> str:
    """A result's key; the safe-search switch is part of it."""
    return f"search:{query.strip().lower()}:{page}:{limit}:{int(safe_search)}"
