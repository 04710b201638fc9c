"""The crawl frontier as tables: admission, dispatch, status, and when to come back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.config import Settings
from lanternfish.functions.urls import domain, normalized
from lanternfish.session import cut


def admit(candidates: DataFrame, seen: DataFrame, settings: Settings = Settings(), allowed: list[str] | None = None, denied: list[str] | None = None) -> DataFrame:
    """(url, domain, priority, depth) of the candidates (url, priority, depth) to enqueue.

    URLs are normalised.  Dropped are those without a domain, too deep, of a
    domain not allowed or denied (by substring), and those seen.  Of repeats the
    highest priority, then the least depth, stays.
    """
    url = normalized(F.col("url"))
    rows = candidates.select(url.alias("url"), domain(url).alias("domain"), "priority", "depth")
    rows = rows.where((F.col("domain") != "") & (F.col("depth") <= settings.max_depth))
    for names, keep in ((allowed, True), (denied, False)):
        if names:
            hit = F.exists(F.array(*map(F.lit, names)), lambda n: F.col("domain").contains(n))
            rows = rows.where(hit if keep else ~hit)
    rows = rows.join(seen.select(normalized(F.col("url")).alias("url")).distinct(), "url", "left_anti")
    best = F.max_by(F.struct("domain", "priority", "depth"), F.struct("priority", -F.col("depth")))
    return rows.groupBy("url").agg(best.alias("b")).select("url", "b.domain", "b.priority", "b.depth")


def dispatch(queue: DataFrame, limit: int | None = None, active: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """(url, domain, place): the next URLs, by priority and age, a few per domain at once.

    ``queue`` has url, domain, priority, discovered_at and status; ``active``
    the URLs of each domain in progress (domain, n).
    """
    order = [F.desc("priority"), F.col("discovered_at"), F.col("url")]
    place = F.row_number().over(Window.partitionBy("domain").orderBy(*order))
    # Never more than a few of a domain: Spark keeps only those before it deals the rows out.
    waiting = queue.where("status = 'pending'").withColumn("place", place).where(F.col("place") <= settings.per_domain)
    if active is not None:
        waiting = waiting.join(active.select("domain", F.col("n").alias("busy")), "domain", "left")
    busy = F.coalesce(F.col("busy"), F.lit(0)) if active is not None else F.lit(0)
    ready = waiting.where(F.col("place") + busy <= settings.per_domain).select("url", "domain", "priority", "discovered_at", "place")
    if limit is not None:
        ready = ready.orderBy(*order).limit(limit)
    return ready.select("url", "domain", "place")


def earliest_start(queue: DataFrame, delays: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """(url, domain, wait_s): seconds to wait so that requests of one domain keep their distance."""
    rows = numbered(queue, ["domain"], [F.desc("priority"), F.col("discovered_at"), F.col("url")], "place")
    delay = F.lit(settings.crawl_delay)
    if delays is not None:
        rows = rows.join(delays.select("domain", "crawl_delay"), "domain", "left")
        delay = F.greatest(F.coalesce("crawl_delay", delay), delay)
    return rows.select("url", "domain", ((F.col("place") - 1) * delay).alias("wait_s"))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with their numbers, from 1, among those of equal keys in the given order.

    Rows are dealt by ranges of keys and order, so a key with very many takes
    many tasks; each range's rows start where the ranges before it end.
    """
    ranged = cut(rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__range").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys), F.col("__range") == F.col("__at"))
    own = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order))
    return ranged.withColumn("__own", own).join(counts, same).select(*rows.columns, (F.col("__own") + F.col("__before")).alias(name))


def link_priority(source_domain: Column, target: Column) -> Column:
    """60 for links that name their own domain, 40 for others."""
    return F.when(target.contains(source_domain), 60).otherwise(40)


def discovered(links: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Candidates (url, priority, depth) from links (source_domain, target_url, depth of the page)."""
    rows = links.select(F.col("target_url").alias("url"), link_priority(F.col("source_domain"), F.col("target_url")).alias("priority"), (F.col("depth") + 1).alias("depth"))
    return rows.where(F.col("depth") <= settings.max_depth)


def seeds(urls: DataFrame, priority: int = 100) -> DataFrame:
    """Candidates from lines of a seed file (value): no blank lines, none that start with #."""
    line = F.trim("value")
    return urls.where((line != "") & ~F.col("value").startswith("#")).select(line.alias("url"), F.lit(priority).alias("priority"), F.lit(0).alias("depth"))


def mark(queue: DataFrame, results: DataFrame) -> DataFrame:
    """The queue after results (url, ok, error, at): completed, or failed with its message."""
    r = results.select("url", F.col("ok").alias("__ok"), F.col("error").alias("__error"), F.col("at").alias("__at"))
    rows = queue.join(r, "url", "left")
    status = F.when(F.col("__ok").isNull(), F.col("status")).when(F.col("__ok"), "completed").otherwise("failed")
    changed = {"status": status, "error_message": F.when(F.col("__ok") == F.lit(False), F.substring("__error", 1, 500)).otherwise(F.col("error_message")), "last_attempt": F.coalesce("__at", "last_attempt")}
    return rows.select(*(changed.get(c, F.col(c)).alias(c) for c in queue.columns))


def next_crawl_hours(crawl_count: Column, changed: Column, quality: Column) -> Column:
    """6 after a change, 24 the first time, 72 up to five visits, else 168; 30 % sooner for quality."""
    hours = F.when(changed, 6).when(crawl_count == 1, 24).when(crawl_count <= 5, 72).otherwise(168)
    return F.when(quality > 1.2, F.greatest(F.lit(4), F.floor(hours * 0.7).cast("int"))).otherwise(hours)


def due(docs: DataFrame, now: Column, limit: int = 200) -> DataFrame:
    """(url, priority, next_crawl) of the documents due again, the longest overdue first."""
    priority = F.least(F.lit(90), F.greatest(F.lit(20), (F.col("page_rank") * 20).cast("int")))
    late = docs.where(F.col("next_crawl") <= now).orderBy("next_crawl", "url").limit(limit)
    return late.select("url", priority.alias("priority"), (now + F.expr("interval 3 days")).alias("next_crawl"))


def reschedule(queue: DataFrame, docs: DataFrame, now: Column, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """(queue, docs) after documents due again went back to the queue, to come up next in three days.

    They come in at depth 0, pending, with the priority their rank gives; a row
    of the queue with the same URL gives way.
    """
    again = cut(due(docs, now, limit), "due")
    fresh = again.select("url", domain(F.col("url")).alias("domain"), "priority", F.lit(0).alias("depth"), F.lit("pending").alias("status"), now.alias("discovered_at"))
    types = dict(queue.dtypes)
    added = fresh.select(*((F.col(c) if c in fresh.columns else F.lit(None)).cast(types[c]).alias(c) for c in queue.columns))
    later = docs.join(again.select("url", F.col("next_crawl").alias("__next")), "url", "left")
    moved = later.select(*(F.coalesce("__next", "next_crawl").alias(c) if c == "next_crawl" else F.col(c) for c in docs.columns))
    return queue.join(again, "url", "left_anti").select(*queue.columns).unionByName(added), moved


def released(active: DataFrame, done: DataFrame) -> DataFrame:
    """(domain, n): URLs in progress by domain after those in ``done`` (domain) are finished; none below 0."""
    gone = done.groupBy("domain").agg(F.count("*").alias("gone"))
    rows = active.join(gone, "domain", "left")
    return rows.select("domain", F.greatest(F.col("n") - F.coalesce("gone", F.lit(0)), F.lit(0)).cast("long").alias("n")).where("n > 0")
