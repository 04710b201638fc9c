"""The crawl as rounds over tables: dispatch, fetch, parse, merge, discover, mark."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.config import Settings
from lanternfish.functions.hashing import sha256, simhash
from lanternfish.functions.urls import domain
from lanternfish.operators import frontier
from lanternfish.session import cut
from lanternfish.sources import catalog, fetch, html, robots

#: Fixed value: why a URL that robots.txt forbids has failed.
FORBIDDEN = "ROBOTS_TXT_DISALLOWED"


@dataclass(frozen=True)
class State:
    """The tables of a crawl, as ``catalog`` names them, and the rules of each domain (domain, rules)."""

    queue: DataFrame
    documents: DataFrame
    links: DataFrame
    images: DataFrame
    news: DataFrame
    events: DataFrame
    rules: DataFrame | None = None

    @staticmethod
    def new(spark: SparkSession, rules: DataFrame | None = None) -> State:
        names = ("crawl_queue", "documents", "page_links", "image_documents", "news_articles", "crawl_events")
        return State(*(catalog.empty(spark, n) for n in names), rules)


def queued(queue: DataFrame, admitted: DataFrame, now: Column) -> DataFrame:
    """The queue with admitted URLs (url, domain, priority, depth, and referrer_url if known) added, pending."""
    fresh = admitted.select(*admitted.columns, F.lit(0).alias("retry_count"), F.lit("pending").alias("status"), now.alias("discovered_at"))
    types = dict(queue.dtypes)
    return queue.unionByName(fresh.select(*((F.col(c) if c in fresh.columns else F.lit(None)).cast(types[c]).alias(c) for c in queue.columns)))


def seeded(state: State, seeds: DataFrame, now: Column, settings: Settings = Settings()) -> State:
    """The state with the lines of a seed file (value) in the queue."""
    return replace(state, queue=cut(queued(state.queue, frontier.admit(frontier.seeds(seeds), state.queue, settings), now), "queue"))


def with_rules(state: State, urls: DataFrame, fetch_pages: Callable[[Iterator], Iterator]) -> State:
    """The state with the rules of the domains of ``urls`` (url, domain) that it has none of, as robots.txt gives them."""
    spark = urls.sparkSession
    known = state.rules if state.rules is not None else spark.createDataFrame([], "domain string, rules string")
    site = F.concat(F.regexp_extract("url", r"(?i)^(https?://[^/?#]*)", 1), F.lit("/robots.txt"))
    wanted = cut(urls.join(known, "domain", "left_anti").groupBy("domain").agg(F.min(site).alias("url")), "sites")
    found = fetch.fetched(wanted, fetch_pages).select("url", robots.effective(F.coalesce("status", F.lit(0)), F.col("body")).alias("rules"))
    fresh = wanted.join(found, "url", "left").select("domain", F.coalesce("rules", F.lit("")).alias("rules"))
    return replace(state, rules=cut(known.unionByName(fresh), "rules"))


def step(state: State, fetch_pages: Callable[[Iterator], Iterator], now: Column, limit: int | None = None, settings: Settings = Settings(), ask_robots: bool = False) -> State:
    """One round: the next URLs of each domain are fetched and everything they tell is merged in.

    With ``ask_robots`` the rules of domains not met before are fetched first.
    The URLs of a domain go to one task, whose client can keep them apart.
    """
    picked = frontier.dispatch(state.queue, limit, settings=settings).select("url", "domain")
    picked = cut(picked.join(state.queue.select("url", "depth"), "url"), "dispatched")
    if ask_robots:
        state = with_rules(state, picked.select("url", "domain"), fetch_pages)
    if state.rules is not None:
        picked = picked.join(state.rules.select("domain", "rules"), "domain", "left")
        picked = picked.withColumn("allowed", robots.allowed(F.coalesce("rules", F.lit("")), F.col("url"), F.lit(robots.USER_AGENT))).drop("rules")
    else:
        picked = picked.withColumn("allowed", F.lit(True))
    picked = cut(picked, "picked")
    answers = cut(fetch.classified(fetch.fetched(picked.where("allowed").repartition("domain"), fetch_pages)), "answers")
    good = answers.where("outcome = 'ok'").select(F.xxhash64("url").alias("page_id"), "url", F.col("body").alias("html"))
    pages = html.parse(good).join(good.select("page_id", F.col("url").alias("asked")), "page_id").join(picked.select(F.col("url").alias("asked"), "depth"), "asked")
    pages = cut(pages.withColumn("target", F.coalesce("canonical_url", "url")), "pages")

    shown = pages.where("not noindex")
    body = F.coalesce(F.nullif("main_text", F.lit("")), "title")
    hashes = simhash(shown.select("page_id", body.alias("body")), "page_id", "body").withColumnRenamed("doc_id", "page_id")
    new = shown.join(hashes, "page_id").select(
        F.col("target").alias("url"), "canonical_url", domain(F.col("asked")).alias("domain"), "title", "description", F.col("main_text").alias("content"),
        "language", "word_count", sha256(body).alias("content_hash"), "simhash", F.lit("text/html").alias("mime_type"),
    )
    documents = cut(catalog.upsert_documents(state.documents, new, now), "documents")
    ids = documents.select("doc_id", F.col("url").alias("target"))
    told = shown.join(ids, "target").drop("page_id").withColumnRenamed("doc_id", "page_id")
    images = html.images(told, settings.images_per_page)
    found = html.page_links(told.withColumn("url", F.col("target"))).withColumn("created_at", now)

    # What became of each URL.
    why = F.coalesce("error", F.when(F.col("outcome") == "http_error", F.concat(F.lit("HTTP_"), "status")), "outcome")
    fate = answers.select("url", (F.col("outcome") == "ok").alias("ok"), F.when(F.col("outcome") != "ok", why).alias("error"))
    barred = picked.join(answers.select("url"), "url", "left_anti").select("url", F.lit(False).alias("ok"), F.when(F.col("allowed"), "unsafe").otherwise(FORBIDDEN).alias("error"))
    fate = fate.unionByName(barred)
    outgoing = shown.select(domain(F.col("asked")).alias("source_domain"), "depth", F.inline("links")).select("source_domain", "depth", F.col("url").alias("target_url"))
    queue = frontier.mark(state.queue, fate.withColumn("at", now))
    queue = queued(queue, frontier.admit(frontier.discovered(outgoing, settings), queue, settings), now)
    seen = shown.select(F.col("asked").alias("url"), F.col("title").alias("page_title"), F.col("word_count").alias("words"), F.size("links").alias("links_count"))
    events = fate.join(seen, "url", "left").join(answers.select("url", "status"), "url", "left").select(
        "url", domain(F.col("url")).alias("domain"), F.coalesce(F.nullif("page_title", F.lit("")), "url").alias("title"), F.when(F.col("ok"), "success").otherwise("failed").alias("status"),
        F.coalesce("status", F.lit(0)).cast("int").alias("status_code"), F.col("words").alias("word_count"), F.col("links_count").cast("int").alias("links_count"), "error", now.alias("at"),
    )
    return State(
        cut(queue, "queue"), documents, cut(catalog.upsert_links(state.links, found.select(*state.links.columns)), "links"),
        cut(state.images.unionByName(catalog.shaped(images, "image_documents")), "images"),
        cut(state.news.unionByName(catalog.shaped(html.news(told).withColumn("published_date", F.coalesce("published_date", now)), "news_articles")), "news"),
        cut(state.events.unionByName(catalog.shaped(events, "crawl_events")), "events"), state.rules,
    )


def crawl(state: State, fetch_pages: Callable[[Iterator], Iterator], now: Column, most_documents: int = 10_000, most_rounds: int = 1000, settings: Settings = Settings(), limit: int | None = None, ask_robots: bool = False) -> State:
    """Rounds until nothing is pending, or as many documents as asked for are there.

    No more URLs are dispatched in a round than documents are still wanted.  A
    state may be kept and taken up again, which is pause and resume.
    """
    for _ in range(most_rounds):
        wanted = most_documents - state.documents.count()
        if wanted <= 0 or state.queue.where("status = 'pending'").isEmpty():
            break
        state = step(state, fetch_pages, now, min(wanted, limit or wanted), settings, ask_robots)
    return state
