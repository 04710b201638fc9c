"""The engine's queries over the standard tables, one for each operator or group of them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.config import Settings
from lanternfish.functions import hashing, quality, snippets, text, urls
from lanternfish.operators import evaluate, frontier, graph, index, media, search, stats
from lanternfish.operators.query import parse
from lanternfish.operators.search import SearchOptions
from lanternfish.session import scratch_path
from lanternfish.sources import corpus, fetch, html, robots
from lanternfish.streaming import jobs

AS_OF = "2026-01-01 00:00:00"
#: Searches used by several queries.
PLAIN = "licensed apache rights"
PHRASED = '"general public license" version'
JUDGED = {"rights": "rights reserved", "apache": "apache license", "released": "released mit"}


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return corpus.table(spark, d, "documents")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return corpus.as_documents(_documents(spark, d))


def _indexed(docs: DataFrame, terms=None) -> index.Index:
    whole = index.combined_text(F.col("title"), F.col("description"), F.col("content"))
    return index.build(docs.select("doc_id", whole.alias("text")), terms=terms)


def _search(spark: SparkSession, d: str, query: str, options: SearchOptions = SearchOptions(), docs: DataFrame | None = None) -> DataFrame:
    docs = _docs(spark, d) if docs is None else docs
    q = parse(query)
    return search.ranked(_indexed(docs, {*q.positive_terms, *q.negative_terms}), docs, q, options)


def tokenize_terms(spark, d):
    return text.token_rows(_documents(spark, d)).groupBy("raw").agg(F.count("*").alias("n"))


def stem_terms(spark, d):
    words = text.token_rows(_documents(spark, d)).select("raw").distinct()
    return text.with_stem(words, "raw", "term").select("raw", "term")


def raw_tokens_stopworded(spark, d):
    rows = index.term_rows(_documents(spark, d), remove_stopwords=True)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("pos").cast("long").alias("last_pos"))


def word_count(spark, d):
    return _documents(spark, d).select("doc_id", text.word_count(F.col("text")).alias("n_words"), F.length(text.collapsed(F.col("text"))).cast("long").alias("n_chars"))


def postings(spark, d):
    rows = index.build(_documents(spark, d)).postings
    return rows.select("term", "doc_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def term_stats(spark, d):
    return index.build(_documents(spark, d)).term_stats


def doc_stats(spark, d):
    return index.build(_documents(spark, d)).doc_stats


def corpus_stats(spark, d):
    return index.build(_documents(spark, d)).corpus_stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def remove_document(spark, d):
    docs = _documents(spark, d)
    return index.build(docs).without(docs.where("lang = 'de'").select("doc_id")).term_stats


def replace_document(spark, d):
    docs = _documents(spark, d)
    changed = docs.where("lang = 'fr'").select("doc_id", F.lit("one new text for all of these").alias("text"))
    return index.build(docs).with_documents(index.build(changed)).term_stats


def index_incremental(spark, d):
    """Segments: all documents, then those of one language changed, then those of another removed."""
    docs, path = _documents(spark, d), scratch_path(spark, "index")
    index.build(docs).append(path, 0)
    changed = docs.where("lang = 'fr'").select("doc_id", F.lit("one new text for all of these").alias("text"))
    index.build(changed).append(path, 1)
    index.Index.remove(path, 2, docs.where("lang = 'de'"))
    return index.Index.read(spark, path).term_stats


def index_stream_search(spark, d):
    """A search over what the indexing loop has written."""
    path = scratch_path(spark, "index")
    jobs.index_loop(jobs.source(spark, f"{d}/documents.parquet"), path, scratch_path(spark, "index-state")).awaitTermination()
    terms = parse(PLAIN).positive_terms
    scored = search.bm25_scores(index.Index.read(spark, path), terms)
    return scored.select("doc_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(10)


def vocab_prefix_topk(spark, d):
    return index.vocabulary_prefix(index.build(_documents(spark, d)), "li", 10)


def bm25_top10(spark, d):
    docs = _docs(spark, d)
    terms = parse(PLAIN).positive_terms
    scored = search.bm25_scores(_indexed(docs, terms), terms)
    return scored.select("doc_id", F.round("bm25", 6).alias("bm25")).orderBy(F.desc("bm25"), "doc_id").limit(10)


def search_default(spark, d):
    return _search(spark, d, PLAIN)


def search_negation(spark, d):
    return _search(spark, d, "rights license -apache -gnu")


def search_site(spark, d):
    return _search(spark, d, "license site:src1")


def search_intitle(spark, d):
    return _search(spark, d, "license version intitle:the")


def search_inurl(spark, d):
    return _search(spark, d, "license inurl:/en/")


def search_date_range(spark, d):
    return _search(spark, d, "license after:2025-03-01 before:2025-09-30")


def search_filetype(spark, d):
    docs = _docs(spark, d)
    named = docs.withColumn("url", F.concat("url", F.when(F.col("doc_id") % 4 == 0, "/paper.pdf").otherwise("/index.html")))
    return _search(spark, d, "license filetype:pdf", SearchOptions(use_filetype=True), named)


def _spam_docs(spark, d):
    documents = _documents(spark, d)
    share = quality.top_share(documents).select("doc_id", "share")
    docs = corpus.as_documents(documents).join(share, "doc_id", "left")
    words = text.word_count(F.col("content"))
    return docs.withColumn("spam_score", quality.spam(words, F.col("share"), F.col("title"))).withColumn("quality_score", quality.quality(F.col("url"), words, F.col("title")))


def search_safe(spark, d):
    strict = SearchOptions(settings=replace(Settings(), safe_search_limit=0.3))
    return _search(spark, d, "license rights", strict, _spam_docs(spark, d))


def search_phrase_bonus(spark, d):
    return _search(spark, d, PHRASED)


def search_phrase_strict(spark, d):
    return _search(spark, d, PHRASED, SearchOptions(strict_phrases=True))


def search_or(spark, d):
    return _search(spark, d, "apache OR gnu")


def search_page2(spark, d):
    return _search(spark, d, PLAIN, SearchOptions(page=2))


def search_total(spark, d):
    docs = _docs(spark, d)
    return search.total_matches(_indexed(docs, parse(PLAIN).positive_terms), docs, PLAIN)


def search_empty(spark, d):
    return _search(spark, d, "site:src1 -apache")


def search_results(spark, d):
    docs = _docs(spark, d)
    return search.search(_indexed(docs, parse(PHRASED).positive_terms), docs, PHRASED)


def search_response(spark, d):
    docs = _docs(spark, d)
    one = search.response(_indexed(docs, parse(PLAIN).positive_terms), docs, PLAIN)
    rows = one.select("query", "total", "page", "limit", F.inline("results"))
    signals = [F.round(F.col("breakdown")[c], 6).alias(c) for c in ("bm25", "phrase", "pagerank", "freshness")]
    return rows.select("query", "total", "page", "limit", "place", "doc_id", "title", "display_url", "score", *signals)


def search_batch_topk(spark, d):
    docs = _docs(spark, d)
    terms = {t for q in JUDGED.values() for t in parse(q).positive_terms}
    return search.batch_top(_indexed(docs, terms), JUDGED, 10)


def phrase_counts(spark, d):
    docs = _documents(spark, d)
    phrase = ("the", "the")
    return index.phrase_counts(index.build(docs, terms=phrase), phrase)


def score_breakdown(spark, d):
    docs = _docs(spark, d)
    q = parse(PHRASED)
    rows = search.signals(_indexed(docs, q.positive_terms), docs, q)
    return rows.select("doc_id", *(F.round(c, 6).alias(c) for c in ("bm25", "title", "phrase", "pagerank", "freshness", "quality", "spam")))


def ltr_score(spark, d):
    docs = _spam_docs(spark, d)
    terms = parse(PLAIN).positive_terms
    scored = search.bm25_scores(_indexed(docs, terms), terms).join(docs, "doc_id")
    score = quality.ltr_score(F.col("bm25"), F.col("page_rank"), F.col("quality_score"), F.col("spam_score"), text.word_count(F.col("content")))
    return scored.select("doc_id", F.round(score, 6).alias("score"))


def snippet(spark, d):
    return _documents(spark, d).select("doc_id", snippets.snippet(F.col("text"), ["the", "license", "reserved"], ["all rights"]).alias("snippet"))


def highlight(spark, d):
    return _documents(spark, d).select("doc_id", F.sha2(snippets.highlighted(F.col("text"), ["license", "rights"], ["public license"]).cast("binary"), 256).alias("marked"))


def suggest(spark, d):
    found = index.build(_documents(spark, d))
    return stats.suggest(found, corpus.as_search_log(corpus.table(spark, d, "events")), "c", 8)


def popular_queries(spark, d):
    return stats.popular_queries(corpus.as_search_log(corpus.table(spark, d, "events")), "", 8)


def recent_searches(spark, d):
    return stats.recent_searches(corpus.as_search_log(corpus.table(spark, d, "events"))).select("event_id", "query", "ts")


def top_domains(spark, d):
    return stats.top_domains(corpus.table(spark, d, "pages").select(urls.domain(F.col("url")).alias("domain")))


def corpus_overview(spark, d):
    docs = _documents(spark, d)
    pages = corpus.table(spark, d, "pages")
    log = corpus.as_search_log(corpus.table(spark, d, "events"))
    links = pages.select(F.explode(html.hrefs_of(F.col("html"))))
    return stats.corpus_overview(index.build(docs), docs, log, corpus.as_queue(pages), links)


def health(spark, d):
    return stats.health(index.build(_documents(spark, d)))


def latency_histogram(spark, d):
    log = corpus.as_search_log(corpus.table(spark, d, "events"))
    return stats.histogram(log, F.col("latency_ms"), ["query"])


def log_redaction_json(spark, d):
    events = corpus.table(spark, d, "events")
    fields = F.create_map(F.lit("event"), F.col("event_type"), F.lit("api_key"), F.col("props"), F.lit("user"), F.col("user_id").cast("string"))
    return events.select("event_id", F.to_json(stats.redacted(fields)).alias("line"))


def url_normalize(spark, d):
    return corpus.table(spark, d, "pages").select("page_id", urls.normalized(F.col("url")).alias("url"))


def url_domain(spark, d):
    return corpus.table(spark, d, "pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


def display_url(spark, d):
    return corpus.table(spark, d, "pages").select("page_id", urls.display(F.col("url")).alias("display_url"))


def url_safety(spark, d):
    return corpus.table(spark, d, "pages").select("page_id", urls.safe_to_fetch(F.col("url")).alias("safe"))


def content_sha256(spark, d):
    return _documents(spark, d).select("doc_id", hashing.sha256(F.col("text")).alias("content_hash"))


def exact_duplicates(spark, d):
    return hashing.exact_duplicates(_documents(spark, d))


def simhash64(spark, d):
    return hashing.simhash(_documents(spark, d)).select("doc_id", hashing.unsigned(F.col("simhash")).alias("simhash"))


def near_duplicates(spark, d):
    return hashing.near_pairs(hashing.simhash(_documents(spark, d)), 3)


def page_title_lang(spark, d):
    return corpus.table(spark, d, "pages").select("page_id", html.title_of(F.col("html")).alias("title"), html.language_of(F.col("html")).alias("language"))


def page_hrefs(spark, d):
    return corpus.table(spark, d, "pages").select("page_id", F.posexplode(html.hrefs_of(F.col("html"))).alias("pos", "href"))


def link_first_use(spark, d):
    return index.first_of(["page_id", "href"], [F.col("pos")], page_hrefs(spark, d)).select("page_id", "href", "pos")


def page_main_text(spark, d):
    return html.parse(corpus.table(spark, d, "pages")).select("page_id", "main_text", "word_count")


def page_parse_full(spark, d):
    return html.parse(corpus.table(spark, d, "pages"))


def page_fields(spark, d):
    """What a page's head and images tell; tags are put into the pages by rule, as the plain ones have none."""
    pages = corpus.table(spark, d, "pages")
    n = F.col("page_id").cast("string")
    head = F.concat(
        F.lit('<meta name="description" content=" About '), n, F.lit(' "><meta name="author" content="Writer '), n, F.lit('"><link href="https://canon.test/p'), n, F.lit('?utm_source=x#y" rel="canonical">'),
        F.when(F.col("page_id") % 3 == 0, '<meta content="2025-03-01T12:00:00Z" property="article:published_time">').otherwise(""),
        F.when(F.col("page_id") % 5 == 0, '<meta name="robots" content="NOINDEX, nofollow">').otherwise(""), F.lit("</head>"),
    )
    images = F.repeat(F.concat(F.lit('<img src="/i/'), n, F.lit('.png" alt=" pic " width="320px">')), 20)
    page = F.replace(F.replace(F.col("html"), F.lit("</head>"), head), F.lit("</article>"), F.concat(images, F.lit("</article>")))
    parsed = html.parse(pages.select("page_id", "url", page.alias("html")))
    shown = html.images(parsed).groupBy(F.col("doc_id").alias("page_id")).agg(F.count("*").alias("n_images"), F.min("image_url").alias("image_url"), F.max("width").alias("width"), F.max("alt_text").alias("alt_text"))
    told = html.news(parsed).select(F.col("doc_id").alias("page_id"), "publisher", "published_date")
    rows = parsed.select("page_id", "description", F.col("author"), "canonical_url", "noindex", "nofollow", F.size("links").alias("n_links")).join(shown, "page_id", "left").join(told, "page_id", "left")
    return rows.withColumn("n_links", F.when(F.col("nofollow"), F.col("n_links")))


def page_link_targets(spark, d):
    return page_link_table(spark, d).select("source_url", "target_url")


def page_link_table(spark, d):
    return html.page_links(html.parse(corpus.table(spark, d, "pages")))


def pagerank(spark, d):
    ranks = graph.pagerank(*corpus.trade_graph(spark, d))
    return ranks.select("node", F.round("rank", 6).alias("rank"))


def pagerank_documents(spark, d):
    """Ranks written back to the documents; here suppliers link to nations, and those to regions."""
    nodes, edges = corpus.trade_graph(spark, d)
    docs = nodes.where(~F.col("node").startswith("p")).distinct().select(F.col("node").alias("url"), F.lit(1.0).alias("page_rank"))
    links = edges.where(~F.col("src").startswith("p")).select(F.col("src").alias("source_url"), F.col("dst").alias("target_url"))
    return graph.with_pagerank(docs, links)


def graph_degrees(spark, d):
    return graph.degrees(*corpus.trade_graph(spark, d))


def freshness(spark, d):
    docs = _docs(spark, d)
    return docs.select("doc_id", F.round(quality.freshness(F.col("published_at"), F.lit(AS_OF).cast("timestamp")), 6).alias("freshness"))


def quality_score(spark, d):
    docs = _docs(spark, d)
    return docs.select("doc_id", F.round(quality.quality(F.col("url"), text.word_count(F.col("content")), F.col("title")), 6).alias("quality"))


def spam_score(spark, d):
    return _spam_docs(spark, d).select("doc_id", F.round("spam_score", 6).alias("spam"))


def frontier_admit(spark, d):
    queue = corpus.as_queue(corpus.table(spark, d, "pages"))
    return frontier.admit(queue, queue.where(F.col("url").contains("/fr/")), denied=["spam", "pills"])


def frontier_dispatch(spark, d):
    queue = index.first_of(["url"], [F.desc("priority"), F.col("discovered_at")], corpus.as_queue(corpus.table(spark, d, "pages")))
    return frontier.dispatch(queue)


def frontier_schedule(spark, d):
    queue = index.first_of(["url"], [F.desc("priority"), F.col("discovered_at")], corpus.as_queue(corpus.table(spark, d, "pages")))
    return frontier.earliest_start(queue)


def link_priorities(spark, d):
    return corpus.table(spark, d, "pages").select("page_id", frontier.link_priority(F.lit("example.org"), F.col("url")).alias("priority"))


def next_crawl(spark, d):
    docs = _docs(spark, d)
    score = quality.quality(F.col("url"), text.word_count(F.col("content")), F.col("title"))
    count = (F.col("doc_id") % 9 + 1).cast("int")
    return docs.select("doc_id", frontier.next_crawl_hours(count, F.col("language") == "es", score).cast("int").alias("hours"))


def recrawl_due(spark, d):
    docs = _docs(spark, d).withColumn("next_crawl", F.col("published_at"))
    return frontier.due(docs, F.lit("2025-12-01 00:00:00").cast("timestamp"))


def recrawl_requeue(spark, d):
    docs = _docs(spark, d).withColumn("next_crawl", F.col("published_at"))
    queue, _ = frontier.reschedule(corpus.as_queue(corpus.table(spark, d, "pages")), docs, F.lit("2025-12-01 00:00:00").cast("timestamp"))
    return queue.select("url", "domain", "priority", "depth", "status")


def image_search(spark, d):
    docs = _docs(spark, d)
    images = docs.select("doc_id", F.concat("url", F.lit("/1.png")).alias("image_url"), F.col("title").alias("alt_text"), F.lit(None).cast("string").alias("title"), F.lit("").alias("surrounding_text"))
    return media.image_search(images, " The ").select("doc_id", "image_url", "alt_text")


def news_search(spark, d):
    docs = _docs(spark, d)
    news = docs.select("doc_id", F.col("title").alias("headline"), F.col("domain").alias("publisher"), F.lit(None).cast("string").alias("author"), F.col("published_at").alias("published_date"))
    return media.news_search(news, docs, "Rights Reserved")


def document_lookup(spark, d):
    return media.document(_docs(spark, d), 7).select("doc_id", "url", "domain", "title", "language", "published_at")


def _judged(spark, d):
    """(results, judgments): domains that speak for a query, graded."""
    docs = _docs(spark, d)
    found = search_batch_topk(spark, d).join(docs.select("doc_id", "url"), "doc_id").select(F.col("query_id").alias("query"), "rank", "url")
    rows = [("rights", "/en/", 3), ("rights", "src1", 2), ("apache", "/de/", 3), ("apache", "src2", 2), ("released", "/fr/", 2), ("none", "x", 3)]
    return found, spark.createDataFrame(rows, "query string, pattern string, grade int")


def _rounded(df, *names):
    return df.select(*(F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns))


def eval_queries(spark, d):
    return _rounded(evaluate.per_query(*_judged(spark, d), 5), "precision", "reciprocal_rank", "ndcg", "recall")


def eval_summary(spark, d):
    rows = evaluate.summary(*_judged(spark, d), 5)
    return _rounded(rows, *rows.columns)


def robots_rules(spark, d):
    pages = corpus.table(spark, d, "pages")
    body = F.concat(F.lit("User-agent: *\nDisallow: /fr/\nCrawl-delay: "), F.col("page_id") % 4, F.lit("\nSitemap: https://example.org/map.xml\n"))
    rules = robots.effective(F.when(F.col("url").contains("spam"), 403).otherwise(200), body)
    return pages.select("page_id", robots.allowed(rules, F.col("url"), F.lit(robots.USER_AGENT)).alias("allowed"), robots.crawl_delay(rules).alias("crawl_delay"), F.size(robots.sitemaps(rules)).alias("sitemaps"))


def fetch_outcomes(spark, d):
    pages = corpus.table(spark, d, "pages")
    responses = pages.select(
        "page_id", "url", F.when(F.col("url").contains("spam"), 404).otherwise(200).alias("status"),
        F.when(F.col("url").endswith(".html"), "text/html; charset=utf-8").when(F.col("url").endswith("/"), "image/png").otherwise("text/plain").alias("content_type"),
        F.col("html").alias("body"), F.when(F.col("url").contains("pills"), "timeout").alias("error"), F.lit(2).alias("attempt"),
    )
    return fetch.classified(responses).select("page_id", "outcome", "retry_after_s")


def result_cache(spark, d):
    log = corpus.as_search_log(corpus.table(spark, d, "events"))
    entries = log.select(F.col("event_id").alias("key"), F.col("query").alias("value"), (F.col("ts") + F.expr("interval 1 hour")).alias("expires_at"), F.col("ts").alias("inserted_at"))
    return stats.cached_results(entries, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("key", "value")


def cache_eviction(spark, d):
    log = corpus.as_search_log(corpus.table(spark, d, "events"))
    entries = log.select(F.col("event_id").alias("key"), F.col("query").alias("value"), (F.col("ts") + F.expr("interval 1 day")).alias("expires_at"), F.col("ts").alias("inserted_at"))
    return stats.cached_results(entries, F.lit("2024-01-05 00:00:00").cast("timestamp"), 1000).select("key", "value")


def engine_metrics(spark, d):
    events = corpus.table(spark, d, "events")
    fetches = events.select(
        F.col("event_type").alias("domain"), F.when(F.col("event_id") % 5 == 0, 404).otherwise(200).alias("status"),
        F.when(F.col("event_id") % 7 == 0, "timeout").alias("error"), (F.col("value") / 100).alias("latency_s"),
    )
    queue = corpus.as_queue(corpus.table(spark, d, "pages"))
    docs = _documents(spark, d).select((F.col("lang") == "en").alias("is_indexed"))
    cache = events.select(F.lit("search").alias("cache_type"), (F.col("event_id") % 3 == 0).alias("hit"))
    workers = spark.createDataFrame([("crawler", 5), ("indexer", 1)], "worker_type string, active int")
    return stats.metrics(fetches, corpus.as_search_log(events), docs, queue, cache, workers).withColumn("value", F.round("value", 2))


def crawl_activity(spark, d):
    pages = corpus.table(spark, d, "pages")
    events = pages.select("page_id", "url", F.when(F.col("page_id") % 6 == 0, "failed").otherwise("success").alias("status"), F.timestamp_add("SECOND", F.col("page_id").cast("int"), F.lit("2025-01-01 00:00:00").cast("timestamp")).alias("at"))
    return stats.activity(events).select("page_id", "status")


def stream_index_counts(spark, d):
    docs = jobs.source(spark, f"{d}/documents.parquet")
    terms = index.term_rows(docs).groupBy("term").agg(F.count("*").alias("total_occurrences"))
    return jobs.drained(terms, "stream_index_counts")


def query_log_windows(spark, d):
    log = corpus.as_search_log(jobs.source(spark, f"{d}/events.parquet"))
    return jobs.drained(jobs.query_windows(log), "query_log_windows")


def queries() -> dict:
    """Name to callable, for all of the above."""
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and n[0] != "_" and n != "queries"}
