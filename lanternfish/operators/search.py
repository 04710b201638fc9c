"""Ranked retrieval: BM25 and further signals over the index tables, for one query or many."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternfish.config import RankingWeights, Settings
from lanternfish.functions.quality import freshness
from lanternfish.functions.snippets import snippet
from lanternfish.functions.urls import display
from lanternfish.operators.index import Index, phrase_counts
from lanternfish.operators.query import ParsedQuery, parse
from lanternfish.session import cut


@dataclass(frozen=True)
class SearchOptions:
    """How to answer: page, page size, date that freshness is counted from, and switches."""

    page: int = 1
    limit: int = 10
    as_of: str = "2026-01-01 00:00:00"
    safe_search: bool = True
    strict_phrases: bool = False
    use_filetype: bool = False
    weights: RankingWeights = RankingWeights()
    settings: Settings = Settings()


def idf(df: Column, n: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(F.log(1.0 + (n - df + 0.5) / (df + 0.5)))


def bm25_scores(index: Index, terms: tuple[str, ...] | list[str], settings: Settings = Settings()) -> DataFrame:
    """(doc_id, bm25) of the documents with at least one of the terms.

    The document frequencies are those of the query's terms: one row a term.
    """
    found = index.of_terms(terms).select("term", "doc_id", "tf")
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    rows = found.join(F.broadcast(frequency), "term").join(index.doc_stats, "doc_id").crossJoin(F.broadcast(index.corpus_stats))
    k1, b = settings.k1, settings.b
    tf = F.col("tf").cast("double")
    norm = tf + k1 * (1.0 - b + b * F.col("doc_len") / F.col("avgdl"))
    gain = idf(F.col("df"), F.col("n")) * tf * (k1 + 1.0) / norm
    return rows.groupBy("doc_id").agg(F.sum(gain).alias("bm25"))


def filters(q: ParsedQuery, o: SearchOptions) -> Column:
    """The query's conditions on a document's own columns."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    seen = F.col("published_at")
    tests: list[Column] = [low(c).contains(v) for c, v in (("domain", q.site), ("title", q.intitle), ("url", q.inurl)) if v]
    tests += [seen.isNull() | (seen <= F.lit(q.before))] if q.before else []
    tests += [seen.isNull() | (seen >= F.lit(q.after))] if q.after else []
    tests += [F.coalesce(F.col("spam_score"), F.lit(0.0)) <= o.settings.safe_search_limit] if o.safe_search else []
    tests += [low("url").endswith("." + q.filetype)] if o.use_filetype and q.filetype else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def title_score(title: Column, terms: tuple[str, ...] | list[str]) -> Column:
    """Share of the terms that occur anywhere in the lower-case title, times 5."""
    if not terms:
        return F.lit(0.0)
    low = F.lower(F.coalesce(title, F.lit("")))
    return reduce(lambda a, b: a + b, (F.when(low.contains(t), 1).otherwise(0) for t in terms)) / float(len(terms)) * 5.0


def signals(index: Index, docs: DataFrame, q: ParsedQuery, o: SearchOptions = SearchOptions()) -> DataFrame:
    """(doc_id, bm25, title, phrase, pagerank, freshness, quality, spam) of all matching documents.

    ``docs`` has doc_id, url, domain, title, published_at, page_rank, spam_score
    and quality_score; its content is not read here.
    """
    matched = bm25_scores(index, q.positive_terms, o.settings)
    if q.negative_terms:
        matched = matched.join(index.of_terms(q.negative_terms).select("doc_id").distinct(), "doc_id", "left_anti")
    slim = docs.where(filters(q, o)).select("doc_id", F.col("title").alias("name"), "published_at", "page_rank", "spam_score", "quality_score")
    rows = matched.join(slim, "doc_id")
    bonus = F.lit(0.0)
    for k, phrase in enumerate(q.exact_phrases):
        hits = phrase_counts(index, phrase).select("doc_id", F.lit(4.0).alias(f"phrase{k}"))
        rows = rows.join(hits, "doc_id", "left_semi" if o.strict_phrases else "left")
        bonus = bonus + (F.lit(4.0) if o.strict_phrases else F.coalesce(F.col(f"phrase{k}"), F.lit(0.0)))
    as_of = F.lit(o.as_of).cast("timestamp")
    return rows.select(
        "doc_id", "bm25", title_score(F.col("name"), q.positive_terms).alias("title"), bonus.alias("phrase"),
        F.least(F.lit(5.0), F.coalesce("page_rank", F.lit(1.0))).alias("pagerank"),
        (freshness(F.col("published_at"), as_of) * 2.0).alias("freshness"),
        (F.coalesce("quality_score", F.lit(1.0)) * 2.0).alias("quality"),
        (F.coalesce("spam_score", F.lit(0.0)) * 10.0).alias("spam"),
    )


def composite(w: RankingWeights) -> Column:
    """The weighted sum of the signals, at least 0.01."""
    gains = (("bm25", w.bm25), ("title", w.title), ("phrase", w.phrase), ("pagerank", w.pagerank), ("freshness", w.freshness), ("quality", w.quality))
    total = reduce(lambda a, b: a + b, (F.lit(x) * F.col(c) for c, x in gains)) - F.lit(w.spam) * F.col("spam")
    return F.greatest(F.lit(0.01), total)


def ranked(index: Index, docs: DataFrame, query: str | ParsedQuery, o: SearchOptions = SearchOptions()) -> DataFrame:
    """One page of results: doc_id, score.  Scores equal to six digits are ordered by doc_id."""
    q = parse(query) if isinstance(query, str) else query
    if q.is_empty:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    scored = signals(index, docs, q, o).select("doc_id", F.round(composite(o.weights), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").offset((o.page - 1) * o.limit).limit(o.limit)


def total_matches(index: Index, docs: DataFrame, query: str | ParsedQuery, o: SearchOptions = SearchOptions()) -> DataFrame:
    """One row: how many documents a query matches on all pages."""
    q = parse(query) if isinstance(query, str) else query
    return (docs.limit(0) if q.is_empty else signals(index, docs, q, o)).agg(F.count("*").alias("total"))


def search(index: Index, docs: DataFrame, query: str, o: SearchOptions = SearchOptions()) -> DataFrame:
    """Result rows of one page, with title, URLs and snippet; content is joined for these rows only."""
    q = parse(query)
    page = ranked(index, docs, q, o)
    shown = docs.join(F.broadcast(page), "doc_id")
    text = F.coalesce(F.nullif("content", F.lit("")), "description")
    terms = q.raw_positive_terms or q.positive_terms
    return shown.select(
        "doc_id", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "url", display(F.col("url")).alias("display_url"),
        snippet(text, terms, q.raw_exact_phrases, o.settings.snippet_length).alias("snippet"), "score",
    ).orderBy(F.desc("score"), "doc_id")


def batch_top(index: Index, queries: dict[str, str], k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, doc_id, bm25): the ``k`` best documents of each of many queries at once."""
    spark = index.postings.sparkSession
    rows = [(name, t) for name, text in queries.items() for t in parse(text).positive_terms]
    asked = spark.createDataFrame(rows, "query_id string, term string")
    found = index.of_terms({t for _, t in rows}).select("term", "doc_id", "tf")
    frequency = found.groupBy("term").agg(F.count("*").alias("df"))
    weighed = found.join(F.broadcast(frequency), "term").join(index.doc_stats, "doc_id").crossJoin(F.broadcast(index.corpus_stats))
    tf = F.col("tf").cast("double")
    gain = idf(F.col("df"), F.col("n")) * tf * (settings.k1 + 1.0) / (tf + settings.k1 * (1.0 - settings.b + settings.b * F.col("doc_len") / F.col("avgdl")))
    scored = weighed.select("term", "doc_id", gain.alias("gain")).join(F.broadcast(asked), "term")
    scored = scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("gain"), 6).alias("bm25"))
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "bm25")


def response(index: Index, docs: DataFrame, query: str, o: SearchOptions = SearchOptions()) -> DataFrame:
    """One row: query, total, page, limit, took_ms, results and filters, each result with its signals.

    The matches are scored once and written out; total and page are read from there.
    """
    start = time.perf_counter()
    q = parse(query)
    scored = signals(index, docs, q, o) if not q.is_empty else signals(index, docs.limit(0), q, o)
    scored = cut(scored.withColumn("score", F.round(composite(o.weights), 6)), "scored")
    page = scored.orderBy(F.desc("score"), "doc_id").offset((o.page - 1) * o.limit).limit(o.limit)
    page = page.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    text = F.coalesce(F.nullif("content", F.lit("")), "description")
    terms = q.raw_positive_terms or q.positive_terms
    parts = F.struct("bm25", F.col("title_signal").alias("title"), "phrase", "pagerank", "freshness", "quality", "spam")
    shown = docs.join(F.broadcast(page.withColumnRenamed("title", "title_signal")), "doc_id")
    item = F.struct(
        "place", "doc_id", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "url", display(F.col("url")).alias("display_url"), "description",
        snippet(text, terms, q.raw_exact_phrases, o.settings.snippet_length).alias("snippet"), "score", "published_at", parts.alias("breakdown"),
    )
    results = shown.select(item.alias("r")).agg(F.sort_array(F.collect_list("r")).alias("results"))
    whole = cut(scored.agg(F.count("*").alias("total")).crossJoin(results), "response")
    took = (time.perf_counter() - start) * 1000
    filters_ = F.struct(F.lit(q.site).alias("site"), F.lit(q.intitle).alias("intitle"), F.lit(q.inurl).alias("inurl"), F.array(*map(F.lit, q.raw_exact_phrases)).cast("array<string>").alias("exact_phrases"))
    return whole.select(F.lit(query).alias("query"), "total", F.lit(o.page).alias("page"), F.lit(o.limit).alias("limit"), F.lit(took).alias("took_ms"), "results", filters_.alias("filters"))
