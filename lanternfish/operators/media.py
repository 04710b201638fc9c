"""Image and news search, and the look-up of one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def image_search(images: DataFrame, query: str, k: int = 20) -> DataFrame:
    """Images whose alt text, title or surroundings contain the query, whatever the case, by doc_id."""
    wanted = query.strip().lower()
    hit = F.lit(False)
    for c in ("alt_text", "title", "surrounding_text"):
        hit = hit | F.lower(F.coalesce(F.col(c), F.lit(""))).contains(wanted)
    return images.where(hit).orderBy("doc_id", "image_url").limit(k)


def news_search(news: DataFrame, docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """News whose headline or content contains the query, latest first, undated last."""
    wanted = query.strip().lower()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    rows = news.join(docs.select("doc_id", "url", "description", "content"), "doc_id").where(low("headline").contains(wanted) | low("content").contains(wanted))
    short = F.coalesce(F.nullif("description", F.lit("")), F.substring("content", 1, 200))
    return rows.select("doc_id", "headline", "url", "publisher", "author", "published_date", short.alias("snippet")).orderBy(F.desc_nulls_last("published_date"), "doc_id").limit(k)


def document(docs: DataFrame, doc_id: int) -> DataFrame:
    """The row of one document, if there is one."""
    return docs.where(F.col("doc_id") == doc_id)
