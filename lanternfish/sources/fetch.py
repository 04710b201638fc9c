"""Fetched responses as a table, classified; the network itself is a pluggable source."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.urls import safe_to_fetch

#: Accepted types, the largest body, retries, and their base wait.
ACCEPTED = ["text/html", "application/xhtml+xml", "text/plain"]
MAX_BYTES = 5 * 1024 * 1024
RETRIES, BACKOFF = 3, 1.5


def classified(responses: DataFrame) -> DataFrame:
    """Responses (url, status, content_type, body, error, attempt) with outcome and retry wait.

    Outcomes: unsafe, error, not_modified, http_error, wrong_type, too_large, ok.
    Only timeouts and failed connections are tried again.
    """
    kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
    outcome = (
        F.when(~safe_to_fetch(F.col("url")), "unsafe").when(F.col("error").isNotNull(), "error").when(F.col("status") == 304, "not_modified")
        .when(F.col("status") != 200, "http_error").when(~kind.isin(ACCEPTED), "wrong_type")
        .when(F.octet_length("body") > MAX_BYTES, "too_large").otherwise("ok")
    )
    again = F.col("error").isin("timeout", "connect") & (F.col("attempt") < RETRIES)
    return responses.withColumn("outcome", outcome).withColumn("retry_after_s", F.when(again, F.pow(F.lit(BACKOFF), F.col("attempt"))))


def fetched(urls: DataFrame, fetch: Callable[[Iterator], Iterator], schema: str = "url string, status int, content_type string, body string, error string, attempt int") -> DataFrame:
    """Run a caller's fetcher over the safe URLs, one client per partition (Arrow batches in and out)."""
    return urls.where(safe_to_fetch(F.col("url"))).select("url").mapInArrow(fetch, schema)
