"""Quality, spam and freshness signals, and the linear model over them."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.text import WORD, run_starts


def freshness(published: Column, as_of: Column) -> Column:
    """1 for today, 1/2 after 180 days, never under 0.1; unknown dates 0.5."""
    days = F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(published)) / 86400))
    return F.when(published.isNull(), 0.5).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1.0 / (1.0 + days / 180.0))))


def quality(url: Column, words: Column, title: Column) -> Column:
    https = F.when(url.startswith("https://"), 0.2).otherwise(0.0)
    length = F.when(words.between(250, 4000), 0.3).when(words < 100, -0.3).otherwise(0.0)
    named = F.when(F.length(title).between(15, 90), 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.lit(1.0) + https + length + named)


def top_share(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, share, n_words): the share of the most frequent word of each text that has words, within the row."""
    words = F.sort_array(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD), 0))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words")).where(F.size("words") > 0)
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), run_starts(F.col("words")).alias("starts"))
    runs = F.transform("starts", lambda x, i: F.coalesce(F.get("starts", i + 1), F.col("n_words").cast("int")) - x)
    return rows.select("doc_id", (F.array_max(runs) / F.col("n_words")).alias("share"), "n_words")


def spam(words: Column, share: Column, title: Column) -> Column:
    """0 (clean) to 1 (spam), from thin content, stuffing, capitals and exclamation."""
    capitals = F.length(F.regexp_replace(title, r"[^\p{Lu}]", "")) / F.length(title)
    shouting = F.when((F.length(title) > 5) & (capitals > 0.6), 0.2).otherwise(0.0)
    marks = F.when((F.regexp_count(title, F.lit("!")) > 2) | (F.regexp_count(title, F.lit(r"\$")) > 2), 0.2).otherwise(0.0)
    stuffed = F.when(share > 0.08, F.least(F.lit(0.6), (share - 0.08) * 5.0)).otherwise(0.0)
    return F.when(words < 15, 0.4).when(share.isNull(), 0.8).otherwise(F.least(F.lit(1.0), stuffed + shouting + marks))


#: Weights of BM25, PageRank, quality, spam and length.
LTR_WEIGHTS = (0.45, 0.20, 0.15, -0.30, 0.10)


class RankingModel(Protocol):
    """A learned ranker over columns: what it looks at, and its score for that."""

    def features(self, bm25: Column, page_rank: Column, quality_: Column, spam_: Column, words: Column) -> list[Column]: ...

    def predict(self, features: list[Column]) -> Column: ...


class LinearModel:
    """A weighted sum of the signals, at least 0."""

    def __init__(self, weights: tuple[float, ...] = LTR_WEIGHTS):
        self.weights = weights

    def features(self, bm25: Column, page_rank: Column, quality_: Column, spam_: Column, words: Column) -> list[Column]:
        return [bm25, page_rank, quality_, spam_, F.least(F.lit(10.0), words / 500.0)]

    def predict(self, features: list[Column]) -> Column:
        total = F.lit(0.0)
        for weight, feature in zip(self.weights, features):
            total = total + F.lit(weight) * feature
        return F.greatest(F.lit(0.0), total)


def ltr_score(bm25: Column, page_rank: Column, quality_: Column, spam_: Column, words: Column, model: RankingModel = LinearModel()) -> Column:
    return model.predict(model.features(bm25, page_rank, quality_, spam_, words))
