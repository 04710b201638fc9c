"""Retrieval quality against graded URL patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query, URL pattern, grade.
JUDGMENTS = [
    ("python", "python.org", 3), ("python", "docs.python.org", 3), ("python", "en.wikipedia.org/wiki/Python", 2), ("python", "pypi.org", 2),
    ("python web framework", "djangoproject.com", 3), ("python web framework", "palletsprojects.com/p/flask", 3), ("python web framework", "fastapi.tiangolo.com", 3),
    ("machine learning", "scikit-learn.org", 3), ("machine learning", "tensorflow.org", 3), ("machine learning", "pytorch.org", 3),
    ("best programming language", "tiobe.com", 2), ("best programming language", "python.org", 2), ("best programming language", "rust-lang.org", 2),
]


def graded(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """(query, rank, url, grade): the best grade whose pattern the URL contains, else 0.

    Judgments of a query are few, so they are gathered into one row and tested
    against each result in place.
    """
    lists = judgments.where("grade > 0").groupBy("query").agg(F.collect_list(F.struct("pattern", "grade")).alias("js"))
    rows = results.join(lists, "query", "left")
    hits = F.filter("js", lambda j: F.col("url").contains(j["pattern"]))
    return rows.select("query", "rank", "url", F.coalesce(F.array_max(F.transform(hits, lambda j: j["grade"])), F.lit(0)).alias("grade"))


def per_query(results: DataFrame, judgments: DataFrame, k: int = 5) -> DataFrame:
    """(query, precision, reciprocal_rank, ndcg, recall) of every judged query.

    Precision divides by the results there are, up to ``k``.  The ideal order
    is that of the grades themselves, so NDCG passes 1 where several results
    match one pattern.  Recall is the share of patterns met in the first ``k``.
    """
    found = graded(results, judgments)
    top = F.col("rank") <= k
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1.0) / F.log2(F.col("rank") + 1.0)
    got = found.groupBy("query").agg(
        F.count(F.when(top & (F.col("grade") > 0), 1)).alias("relevant"), F.count(F.when(top, 1)).alias("returned"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"), F.sum(F.when(top, gain)).alias("dcg"),
    )
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade"), "pattern"))
    ideal = judgments.withColumn("rank", place).groupBy("query").agg(F.sum(F.when(top, gain)).alias("idcg"), F.count("*").alias("patterns"))
    met = results.where(top).join(judgments.where("grade > 0"), "query").where(F.col("url").contains(F.col("pattern")))
    met = met.groupBy("query").agg(F.count_distinct("pattern").alias("met"))
    rows = ideal.join(got, "query", "left").join(met, "query", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "query", F.when(zero("returned") > 0, F.col("relevant") / F.col("returned")).otherwise(0.0).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(zero("idcg") == 0, F.when(zero("dcg") == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).alias("ndcg"),
        (zero("met") / F.col("patterns")).alias("recall"),
    )


def summary(results: DataFrame, judgments: DataFrame, k: int = 5) -> DataFrame:
    """One row: the means over all judged queries."""
    rows = per_query(results, judgments, k)
    return rows.agg(*(F.avg(c).alias(f"mean_{c}") for c in ("precision", "reciprocal_rank", "ndcg", "recall")))
