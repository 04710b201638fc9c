"""The positional inverted index as tables: postings, term, document and corpus statistics."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternfish.functions.text import STOP_WORDS, may_have_stem, nfkc, token_rows, tokens, with_stem
from lanternfish.session import children, delete_path


def combined_text(title: Column, description: Column, content: Column) -> Column:
    """What is indexed of a document: the title twice, description and content."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat_ws(" ", part(title), part(title), part(description), part(content))


def term_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_stopwords: bool = False) -> DataFrame:
    """(doc_id, pos, raw, term): stemmed tokens with positions.

    A stop word that is removed still takes its position.
    """
    rows = token_rows(docs, id_col, text_col)
    if remove_stopwords:
        rows = rows.where(~F.col("raw").isin(STOP_WORDS))
    return with_stem(rows, "raw", "term")


@dataclass(frozen=True)
class Index:
    """postings(term, doc_id, tf, positions), doc_stats(doc_id, doc_len), corpus_stats(n, avgdl)."""

    postings: DataFrame
    doc_stats: DataFrame
    corpus_stats: DataFrame

    @property
    def term_stats(self) -> DataFrame:
        """(term, doc_frequency, total_occurrences)."""
        return self.postings.groupBy("term").agg(F.count("*").alias("doc_frequency"), F.sum("tf").alias("total_occurrences"))

    def of_terms(self, terms: Iterable[str]) -> DataFrame:
        return self.postings.where(F.col("term").isin(list(terms)))

    def without(self, doc_ids: DataFrame) -> Index:
        """The index with documents removed; ``doc_ids`` has a column doc_id."""
        gone = doc_ids.select("doc_id").distinct()
        stats = self.doc_stats.join(gone, "doc_id", "left_anti")
        return Index(self.postings.join(gone, "doc_id", "left_anti"), stats, corpus_stats(stats))

    def with_documents(self, other: Index) -> Index:
        """The index with the documents of ``other`` added, or replaced where they exist."""
        rest = self.without(other.doc_stats)
        stats = rest.doc_stats.unionByName(other.doc_stats)
        return Index(rest.postings.unionByName(other.postings), stats, corpus_stats(stats))

    def write(self, path: str, buckets: int | None = None) -> None:
        """Write the index as the only segment under ``path``, and its term_stats.

        Postings are dealt by ranges of terms and lie sorted, so that a lookup
        reads few row groups; a frequent term may take several ranges.
        """
        spark = self.postings.sparkSession
        old = [n for t in ("postings", "doc_stats") for n in children(spark, f"{path}/{t}")]
        epoch = max((int(n.partition("=")[2]) for n in old if n.startswith("epoch=")), default=-1) + 1
        self.append(path, epoch, buckets)
        for table in ("postings", "doc_stats"):
            for name in children(spark, f"{path}/{table}"):
                if name != f"epoch={epoch}":
                    delete_path(spark, f"{path}/{table}/{name}")
        Index.read(spark, path).term_stats.write.mode("overwrite").parquet(f"{path}/term_stats")

    def append(self, path: str, epoch: int, buckets: int | None = None) -> None:
        """Write the index as one more segment.

        Its documents replace those of lower epochs; a length of null removes
        one.  An epoch that is written again replaces itself.
        """
        by = (buckets, "term", "doc_id") if buckets else ("term", "doc_id")
        self.postings.repartitionByRange(*by).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/epoch={epoch}")
        self.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats/epoch={epoch}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        """The index from the segments under ``path``; of each document the highest epoch counts."""
        postings = spark.read.schema("term string, doc_id bigint, tf bigint, positions array<int>, epoch bigint").parquet(f"{path}/postings")
        lengths = spark.read.schema("doc_id bigint, doc_len bigint, epoch bigint").parquet(f"{path}/doc_stats")
        if sum(n.startswith("epoch=") for n in children(spark, f"{path}/doc_stats")) > 1:
            last = lengths.groupBy("doc_id").agg(F.max("epoch").alias("epoch"), F.max_by("doc_len", "epoch").alias("doc_len"))
            lengths = last.where("doc_len is not null")
            postings = postings.join(lengths.select("doc_id", "epoch"), ["doc_id", "epoch"], "left_semi")
        stats = lengths.select("doc_id", "doc_len").where("doc_len is not null")
        return Index(postings.select("term", "doc_id", "tf", "positions"), stats, corpus_stats(stats))

    @staticmethod
    def remove(path: str, epoch: int, doc_ids: DataFrame) -> None:
        """Write a segment that removes documents; ``doc_ids`` has a column doc_id."""
        gone = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("doc_len")).distinct()
        none = gone.select(F.lit("").alias("term"), "doc_id", F.lit(0).cast("long").alias("tf"), F.array().cast("array<int>").alias("positions")).limit(0)
        Index(none, gone, corpus_stats(gone)).append(path, epoch)

    @staticmethod
    def clear(spark: SparkSession, path: str) -> None:
        """Remove all segments."""
        for table in ("postings", "doc_stats", "term_stats"):
            delete_path(spark, f"{path}/{table}")


def corpus_stats(doc_stats: DataFrame) -> DataFrame:
    """One row: number of documents and mean length, 1 where there are none."""
    return doc_stats.agg(F.count("*").alias("n"), F.coalesce(F.avg("doc_len"), F.lit(1.0)).alias("avgdl"))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: Iterable[str] | None = None) -> Index:
    """Index ``docs``; with ``terms``, only their postings (statistics are those of all documents)."""
    clean = docs.select(F.col(id_col).alias("doc_id"), nfkc(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    stats = clean.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("doc_len"))
    return Index(_postings(clean, terms), stats, corpus_stats(stats))


def _postings(clean: DataFrame, terms: Iterable[str] | None) -> DataFrame:
    """(term, doc_id, tf, positions).

    Tokens are combined before they are shuffled, so what moves is postings.
    (Grouping them within the row by array functions moves nothing, but Spark
    interprets those functions: it took three times as long.)  With ``terms``,
    tokens that cannot have one of them go before any is stemmed.
    """
    rows = token_rows(clean)
    if terms is not None:
        terms = list(terms)
        rows = rows.where(may_have_stem(F.col("raw"), terms))
    rows = with_stem(rows, "raw", "term")
    if terms is not None:
        rows = rows.where(F.col("term").isin(terms))
    return rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def phrase_counts(index: Index, phrase: tuple[str, ...] | list[str]) -> DataFrame:
    """(doc_id, n): how often the terms stand next to one another; overlaps count."""
    if not phrase:
        return index.doc_stats.select("doc_id", F.lit(0).cast("long").alias("n")).limit(0)
    # Each occurrence votes for the place where the phrase would start.
    slots: dict[str, list[int]] = {}
    for k, term in enumerate(phrase):
        slots.setdefault(term, []).append(k)
    at = F.create_map(*(x for t, ks in slots.items() for x in (F.lit(t), F.array(*map(F.lit, ks)))))
    places = index.of_terms(slots).select("doc_id", F.explode("positions").alias("pos"), at[F.col("term")].alias("ks"))
    starts = places.select("doc_id", F.explode(F.transform("ks", lambda k: F.col("pos") - k)).alias("start"))
    full = starts.groupBy("doc_id", "start").agg(F.count("*").alias("hits")).where(F.col("hits") == len(phrase))
    return full.groupBy("doc_id").agg(F.count("*").alias("n"))


def vocabulary_prefix(index: Index, prefix: str, limit: int = 10) -> DataFrame:
    """(term, doc_frequency) of terms that start with ``prefix``, most frequent first, then by term."""
    found = index.postings.where(F.col("term").startswith(prefix.lower()))
    return found.groupBy("term").agg(F.count("*").alias("doc_frequency")).orderBy(F.desc("doc_frequency"), "term").limit(limit)


def first_of(keys: list[str], order: list[Column], df: DataFrame) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
