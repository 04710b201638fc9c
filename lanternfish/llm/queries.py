"""The thin queries: each applies one operator to its whole table."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm.scratch import bound_batches
from lanternfish.session import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.ann import nearest

    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.url_filter import judge, page_edges

    pages = _table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), page_edges(pages), url_rules())


def url_rules() -> list:
    """The rules of the contract."""
    from lanternfish.llm.url_filter import Rule

    return [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.language_id import fit, predict

    docs = _table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id modulo 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.near_dedup import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.license_scan import fit, scan

    docs = _table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    told = F.transform("findings", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select(
        "doc_id", F.size("findings").cast("long").alias("n_findings"),
        F.array_join(F.array_sort(F.array_distinct(F.col("findings.family"))), ",").alias("families"),
        F.array_join(told, ",").alias("findings"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.secret_scan import listed, scan

    found = scan(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))
    of = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] != "random")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.line_dedup import remove_boilerplate

    out = remove_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.exact_dedup import exact_groups

    return exact_groups(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lanternfish.llm.sentencepiece_codec import digest

    return digest(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def _bounded(query):
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _bounded(f) for name, f in globals().items() if name.startswith("op") and callable(f)}
