"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanternfish.llm import scratch
from lanternfish.llm.exact_dedup import drop_exact_copies
from lanternfish.llm.language_id import fit, keep_identified
from lanternfish.llm.near_dedup import drop_near_copies
from lanternfish.llm.packing import pack
from lanternfish.llm.queries import held_out, tokenizer
from lanternfish.llm.secret_scan import redact
from lanternfish.session import spread

#: None: no stage but the exact dedup can be said in SQL; tests/llm/test_pipeline.py holds the brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the model learns from labelled rows."""
    return keep_identified(docs, fit(docs.where(~held_out(docs["doc_id"]))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return redact(docs, tokenizer("byte_bpe_50k.tiktoken"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return pack(docs, tokenizer("byte_bpe_50k.json"))


def _stage(function):
    """The stage, after removing what the stages before it wrote for themselves."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.bound_batches(spark)
        scratch.release(spark, *_own)
        start = scratch.mark()
        out = function(spark, docs, sf_dir)
        _own[:] = [start, scratch.mark()]
        return out

    return run_stage


#: Marks of the scratch tables of the stage before; its output has been written.
_own: list[int] = [0, 0]

STAGES = [
    ("language", _stage(language)),
    ("exact", _stage(exact)),
    ("near", _stage(near)),
    ("secrets", _stage(secrets)),
    ("packed", _stage(packed)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written to the shared folder and reread."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = scratch.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
