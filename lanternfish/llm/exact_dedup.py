"""Exact dedup by content-defined chunk recipes.

A text's UTF-8 bytes are cut where a rolling hash of the last 48 bytes meets a
condition, so equal passages give equal chunks wherever they stand.  A chunk is
named by a 64-bit hash and verified by its SHA-256: chunks whose short names
agree while their digests do not get distinct variant numbers.  A document is
then its ordered list of verified identifiers, and only those lists are grouped
and compared; ``exact_groups`` never moves text between machines.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.scratch import materialize, numbered, passing, quoted, without
from lanternfish.llm.words import powers

WINDOW = 48
_FINAL = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes looked at together; longer texts go through in overlapping blocks.
_BLOCK = 1 << 18

_RECIPE = "array<struct<weak:bigint,strong:binary>>"


def cut_points(data: bytes, mean_bytes: int = 4096) -> list[int]:
    """Ends of the chunks of ``data``; the condition depends on 48 bytes only.

    A cut needs ``mean_bytes / 4`` bytes before it, and comes after
    ``mean_bytes * 8`` at the latest.
    """
    n, least, most = len(data), mean_bytes // 4, mean_bytes * 8
    if n <= least:
        return [n] if n else []
    bits = np.uint64(64 - max(1, (mean_bytes - least).bit_length() - 1))
    raw = np.frombuffer(data, dtype=np.uint8)
    power, inverse = powers(_BLOCK + WINDOW)
    marks = []
    for at in range(0, n - WINDOW + 1, _BLOCK):
        part = raw[at : at + _BLOCK + WINDOW - 1].astype(np.uint64)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((part + np.uint64(1)) * power[: len(part)], out=sums[1:], dtype=np.uint64)
        here = len(part) - WINDOW + 1
        if here <= 0:
            break
        rolled = (sums[WINDOW:] - sums[:here]) * inverse[:here]
        rolled ^= rolled >> np.uint64(31)
        hit = np.flatnonzero((rolled * _FINAL) >> bits == 0)
        marks.append(hit + (at + WINDOW))
    ends, last = [], 0
    for m in np.concatenate(marks).tolist() if marks else []:
        while m - last > most:
            last += most
            ends.append(last)
        if m - last >= least:
            ends.append(m)
            last = m
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _digest(batches, mean_bytes: int):
    kind = pa.list_(pa.struct([("weak", pa.int64()), ("strong", pa.binary())]))
    for batch in batches:
        shas, recipes = [], []
        for text in batch.column(2).to_pylist():
            data = (text or "").encode("utf-8", "surrogatepass")
            shas.append(hashlib.sha256(data).hexdigest())
            recipe, start = [], 0
            for end in cut_points(data, mean_bytes):
                chunk = data[start:end]
                recipe.append({"weak": xxhash.xxh3_64_intdigest(chunk) - (1 << 63), "strong": hashlib.sha256(chunk).digest()})
                start = end
            recipes.append(recipe)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shas, pa.string()), pa.array(recipes, kind)], ["row_no", "doc_id", "text_sha256", "recipe"])


def recipes(slim: DataFrame, mean_bytes: int = 4096) -> DataFrame:
    """(row_no, doc_id, text_sha256, recipe) for every row of (row_no, doc_id, text), written once to the shared folder."""
    made = slim.mapInArrow(lambda it: _digest(it, mean_bytes), f"row_no bigint, doc_id bigint, text_sha256 string, recipe {_RECIPE}")
    return materialize(made, "recipes", lasting=True)


def _identified(rows: DataFrame) -> DataFrame:
    """Replace digests by verified identifiers: (row_no, doc_id, text_sha256, ids).

    Clashes of short names are all but unknown.  What there is of them is written
    out, so Spark knows its size and moves no recipe to meet an empty table.
    """
    chunks = rows.select(F.explode("recipe").alias("c")).select("c.*")
    clashing = (
        chunks.groupBy("weak").agg(F.min("strong").alias("low"), F.max("strong").alias("high"))
        .where("low != high").select("weak")
    )
    clashing = materialize(clashing, "clashing")
    variants = chunks.join(clashing, "weak", "left_semi").distinct()
    variants = variants.groupBy("weak").agg(F.sort_array(F.collect_set("strong")).alias("all"))
    variants = variants.select("weak", F.posexplode("all").alias("variant", "strong")).where("variant > 0")
    variants = materialize(variants, "variants")
    fixes = (
        rows.select("row_no", F.posexplode("recipe").alias("pos", "c")).select("row_no", "pos", "c.*")
        .join(variants, ["weak", "strong"])
        .groupBy("row_no").agg(F.map_from_entries(F.collect_list(F.struct("pos", "variant"))).alias("variant_of"))
    )
    fixes = materialize(fixes, "fixes", lasting=True)
    ids = F.transform("recipe", lambda c, i: F.struct(c["weak"].alias("chunk"), F.coalesce(F.col("variant_of")[i], F.lit(0)).alias("variant")))
    return rows.join(fixes, "row_no", "left").select("row_no", "doc_id", "text_sha256", ids.alias("ids"))


def _groups(slim: DataFrame, mean_bytes: int) -> DataFrame:
    """(row_no, doc_id, keep_id, group_size, kept, text_sha256) for each row of (row_no, doc_id, text)."""
    with passing(slim.sparkSession):
        rows = _identified(recipes(slim, mean_bytes))
        best = F.max(F.struct(F.col("doc_id"), F.col("row_no")))
        groups = rows.groupBy(F.col("ids").alias("g")).agg(F.count("*").alias("group_size"), best.alias("best"))
        # Written out, the groups meet the rows in a join of two plain exchanges, whose large partitions Spark splits.
        groups = materialize(groups, "groups", lasting=True)
    return rows.join(groups, rows["ids"] == groups["g"]).select(
        "row_no", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("best.row_no") == F.col("row_no")).alias("kept"), "text_sha256",
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_bytes: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their ordered identifier lists are.  The row with the
    largest id stays.  Null text counts as empty, and all empty texts form one
    group.  A null id ranks below every other.  Rows repeated with one id are
    members in their own right, of which one stays.  Whole texts count, however
    long.  An empty table gives an empty result; other columns are ignored,
    whatever their names.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return _groups(slim, mean_bytes).drop("row_no")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each distinct text, with all columns.

    The row of the largest id stays, as in ``exact_groups``: null and empty
    texts are one text, a null id ranks below every other, and of rows repeated
    with one id and text one stays.  Rows are told apart as rows, so columns may
    have any names, and a text moves once at most.  An empty table stays empty.
    """
    rows, number = numbered(docs)
    slim = rows.select(F.col(number).alias("row_no"), F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return without(rows, number, _groups(slim, 4096).where("not kept").select("row_no"))
