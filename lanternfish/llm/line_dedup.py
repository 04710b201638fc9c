"""Cross-site boilerplate lines, found by HyperLogLog spread; native functions only.

Each line hash gets a HyperLogLog sketch of the sites it occurs on; sketches
merge by aggregation, so a line on a million pages costs one small sketch per
task.  Lines whose estimate lies within the sketch's error of the threshold are
counted exactly.  Lines on enough distinct sites are then removed.

A line is named by two hashes of 64 bits with different seeds, and all counting
and matching goes by both, so unrelated lines that share one stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.llm.scratch import materialize, quoted, unused

LG_K = 10
#: Three standard errors of a sketch with 2**LG_K registers.
MARGIN = 3 * 1.04 / 2 ** (LG_K / 2)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column, min_chars: int) -> Column:
    """Both hashes of the line without outer spaces; null for lines too short to judge."""
    bare = F.trim(line)
    return F.when(F.length(bare) >= min_chars, F.struct(F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2")))


def line_keys(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int) -> DataFrame:
    """(doc_id, site, h1, h2), one row per distinct judged line of a row."""
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col(quoted(text_col))), lambda x: _key(x, min_chars)), lambda k: k.isNotNull()))
    found = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(site_col)).cast("string").alias("site"), F.explode(keys).alias("key"))
    return found.select("doc_id", "site", "key.h1", "key.h2")


def boilerplate_keys(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, sites) of the lines on ``min_sites`` distinct sites or more."""
    key = ["h1", "h2"]
    spread = lines.where(F.col("site").isNotNull()).groupBy(*key).agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = spread.select(*key, F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - MARGIN))
    spread = materialize(spread, "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + MARGIN))
    exact = lines.join(near.select(*key), key, "left_semi").select(*key, "site").distinct().where(F.col("site").isNotNull())
    exact = exact.groupBy(*key).agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return spread.where(F.col("sites") > min_sites * (1 + MARGIN)).unionByName(exact)


def remove_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
    min_sites: int = 10, min_chars: int = 10,
) -> DataFrame:
    """``docs`` with cross-site lines removed from the text, and two counts.

    Adds ``n_lines`` and ``n_removed``, under longer names where ``docs`` has
    such columns.  Every row comes back once, repeated rows too.  A null text
    stays null with 0 lines; an empty one is one empty line.  Lines under
    ``min_chars`` characters are never judged, rows with a null site lose lines
    but count for no site, and a null id works like any other.  Texts may be of
    any length; a text's lines are compared with the boilerplate lines in it.
    Ties do not occur: a line goes if its count reaches ``min_sites``.  An
    empty table gives an empty result, and columns may have any names.
    """
    lines = line_keys(docs, id_col, text_col, site_col, min_chars)
    bad = boilerplate_keys(lines, min_sites).select("h1", "h2")
    own, gone = unused(docs, "own_id"), unused(docs, "gone")
    marked = lines.join(bad, ["h1", "h2"]).groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("h1", "h2")).alias(gone))
    joined = docs.join(marked, docs[quoted(id_col)].eqNullSafe(marked[own]), "left")
    text = F.col(quoted(text_col))
    all_lines = _lines(text)
    stays = F.filter(all_lines, lambda x: ~F.coalesce(F.array_contains(F.col(gone), _key(x, min_chars)), F.lit(False)))
    kept = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(stays, "\n"))
    total = F.when(text.isNull(), 0).otherwise(F.size(all_lines)).cast("long")
    left = F.when(text.isNull(), 0).when(F.col(gone).isNull(), total).otherwise(F.size(stays)).cast("long")
    columns = [F.col(quoted(c)) if c != text_col else kept.alias(text_col) for c in docs.columns]
    return joined.select(*columns, total.alias(unused(docs, "n_lines")), (total - left).alias(unused(docs, "n_removed")))
