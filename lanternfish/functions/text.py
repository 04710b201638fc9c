"""Text processing as Spark columns: tokens, stems, word counts, stop words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The token pattern and the stop words.
TOKEN = r"[a-zA-Z0-9]+(?:\.[a-zA-Z0-9]+)*(?:\+\+|#)?"
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but "
    "by can did do does doing don down during each few for from further had has have having he her here hers herself "
    "him himself his how i if in into is it its itself just me more most my myself no nor not now of off on "
    "once only or other our ours ourselves out over own s same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which "
    "while who whom why will with you your yours yourself yourselves"
).split()
#: Unicode word characters, in a form that Java and RE2 read alike.
WORD = r"[\p{L}\p{M}\p{N}_]+"


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKC")


def nfkc(text: Column) -> Column:
    """Unicode NFKC.  Spark asks the function for every row, so texts of ASCII are sent to it as nulls."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def tokens(text: Column) -> Column:
    """Lower-case tokens, in order.  ASCII letters and digits, inner dots, ``++`` and ``#``."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), 0), F.lower)


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def collapsed(text: Column) -> Column:
    """All runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _drop(word: Column, n: int) -> Column:
    return word.substr(F.lit(1), F.length(word) - n)


#: Endings, the letters to drop, and what to add; the first that fits is used.
PLURALS = [("sses", 2, ""), ("ies", 2, ""), ("ss", 0, ""), ("us", 0, ""), ("is", 0, ""), ("s", 1, "")]
DERIVED = [("ational", 5, "e"), ("tional", 4, ""), ("izer", 1, ""), ("ation", 3, "e"), ("ator", 2, "e"), ("alism", 3, ""), ("iveness", 4, ""), ("fulness", 4, "")]


def _first_ending(word: Column, endings) -> Column:
    out = word
    for ending, n, add in reversed(endings):
        out = F.when(word.endswith(ending), F.concat(_drop(word, n), F.lit(add)) if add else _drop(word, n) if n else word).otherwise(out)
    return out


def with_stem(df: DataFrame, word_col: str, out_col: str) -> DataFrame:
    """Add the stem of ``word_col`` (a lower-case token).

    Three steps, each its own projection so that the plan stays small: plural
    endings; past and progressive endings with doubled letters undone; derived
    endings.  Words of up to three letters are left alone.
    """
    word = F.col(word_col)
    df = df.withColumn("__plural", _first_ending(word, PLURALS))
    p = F.col("__plural")
    past = p.endswith("ed") & ~p.endswith("eed")
    df = df.withColumn("__cut", F.when((F.length(p) > 4) & past, _drop(p, 2)).when((F.length(p) > 4) & p.endswith("ing"), _drop(p, 3)))
    c = F.col("__cut")
    doubled = (F.length(c) >= 2) & (F.right(c, F.lit(1)) == c.substr(F.length(c) - 1, F.lit(1))) & ~F.right(c, F.lit(1)).isin("l", "s", "z")
    bare = F.when(c.isNotNull(), F.when(doubled, _drop(c, 1)).otherwise(c)).when(p.endswith("eed") & (F.length(p) > 4), _drop(p, 1)).otherwise(p)
    df = df.withColumn("__bare", bare)
    stem = F.when(F.length(word) <= 3, word).otherwise(_first_ending(F.col("__bare"), DERIVED))
    # The explode of one element keeps later filters on the stem from being
    # pushed below, which would copy the whole chain into each of its uses.
    kept = [c for c in df.columns if c not in ("__plural", "__cut", "__bare")]
    return df.select(*kept, F.explode(F.array(stem)).alias(out_col))


def may_have_stem(word: Column, stems_: Iterable[str]) -> Column:
    """False for words that have none of the stems: a stem, but for a final e, is how its words begin."""
    return reduce(lambda a, b: a | b, (word.startswith(s.removesuffix("e")) for s in stems_), F.lit(False))


def run_starts(ordered: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """Where in a sorted array a run of equal keys begins, counted from 0; empty for an empty array."""
    places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (key(F.get(ordered, i)) != key(F.get(ordered, i - 1))))


def _ending(word: str, endings) -> str:
    for ending, n, add in endings:
        if word.endswith(ending):
            return word[: len(word) - n] + add
    return word


def stem(word: str) -> str:
    """The stem of one word, for queries parsed on the driver."""
    word = word.lower()
    if len(word) <= 3:
        return word
    word = _ending(word, PLURALS)
    if len(word) > 4:
        if word.endswith("eed"):
            word = word[:-1]
        elif cut := next((n for e, n in (("ed", 2), ("ing", 3)) if word.endswith(e)), 0):
            word = word[:-cut]
            if word[-1:] == word[-2:-1] and word[-1:] not in ("", "l", "s", "z"):
                word = word[:-1]
    return _ending(word, DERIVED)


def raw_tokens(text: str) -> list[str]:
    return [m.lower() for m in re.findall(TOKEN, unicodedata.normalize("NFKC", text or ""))]


def stems(text: str) -> list[str]:
    return [stem(t) for t in raw_tokens(text)]


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, raw): one row per token."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "raw"))
