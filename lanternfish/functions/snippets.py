"""Snippets: the passage that matches a query best, with the matches in bold."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternfish.functions.text import collapsed


def highlighted(text: Column, terms: list[str] | tuple[str, ...], phrases: list[str] | tuple[str, ...] = ()) -> Column:
    """Bold phrases, then each term of two letters or more as a whole word, whatever the case."""
    for phrase in phrases:
        text = F.regexp_replace(text, "(?iu)" + _quoted(phrase), "<b>$0</b>")
    for term in terms:
        if len(term) > 1:
            text = F.regexp_replace(text, rf"(?iu)\b({_quoted(term)})\b", "<b>$1</b>")
    return text


def _quoted(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def snippet(text: Column, terms: list[str] | tuple[str, ...], phrases: list[str] | tuple[str, ...] = (), length: int = 240) -> Column:
    """A passage of about ``length`` characters around the best sentence, highlighted.

    A sentence scores its matching terms (phrases count three) over its length
    to the power 0.3; the first of equals wins.  The sentences after it follow
    while their lengths stay under ``length``.
    """
    clean = collapsed(F.coalesce(text, F.lit("")))
    wanted = sorted({t.lower() for t in terms if len(t) > 1})

    def score(sentence: Column) -> Column:
        low = F.lower(sentence)
        hits = F.lit(0)
        for word, weight in [*((t, 1) for t in wanted), *((p.lower(), 3) for p in phrases)]:
            hits = hits + F.when(low.contains(word), weight).otherwise(0)
        return F.when(F.length(sentence) > 0, hits / F.pow(F.length(sentence), F.lit(0.3))).otherwise(0.0)

    sentences = F.split(clean, r"(?<=[.!?])\s+")
    ranked = F.transform(sentences, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("place")))
    best = (-F.array_max(ranked)["place"]).alias("best")

    # An explode with one element keeps this from being worked out again for each use below.
    def passage(sents: Column, at: Column) -> Column:
        start = F.struct(F.lit("").alias("text"), F.lit(0).alias("size"), F.lit(0).alias("used"), F.lit(True).alias("open"))
        rest = F.slice(sents, at + 1, F.size(sents))

        def step(state: Column, s: Column) -> Column:
            fits = state["open"] & ((state["used"] == 0) | (state["size"] + F.length(s) < length))
            joined = F.when(state["used"] == 0, s).otherwise(F.concat(state["text"], F.lit(" "), s))
            return F.when(fits, F.struct(joined.alias("text"), (state["size"] + F.length(s)).alias("size"), (state["used"] + 1).alias("used"), F.lit(True).alias("open"))).otherwise(
                F.struct(state["text"].alias("text"), state["size"].alias("size"), state["used"].alias("used"), F.lit(False).alias("open")))

        done = F.aggregate(rest, start, step)
        prefix = F.when(at > 0, "... ").otherwise("")
        suffix = F.when(at + done["used"] < F.size(sents), " ...").otherwise("")
        return F.concat(prefix, done["text"], suffix)

    whole = F.element_at(F.transform(F.array(F.struct(sentences.alias("s"), best)), lambda x: passage(x["s"], x["best"])), 1)
    return highlighted(F.when(F.length(clean) <= length, clean).otherwise(whole), terms, phrases)
