"""The search query language, parsed on the driver into a frozen record."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from lanternfish.functions.text import raw_tokens, stems


@dataclass(frozen=True)
class ParsedQuery:
    """What a query asks for; terms are stemmed unless called raw."""

    raw_query: str = ""
    positive_terms: tuple[str, ...] = ()
    raw_positive_terms: tuple[str, ...] = ()
    exact_phrases: tuple[tuple[str, ...], ...] = ()
    raw_exact_phrases: tuple[str, ...] = ()
    negative_terms: tuple[str, ...] = ()
    is_boolean_or: bool = False
    site: str | None = None
    intitle: str | None = None
    inurl: str | None = None
    filetype: str | None = None
    before: datetime | None = None
    after: datetime | None = None

    @property
    def is_empty(self) -> bool:
        """Nothing to look up: such a query has no results."""
        return not self.positive_terms and not self.raw_positive_terms


_PHRASE = re.compile(r'"([^"]+)"')
_TEXT_FILTERS = ("site", "intitle", "inurl", "filetype")


def _day(text: str) -> datetime | None:
    try:
        return datetime.strptime(text, "%Y-%m-%d")
    except ValueError:
        return None


def parse(text: str | None) -> ParsedQuery:
    """Read a query: phrases, ``field:value`` filters, ``-word``, and plain words.

    A later filter of the same field replaces an earlier one; a date that can't
    be read is dropped.  Words of phrases come first among the terms.  AND and
    OR as words are skipped; stop words are kept.
    """
    text = (text or "").strip()
    raw_phrases = [p for p in _PHRASE.findall(text)]
    phrases = [tuple(s) for p in raw_phrases if (s := stems(p))]
    found: dict = {}
    negative: list[str] = []
    plain: list[str] = []
    for word in _PHRASE.sub(" ", text).split():
        name, colon, value = word.partition(":")
        name = name.lower()
        if colon and value and name in _TEXT_FILTERS:
            found[name] = value.lower()
        elif colon and value and name in ("before", "after"):
            if day := _day(value):
                found[name] = day
        elif word.startswith("-") and len(word) > 1:
            negative += stems(word[1:])
        elif word.lower() not in ("and", "or"):
            plain.append(word)
    rest = " ".join(plain)
    ordered = lambda words: tuple(dict.fromkeys(words))
    return ParsedQuery(
        raw_query=text,
        positive_terms=ordered([t for p in phrases for t in p] + stems(rest)),
        raw_positive_terms=ordered(raw_tokens(rest)),
        exact_phrases=tuple(phrases),
        raw_exact_phrases=tuple(p.strip() for p in raw_phrases),
        negative_terms=tuple(negative),
        is_boolean_or=" OR " in text,
        **found,
    )
