"""robots.txt: permission, crawl delay and sitemaps, for tables of sites."""

from __future__ import annotations

from functools import lru_cache
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

USER_AGENT = "lanternfish"


@lru_cache(maxsize=2048)
def _rules(text: str) -> RobotFileParser:
    rules = RobotFileParser()
    rules.parse(text.splitlines())
    return rules


@F.pandas_udf(BooleanType())
def allowed(robots: pd.Series, url: pd.Series, agent: pd.Series) -> pd.Series:
    """Whether ``agent`` may fetch ``url``; without a file everything is allowed."""
    return pd.Series([not t or _rules(t).can_fetch(a, u or "") for t, u, a in zip(robots, url, agent)], dtype=bool)


def effective(status: Column, body: Column) -> Column:
    """The rules that an answer stands for: 401 and 403 forbid all, other errors nothing."""
    return F.when(status == 200, F.coalesce(body, F.lit(""))).when(status.isin(401, 403), "User-agent: *\nDisallow: /").otherwise("")


def crawl_delay(robots: Column, least: float = 1.0) -> Column:
    """The last delay named in any group, in seconds, at least ``least``."""
    found = F.regexp_extract_all(robots, F.lit(r"(?im)^\s*crawl-delay\s*:\s*([0-9]+(?:\.[0-9]+)?)"), 1)
    return F.greatest(F.lit(least), F.coalesce(F.try_element_at(found, F.lit(-1)).cast("double"), F.lit(least)))


def sitemaps(robots: Column) -> Column:
    return F.regexp_extract_all(robots, F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), 1)
