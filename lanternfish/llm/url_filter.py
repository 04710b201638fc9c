"""URL filtering with decisions carried over redirects and canonical links.

Rules name a host with its subdomains and a path prefix.  Pages that redirect
to one another, or name one another as canonical, are aliases: connected
components over those edges are found in a distributed way, and a component in
which any URL is blocked is blocked for every alias that no allow rule covers.
"""

from __future__ import annotations

from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lanternfish.llm.graph import components
from lanternfish.llm.scratch import materialize, passing, quoted

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The element's tag, then its target, in whichever order its attributes stand.
COMMENT = r"(?s)<!--.*?(-->|$)"
CANONICAL = r"(?i)<link\s[^>]*rel\s*=\s*[\"']?canonical[^>]*>"
HREF = r"(?i)\shref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?i)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*>"
TARGET = r"(?i)url\s*=\s*[\"']?([^\"'\s>]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host/path`` with a path that starts with a slash, and ``allow`` or ``block``."""

    host: str
    path: str
    action: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def undotted(path: Column) -> Column:
    """A path that starts with a slash, without its dot segments (RFC 3986, 5.2.4)."""
    segments = F.split(path, "/")
    segments = F.slice(segments, 2, F.size(segments))
    kept = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    end = F.when(F.element_at(segments, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), end)).otherwise(path)


def node_of(url: Column) -> Column:
    """The URL without fragment and dot segments, and with its scheme and host in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    start = F.translate(F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1), _UPPER, _LOWER)
    rest = F.substr(bare, F.length(start) + 1)
    path = F.regexp_extract(rest, r"(?s)^([^?]*)", 1)
    return F.concat(start, F.when(path.startswith("/"), undotted(path)).otherwise(path), F.substr(rest, F.length(path) + 1))


@F.pandas_udf(StringType())
def decoded(link: pd.Series) -> pd.Series:
    """An attribute's value without its entities and the blanks around it."""
    return link.map(lambda x: unescape(x).strip())


def resolved(base: Column, link: Column) -> Column:
    """``link`` as found in the page ``base`` (RFC 3986, 5.2.2; ``node_of`` takes dots out); null where it is the page itself."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(base, r"(?s)^.*?://[^/?#]*/([^?#]*/)?", 1))
    return (
        F.when((link == "") | link.startswith("#"), None).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .otherwise(F.concat(site, folder, link))
    )


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): the page and the target of its canonical link or refresh, where it has one.

    Comments count for nothing, nor do pages without html or without a URL that
    holds ``://``.  Repeated rows give repeated edges; other columns are ignored.
    """
    html, url = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), COMMENT, ""), F.col(url_col)
    found = F.array(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1), F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1))
    links = pages.where(url.contains("://")).select(url.alias("url"), F.explode(found).alias("link"))
    # One target a row, by explode, so that the long expression isn't copied into the next.
    links = links.where("link <> ''").select("url", decoded(F.col("link")).alias("link"))
    targets = links.select("url", F.explode(F.array(resolved(F.col("url"), F.col("link")))).alias("target"))
    edges = targets.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
    return edges.where("b is not null and a <> b")


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits, else nulls; of equal rules an allow wins.

    The list is a parameter of the job and becomes one expression.
    """
    text, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.action == "allow")):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, action = F.when(fits, F.lit(r.text)).otherwise(text), F.when(fits, F.lit(r.action)).otherwise(action)
    return text, action


def judge(pages: DataFrame, edges: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A page's own rule decides.  A page without one is blocked if a URL in its
    component is blocked by a rule, and allowed otherwise.  A null URL, or one
    without ``://``, has empty host and path, no rule, and is allowed.  Repeated
    rows and null ids each give their row; edges with a null end are no edges;
    empty tables give empty results; other columns are ignored.
    """
    with passing(pages.sparkSession):
        linked = components(edges.select("a", "b"))
        own = rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)[1]
        nodes = materialize(linked.select("node", "component", own.alias("own")), "nodes")
        # Written out, so that components with very many nodes can be split in the join.
        blocked = materialize(nodes.where("own = 'block'").select("component").distinct(), "blocked")
        tainted = nodes.where("own is null").join(blocked, "component", "left_semi").select("node")
        tainted = materialize(tainted, "tainted", lasting=True).withColumn("hit", F.lit(True))
    url = F.col(quoted(url_col)).cast("string")
    named = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    text, action = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("hit"), "block"), F.lit("allow"))
    return named.join(tainted, "node", "left").select("page_id", "host", "path", text.alias("rule"), verdict.alias("verdict"))
