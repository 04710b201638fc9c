"""URL columns: parts, normal form, joining, and safety for crawling."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Parameters that only track, and networks that are never fetched.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "source", "_ga"]
BLOCKED = ["127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.169.254/32", "0.0.0.0/8", "::1/128", "fc00::/7", "fe80::/10"]
#: Scheme, authority, path, query, fragment (RFC 3986, appendix B).
GENERIC = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, GENERIC, 1))


def domain(url: Column) -> Column:
    """Authority in lower case, with its port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), GENERIC, 2))


def display(url: Column) -> Column:
    """Without scheme and trailing slashes, as shown to people."""
    return F.regexp_replace(F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("http://"), F.lit("")), r"/+$", "")


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%20"))), x)


def _encoded(x: Column) -> Column:
    """Form encoding that keeps ``~`` and encodes ``*``."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalized(url: Column) -> Column:
    """One spelling for equivalent http(s) URLs; others come back trimmed, null as empty.

    Scheme and host in lower case, default ports, fragments, path parameters,
    tracking and blank parameters gone, the rest sorted; slashes single, none
    at the end of a path.
    """
    url = F.trim(F.coalesce(url, F.lit("")))
    kind, host = scheme(url), domain(url)
    host = F.when(kind == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, GENERIC, 3), r";[^/]*$", ""), "/{2,}", "/")
    path = F.regexp_replace(path, "(?<=.)/$", "")
    path = F.when(path == "", "/").otherwise(path)
    pairs = F.filter(F.split(F.regexp_extract(url, GENERIC, 4), "&"), lambda p: p.contains("="))
    pairs = F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(p.substr(F.instr(p, "=") + 1, F.length(p))).alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda p: (p["v"] != "") & ~F.lower(p["k"]).isin(TRACKING)))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    whole = F.concat(kind, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(kind.isin("http", "https"), whole).otherwise(url)


def normalize(url: str | None) -> str:
    """The same normal form for one URL, inside Python workers that parse pages."""
    url = (url or "").strip()
    try:
        parts = urlsplit(url)
    except ValueError:
        return url
    kind, host = parts.scheme.lower(), parts.netloc.lower()
    if kind not in ("http", "https"):
        return url
    host = host.removesuffix(":80" if kind == "http" else ":443")
    path = re.sub("(?<=.)/$", "", re.sub("/{2,}", "/", re.sub(r";[^/]*$", "", parts.path))) or "/"
    kept = sorted((k, v) for k, v in parse_qsl(parts.query) if k.lower() not in TRACKING)
    return f"{kind}://{host}{path}" + (f"?{urlencode(kept)}" if kept else "")


def joined(base: str, link: str) -> str:
    """``link`` resolved against ``base``; a link that can't be read comes back as it is."""
    try:
        return urljoin(base, link)
    except ValueError:
        return link


_NETWORKS = [ipaddress.ip_network(n) for n in BLOCKED]


def _safe(url: str | None) -> bool:
    try:
        parts = urlsplit(url or "")
        host = parts.hostname
    except ValueError:
        return False
    if parts.scheme not in ("http", "https") or not host or host == "localhost":
        return False
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return True
    return not (ip.is_private or ip.is_loopback or ip.is_reserved or ip.is_link_local or any(ip in n for n in _NETWORKS))


@F.pandas_udf(BooleanType())
def safe_to_fetch(url: pd.Series) -> pd.Series:
    """False for other schemes, no host, localhost and private addresses; names aren't resolved."""
    return url.map(_safe).astype(bool)
