"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_FITS = "CASE WHEN {u}.host = '{h}' OR ends_with({u}.host, '.{h}') THEN starts_with({u}.path, '{p}') ELSE false END"
_RULES = [("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block")]


def _rule(u: str, of: str) -> str:
    """The longest rule that fits, as a CASE; the list is ordered by length."""
    return "CASE " + " ".join(f"WHEN {_FITS.format(u=u, h=h, p=p)} THEN '{h + p if of == 'text' else action}'" for h, p, action in _RULES) + " END"


_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NODE = r"""translate(regexp_extract({u}, '(?s)^(.*?://[^/?#]*)', 1), '%s', '%s')
  || substr(regexp_replace({u}, '(?s)#.*$', ''), length(regexp_extract({u}, '(?s)^(.*?://[^/?#]*)', 1)) + 1)""" % (_UPPER, _LOWER)
_HOST_PATH = f"""translate(coalesce(regexp_extract({{u}}, '{_PARTS}', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
  coalesce(regexp_extract({{u}}, '{_PARTS}', 2), '') AS path"""

OP2 = rf"""
WITH RECURSIVE found AS (
  SELECT url, regexp_extract(regexp_extract(html, '(?i)<link\s[^>]*rel\s*=\s*["'']?canonical[^>]*>'), '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1) AS link
  FROM pages WHERE contains(url, '://')
  UNION ALL
  SELECT url, regexp_extract(regexp_extract(html, '(?i)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh[^>]*>'), '(?i)url\s*=\s*["'']?([^"''\s>;]+)', 1)
  FROM pages WHERE contains(url, '://')),
targets AS (
  SELECT url, CASE WHEN contains(link, '://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?)://', 1) || ':' || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || link
    WHEN starts_with(link, '#') OR starts_with(link, '?') THEN NULL
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || '/' || regexp_extract(url, '(?s)^.*?://[^/?#]*/([^?#]*/)?', 1) || link END AS target
  FROM found WHERE link <> ''),
edges AS (SELECT {_NODE.format(u='url')} AS a, {_NODE.format(u='target')} AS b FROM targets WHERE target IS NOT NULL),
links AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
nodes AS (SELECT a AS node, {_HOST_PATH.format(u='a')} FROM links GROUP BY a),
reached(node) AS (
  SELECT node FROM nodes WHERE {_rule('nodes', 'action')} = 'block'
  UNION SELECT b FROM reached JOIN links ON node = a),
named AS (SELECT page_id, {_HOST_PATH.format(u='url')}, {_NODE.format(u='url')} AS node FROM pages)
SELECT page_id, host, path, {_rule('named', 'text')} AS rule,
  coalesce({_rule('named', 'action')}, CASE WHEN node IN (SELECT node FROM reached) THEN 'block' ELSE 'allow' END) AS verdict
FROM named
"""

OP8 = """
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
bad AS (
  SELECT trim(line, ' ') AS bare FROM lines WHERE length(trim(line, ' ')) >= 10
  GROUP BY 1 HAVING count(DISTINCT source) >= 10)
SELECT doc_id, count(*) AS n_lines, count(bad.bare) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.bare IS NULL), '')) AS text_sha256
FROM lines LEFT JOIN bad ON trim(line, ' ') = bad.bare GROUP BY doc_id
"""

OP9 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2, "op8_line_dedup": OP8, "op9_exact_dedup": OP9}
