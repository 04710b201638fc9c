"""The same queries in DuckDB's SQL, written on their own terms."""

from __future__ import annotations

from lanternfish.functions.text import STOP_WORDS

_TOKEN = r"[a-zA-Z0-9]+(?:\.[a-zA-Z0-9]+)*(?:\+\+|#)?"
_WORD = r"[\p{L}\p{M}\p{N}_]+"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

DOCS = """docs AS (
  SELECT doc_id, 'https://' || source || '.example.org/' || lang || '/' || doc_id AS url, source || '.example.org' AS domain,
    substr(split_part(coalesce(text, ''), chr(10), 1), 1, 80) AS title, coalesce(text, '') AS content, lang AS language,
    TIMESTAMP '2025-12-31' - to_days((doc_id % 400)::INT) AS published_at, 1.0::DOUBLE + (doc_id % 5) * 0.5::DOUBLE AS page_rank FROM documents)"""
PLAIN_TEXT = "txt AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
COMBINED = "txt AS (SELECT doc_id, concat_ws(' ', title, title, '', content) AS t FROM docs)"
TOKENS = f"""lists AS (SELECT doc_id, regexp_extract_all(t, '{_TOKEN}') AS ws FROM txt),
tok AS (SELECT doc_id, lower(unnest(ws)) AS raw, unnest(range(len(ws))) AS pos FROM lists)"""


def _stem(source: str) -> str:
    """CTEs that end in ``terms``: ``source`` (with raw) and its stem."""
    return f"""st1 AS (SELECT *, CASE WHEN raw LIKE '%sses' OR raw LIKE '%ies' THEN left(raw, length(raw) - 2)
  WHEN raw LIKE '%ss' OR raw LIKE '%us' OR raw LIKE '%is' THEN raw WHEN raw LIKE '%s' THEN left(raw, length(raw) - 1) ELSE raw END AS p FROM {source}),
st2 AS (SELECT *, CASE WHEN length(p) <= 4 OR p LIKE '%eed' THEN NULL WHEN p LIKE '%ed' THEN left(p, length(p) - 2) WHEN p LIKE '%ing' THEN left(p, length(p) - 3) END AS c FROM st1),
st3 AS (SELECT *, CASE WHEN c IS NOT NULL THEN CASE WHEN length(c) >= 2 AND right(c, 1) = left(right(c, 2), 1) AND right(c, 1) NOT IN ('l', 's', 'z') THEN left(c, length(c) - 1) ELSE c END
  WHEN p LIKE '%eed' AND length(p) > 4 THEN left(p, length(p) - 1) ELSE p END AS b FROM st2),
terms AS (SELECT * EXCLUDE (p, c, b), CASE WHEN length(raw) <= 3 THEN raw WHEN b LIKE '%ational' THEN left(b, length(b) - 5) || 'e' WHEN b LIKE '%tional' THEN left(b, length(b) - 4)
  WHEN b LIKE '%izer' THEN left(b, length(b) - 1) WHEN b LIKE '%ation' THEN left(b, length(b) - 3) || 'e' WHEN b LIKE '%ator' THEN left(b, length(b) - 2) || 'e'
  WHEN b LIKE '%alism' THEN left(b, length(b) - 3) WHEN b LIKE '%iveness' OR b LIKE '%fulness' THEN left(b, length(b) - 4) ELSE b END AS term FROM st3)"""


STEMS = _stem("tok")
POSTINGS = "post AS (SELECT term, doc_id, count(*) AS tf FROM terms GROUP BY ALL), lens AS (SELECT doc_id, len(ws) AS doc_len FROM lists)"
INDEXED = f"WITH {PLAIN_TEXT}, {TOKENS}, {STEMS}, {POSTINGS}"
SEARCHED = f"WITH {DOCS}, {COMBINED}, {TOKENS}, {STEMS}, {POSTINGS}"


def _list(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _bm25(words) -> str:
    return f"""corp AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM lens),
hits AS (SELECT * FROM post WHERE term IN ({_list(words)})),
dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
bm AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl))) AS bm25
  FROM hits JOIN dfs USING (term) JOIN lens USING (doc_id) CROSS JOIN corp GROUP BY doc_id)"""


def _phrase(words) -> str:
    joins = " ".join(f"JOIN terms t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.pos = t0.pos + {i} AND t{i}.term = '{w}'" for i, w in enumerate(words) if i)
    return f"(SELECT DISTINCT t0.doc_id FROM terms t0 {joins} WHERE t0.term = '{words[0]}')"


def _fresh(of: str) -> str:
    return f"greatest(0.1::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE / (1.0::DOUBLE + greatest(0, floor(date_diff('second', {of}, TIMESTAMP '2026-01-01') / 86400)) / 180.0::DOUBLE)))"


_SPAM = f"""share AS (SELECT doc_id, max(n) / sum(n) AS share FROM (SELECT doc_id, w, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_WORD}')) AS w FROM documents) GROUP BY ALL) GROUP BY doc_id),
judged AS (SELECT docs.*, len(regexp_extract_all(content, '{_WORD}')) AS words, share FROM docs LEFT JOIN share USING (doc_id)),
rated AS (SELECT *, CASE WHEN words < 15 THEN 0.4::DOUBLE WHEN share IS NULL THEN 0.8::DOUBLE ELSE least(1.0::DOUBLE,
    CASE WHEN share > 0.08 THEN least(0.6::DOUBLE, (share - 0.08::DOUBLE) * 5.0::DOUBLE) ELSE 0.0 END
    + CASE WHEN length(title) > 5 AND length(regexp_replace(title, '[^\\p{{Lu}}]', '', 'g')) / length(title) > 0.6 THEN 0.2::DOUBLE ELSE 0 END
    + CASE WHEN length(title) - length(replace(title, '!', '')) > 2 OR length(title) - length(replace(title, '$', '')) > 2 THEN 0.2::DOUBLE ELSE 0 END) END AS spam_score,
  greatest(0.1::DOUBLE, 1.0::DOUBLE + CASE WHEN starts_with(url, 'https://') THEN 0.2::DOUBLE ELSE 0 END
    + CASE WHEN words BETWEEN 250 AND 4000 THEN 0.3::DOUBLE WHEN words < 100 THEN -0.3::DOUBLE ELSE 0 END
    + CASE WHEN length(title) BETWEEN 15 AND 90 THEN 0.2::DOUBLE ELSE 0 END) AS quality_score FROM judged)"""


def _signals(words, phrases=(), negative=(), where="true", spam="0.0::DOUBLE", quality="1.0::DOUBLE", source="docs", strict=False) -> str:
    titles = " + ".join(f"(contains(lower(title), '{w}'))::INT" for w in words)
    bonus = " + ".join(f"CASE WHEN doc_id IN {_phrase(p)} THEN 4.0::DOUBLE ELSE 0 END" for p in phrases) or "0.0::DOUBLE"
    drop = f"AND doc_id NOT IN (SELECT doc_id FROM post WHERE term IN ({_list(negative)}))" if negative else ""
    need = " ".join(f"AND doc_id IN {_phrase(p)}" for p in phrases) if strict else ""
    return f"""{_bm25(words)},
sig AS (SELECT doc_id, bm25, ({titles}) / {len(words)}::DOUBLE * 5 AS title, {bonus} AS phrase, least(5.0::DOUBLE, page_rank) AS pagerank,
  {_fresh('published_at')} * 2 AS freshness, {quality} * 2 AS quality, {spam} * 10 AS spam FROM bm JOIN {source} USING (doc_id) WHERE {where} {drop} {need})"""


_SCORE = """round(greatest(0.01::DOUBLE, 0.40::DOUBLE * bm25 + 0.25::DOUBLE * title + 0.15::DOUBLE * phrase + 0.10::DOUBLE * pagerank
  + 0.05::DOUBLE * freshness + 0.05::DOUBLE * quality - 0.50::DOUBLE * spam), 6)"""


def _search(words, offset=0, prelude="", **how) -> str:
    return f"{SEARCHED}{prelude}, {_signals(words, **how)} SELECT doc_id, {_SCORE} AS score FROM sig ORDER BY score DESC, doc_id LIMIT 10 OFFSET {offset}"


PLAIN = ["licens", "apache", "right"]
PHRASED = ["general", "public", "license", "version"]
PHRASE = [["general", "public", "license"]]
LOG = "log AS (SELECT event_id, event_type AS query, lower(event_type) AS normalized_query, value AS latency_ms, ts FROM events)"

_GENERIC = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_TRACKING = "'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref', 'source', '_ga'"
URLS = f"""parts AS (SELECT page_id, url AS original, html, lower(regexp_extract(trim(url), '{_GENERIC}', 1)) AS kind, lower(regexp_extract(trim(url), '{_GENERIC}', 2)) AS host,
  regexp_extract(trim(url), '{_GENERIC}', 3) AS path, regexp_extract(trim(url), '{_GENERIC}', 4) AS query FROM pages),
cleaned AS (SELECT page_id, original, html, kind, CASE WHEN kind = 'http' THEN regexp_replace(host, ':80$', '') ELSE regexp_replace(host, ':443$', '') END AS host,
  CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace(regexp_replace(path, ';[^/]*$', ''), '/+', '/', 'g'), '(.)/$', '\\1') END AS path,
  list_sort(list_filter(string_split(query, '&'), lambda p: contains(p, '=') AND NOT ends_with(p, '=') AND lower(split_part(p, '=', 1)) NOT IN ({_TRACKING}))) AS pairs FROM parts),
urls AS (SELECT page_id, html, host, original, kind || '://' || host || path || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS url FROM cleaned)"""
QUEUE = f"""{URLS}, queue AS (SELECT url, host AS domain, page_id % 100 + 1 AS priority, (page_id % 8)::INT AS depth, TIMESTAMP '2025-01-01' + to_seconds(page_id) AS discovered_at FROM urls)"""
ONCE = "once AS (SELECT * FROM queue QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority DESC, discovered_at) = 1)"

_GRAPH = """nodes AS (SELECT 'p' || p_partkey AS node FROM part UNION SELECT 's' || s_suppkey FROM supplier UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'r' || r_regionkey FROM region),
raw_edges AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
edges AS (SELECT src, dst FROM raw_edges WHERE src <> dst AND src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes))"""


_SMALL_GRAPH = """nodes AS (SELECT 's' || s_suppkey AS node FROM supplier UNION SELECT 'n' || n_nationkey FROM nation UNION SELECT 'r' || r_regionkey FROM region),
edges AS (SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""


def _pagerank(graph: str, rounds: int = 50, tolerance: str = "1e-6") -> str:
    """CTEs that end in ``ranked`` (node, rank): rounds until the ranks stand still, or as many as given."""
    steps = [f"""outs AS (SELECT src, count(*) AS o FROM edges GROUP BY src), shares AS (SELECT src, dst, count(*) / any_value(o) AS share FROM edges JOIN outs USING (src) GROUP BY ALL),
total AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT node, 1.0::DOUBLE / n AS rank FROM nodes, total), s0 AS (SELECT false AS still)"""]
    for i in range(rounds):
        steps.append(f"""g{i} AS MATERIALIZED (SELECT dst, sum(rank * share) AS got FROM shares JOIN r{i} ON src = node GROUP BY dst),
r{i + 1} AS MATERIALIZED (SELECT r{i}.node, r{i}.rank AS old, CASE WHEN (SELECT still FROM s{i}) THEN r{i}.rank
  ELSE 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + (1 - coalesce((SELECT sum(got) FROM g{i}), 0)) / n) END AS rank FROM r{i} CROSS JOIN total LEFT JOIN g{i} ON dst = r{i}.node),
s{i + 1} AS MATERIALIZED (SELECT sum(abs(rank - old)) < {tolerance}::DOUBLE AS still FROM r{i + 1})""")
    return f"{graph}, {', '.join(steps)}, ranked AS (SELECT node, rank * n AS rank FROM r{rounds}, total)"


_FEATURE_WORD = rf"{_WORD}(?:[\p{{L}}\p{{M}}\p{{N}}_+#.]*{_WORD})?"
SIMHASH = f"""low AS (SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g'))) AS t FROM documents),
feats AS (SELECT doc_id, f, sum(w) AS w FROM (SELECT doc_id, unnest(list_transform(range(1, length(t) - 2), lambda i: substr(t, i, 4))) AS f, 1 AS w FROM low
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(t, '{_FEATURE_WORD}')), 2 FROM low) GROUP BY ALL),
codes AS (SELECT doc_id, w, ('0x' || substr(md5(f), 1, 16))::UBIGINT AS h FROM feats),
sums AS (SELECT doc_id, {', '.join(f'sum(CASE WHEN (h >> {i}) & 1 = 1 THEN w ELSE -w END) AS b{i}' for i in range(64))} FROM codes GROUP BY doc_id),
sims AS (SELECT doc_id, coalesce({' + '.join(f'CASE WHEN b{i} > 0 THEN {1 << i}::UHUGEINT ELSE 0::UHUGEINT END' for i in range(64))}, 0)::UBIGINT AS h FROM documents LEFT JOIN sums USING (doc_id))"""

_JUDGED = [("rights", ["right", "reserv"]), ("apache", ["apache", "license"]), ("released", ["releas", "mit"])]
BATCH = f"""corp AS (SELECT count(*) AS n, avg(doc_len) AS avgdl FROM lens),
asked(query_id, term) AS (VALUES {', '.join(f"('{q}', '{t}')" for q, ts in _JUDGED for t in ts)}),
hits AS (SELECT * FROM post WHERE term IN (SELECT term FROM asked)), dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * doc_len / avgdl))), 6) AS bm25
  FROM asked JOIN hits USING (term) JOIN dfs USING (term) JOIN lens USING (doc_id) CROSS JOIN corp GROUP BY ALL),
best AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_id)::INT AS rank, doc_id, bm25 FROM scored QUALIFY rank <= 10)"""
JUDGE = f"""{SEARCHED}, {BATCH},
jud(query, pattern, grade) AS (VALUES ('rights', '/en/', 3), ('rights', 'src1', 2), ('apache', '/de/', 3), ('apache', 'src2', 2), ('released', '/fr/', 2), ('none', 'x', 3)),
res AS (SELECT query_id AS query, rank, url FROM best JOIN docs USING (doc_id)),
gr AS (SELECT res.query, rank, url, coalesce(max(grade), 0) AS grade FROM res LEFT JOIN jud ON res.query = jud.query AND contains(url, pattern) GROUP BY ALL),
ideal AS (SELECT query, sum(CASE WHEN k <= 5 THEN (2.0 ^ grade - 1) / log2(k + 1) END) AS idcg, count(*) AS patterns
  FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, pattern) AS k FROM jud) GROUP BY query),
got AS (SELECT query, count(*) FILTER (rank <= 5 AND grade > 0) AS relevant, count(*) FILTER (rank <= 5) AS returned, min(rank) FILTER (grade > 0) AS first_hit,
  sum((2.0 ^ grade - 1) / log2(rank + 1)) FILTER (rank <= 5) AS dcg FROM gr GROUP BY query),
met AS (SELECT query, count(DISTINCT pattern) AS met FROM res JOIN jud USING (query) WHERE rank <= 5 AND contains(url, pattern) GROUP BY query),
each AS (SELECT query, CASE WHEN coalesce(returned, 0) > 0 THEN relevant / returned ELSE 0.0 END AS precision, coalesce(1.0 / first_hit, 0.0) AS reciprocal_rank,
  coalesce(dcg, 0.0) / idcg AS ndcg, coalesce(met, 0) / patterns AS recall FROM ideal LEFT JOIN got USING (query) LEFT JOIN met USING (query))"""

_SNIPPET_TERMS = ["license", "reserved", "the"]
_HITS = " + ".join([*(f"(contains(lower(s), '{t}'))::INT" for t in _SNIPPET_TERMS), "3 * (contains(lower(s), 'all rights'))::INT"])


def _bold(of: str, terms, phrases) -> str:
    for p in phrases:
        of = f"regexp_replace({of}, '(?i){p}', '<b>\\0</b>', 'g')"
    for t in terms:
        of = f"regexp_replace({of}, '(?i)\\b({t})\\b', '<b>\\1</b>', 'g')"
    return of


SNIPPETS = f"""WITH RECURSIVE clean AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g')) AS t FROM documents),
sents AS (SELECT doc_id, t, string_split(regexp_replace(t, '([.!?]) +', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM clean WHERE length(t) > 240),
every AS (SELECT doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM sents),
scored AS (SELECT doc_id, i, CASE WHEN length(s) > 0 THEN ({_HITS}) / length(s) ^ 0.3 ELSE 0 END AS score FROM every),
best AS (SELECT doc_id, arg_max(i, (score, -i)) AS b FROM scored GROUP BY doc_id),
grown(doc_id, b, n, total, ss, p) AS (
  SELECT doc_id, b, b + 1, length(ss[b + 1]), ss, ss[b + 1] FROM sents JOIN best USING (doc_id)
  UNION ALL SELECT doc_id, b, n + 1, total + length(ss[n + 1]), ss, p || ' ' || ss[n + 1] FROM grown WHERE n < len(ss) AND total + length(ss[n + 1]) < 240),
long AS (SELECT doc_id, CASE WHEN b > 0 THEN '... ' ELSE '' END || p || CASE WHEN n < len(ss) THEN ' ...' ELSE '' END AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS k FROM grown) WHERE k = 1)
SELECT doc_id, {_bold('coalesce(long.s, t)', ['the', 'license', 'reserved'], ['all rights'])} AS snippet FROM clean LEFT JOIN long USING (doc_id)"""

_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_entity}', '{_char}')"
_LANG = """lower(split_part(regexp_extract(html, '(?i)<html[^>]*\\slang\\s*=\\s*["'']?([^"''\\s>]+)', 1), '-', 1))"""
_HREFS = """hrefs AS (SELECT page_id, unnest(hs) AS href, unnest(range(len(hs)))::INT AS pos FROM (
  SELECT page_id, regexp_extract_all(html, '(?i)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1) AS hs FROM pages))"""
_BOUNDS = [5, 10, 25, 50, 100, 250, 500, 1000]

_METRICS = f"""WITH f AS (SELECT 'domain="' || event_type || '"' AS d, CASE WHEN event_id % 5 = 0 THEN '404' ELSE '200' END AS status, event_id % 7 = 0 AS late, value / 100 AS s, value / 1000 AS q, event_id FROM events)
SELECT 'crawl_requests_total' AS name, 'status="' || status || '",' || d AS labels, count(*)::DOUBLE AS value FROM f GROUP BY ALL
UNION ALL SELECT 'crawl_errors_total', 'error_type="timeout",' || d, count(*) FROM f WHERE late GROUP BY ALL
UNION ALL SELECT 'pages_indexed_total', '', count(*) FILTER (lang = 'en') FROM documents
UNION ALL SELECT 'crawler_queue_size', '', count(*) FROM pages
UNION ALL SELECT 'search_requests_total', '', count(*) FROM f
{' '.join(f"UNION ALL SELECT 'crawl_latency_seconds_bucket', d || ',le={chr(34)}{b}{chr(34)}', count(*) FILTER (s <= {b}) FROM f GROUP BY ALL" for b in ('0.05', '0.1', '0.25', '0.5', '1', '2.5', '5', '10'))}
UNION ALL SELECT 'crawl_latency_seconds_bucket', d || ',le="+Inf"', count(s) FROM f GROUP BY ALL
UNION ALL SELECT 'crawl_latency_seconds_sum', d, round(coalesce(sum(s), 0), 2) FROM f GROUP BY ALL
{' '.join(f"UNION ALL SELECT 'search_latency_seconds_bucket', 'le={chr(34)}{b / 1000:g}{chr(34)}', count(*) FILTER (q <= {b / 1000}::DOUBLE) FROM f" for b in _BOUNDS)}
UNION ALL SELECT 'search_latency_seconds_bucket', 'le="+Inf"', count(q) FROM f
UNION ALL SELECT 'search_latency_seconds_sum', '', round(coalesce(sum(q), 0), 2) FROM f
UNION ALL SELECT 'cache_hits_total', 'cache_type="search"', count(*) FROM f WHERE event_id % 3 = 0 HAVING count(*) > 0
UNION ALL SELECT 'cache_misses_total', 'cache_type="search"', count(*) FROM f WHERE event_id % 3 <> 0 HAVING count(*) > 0
UNION ALL VALUES ('active_workers', 'worker_type="crawler"', 5), ('active_workers', 'worker_type="indexer"', 1)"""
_TERM_STATS = "SELECT term, count(*) AS doc_frequency, sum(tf)::BIGINT AS total_occurrences FROM post"


def oracle_sql() -> dict[str, str]:
    return {
        "tokenize_terms": f"WITH {PLAIN_TEXT}, {TOKENS} SELECT raw, count(*) AS n FROM tok GROUP BY raw",
        "stem_terms": f"WITH {PLAIN_TEXT}, {TOKENS}, one AS (SELECT DISTINCT raw FROM tok), {_stem('one')} SELECT raw, term FROM terms",
        "raw_tokens_stopworded": f"WITH {PLAIN_TEXT}, {TOKENS} SELECT doc_id, count(*) AS n, max(pos) AS last_pos FROM tok WHERE raw NOT IN ({_list(STOP_WORDS)}) GROUP BY doc_id",
        "word_count": f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS n_words, length(trim(regexp_replace(text, '{_SPACE}', ' ', 'g'))) AS n_chars FROM documents",
        "postings": f"WITH {PLAIN_TEXT}, {TOKENS}, {STEMS} SELECT term, doc_id, count(*) AS tf, string_agg(pos, ',' ORDER BY pos) AS positions FROM terms GROUP BY term, doc_id",
        "term_stats": f"{INDEXED} {_TERM_STATS} GROUP BY term",
        "doc_stats": f"{INDEXED} SELECT doc_id, doc_len FROM lens",
        "corpus_stats": f"{INDEXED} SELECT count(*) AS n, round(avg(doc_len), 6) AS avgdl FROM lens",
        "remove_document": f"{INDEXED} {_TERM_STATS} WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'de') GROUP BY term",
        "replace_document": f"WITH txt AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'one new text for all of these' ELSE coalesce(text, '') END AS t FROM documents), {TOKENS}, {STEMS}, {POSTINGS} {_TERM_STATS} GROUP BY term",
        "index_incremental": f"""WITH txt AS (SELECT doc_id, CASE WHEN lang = 'fr' THEN 'one new text for all of these' ELSE coalesce(text, '') END AS t FROM documents WHERE lang IS DISTINCT FROM 'de'), {TOKENS}, {STEMS}, {POSTINGS}
          {_TERM_STATS} GROUP BY term""",
        "index_stream_search": f"{INDEXED}, {_bm25(PLAIN)} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm ORDER BY 2 DESC, 1 LIMIT 10",
        "vocab_prefix_topk": f"{INDEXED} SELECT term, count(*) AS doc_frequency FROM post WHERE starts_with(term, 'li') GROUP BY term ORDER BY 2 DESC, 1 LIMIT 10",
        "bm25_top10": f"{SEARCHED}, {_bm25(PLAIN)} SELECT doc_id, round(bm25, 6) AS bm25 FROM bm ORDER BY 2 DESC, 1 LIMIT 10",
        "search_default": _search(PLAIN),
        "search_negation": _search(["right", "license"], negative=["apache", "gnu"]),
        "search_site": _search(["license"], where="contains(domain, 'src1')"),
        "search_intitle": _search(["license", "version"], where="contains(lower(title), 'the')"),
        "search_inurl": _search(["license"], where="contains(url, '/en/')"),
        "search_date_range": _search(["license"], where="published_at BETWEEN TIMESTAMP '2025-03-01' AND TIMESTAMP '2025-09-30'"),
        "search_filetype": _search(["license"], where="doc_id % 4 = 0"),
        "search_safe": _search(["license", "right"], prelude=f", {_SPAM}", source="rated", spam="spam_score", quality="quality_score", where="spam_score <= 0.3"),
        "search_phrase_bonus": _search(PHRASED, phrases=PHRASE),
        "search_phrase_strict": _search(PHRASED, phrases=PHRASE, strict=True),
        "search_or": _search(["apache", "gnu"]),
        "search_page2": _search(PLAIN, offset=10),
        "search_total": f"{SEARCHED}, {_signals(PLAIN)} SELECT count(*) AS total FROM sig",
        "search_response": f"""{SEARCHED}, {_signals(PLAIN)}, shown AS (SELECT *, {_SCORE} AS score FROM sig ORDER BY score DESC, doc_id LIMIT 10)
          SELECT 'licensed apache rights' AS query, (SELECT count(*) FROM sig) AS total, 1 AS page, 10 AS "limit", row_number() OVER (ORDER BY score DESC, doc_id)::INT AS place, doc_id,
            CASE WHEN docs.title = '' THEN url ELSE docs.title END AS title, rtrim(replace(url, 'https://', ''), '/') AS display_url, score,
            round(bm25, 6) AS bm25, round(phrase, 6) AS phrase, round(pagerank, 6) AS pagerank, round(freshness, 6) AS freshness FROM shown JOIN docs USING (doc_id)""",
        "search_empty": "SELECT doc_id, 0.0::DOUBLE AS score FROM documents LIMIT 0",
        "search_batch_topk": f"{SEARCHED}, {BATCH} SELECT query_id, rank, doc_id, bm25 FROM best",
        "phrase_counts": f"WITH {PLAIN_TEXT}, {TOKENS}, {STEMS} SELECT a.doc_id, count(*) AS n FROM terms a JOIN terms b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 AND b.term = 'the' WHERE a.term = 'the' GROUP BY a.doc_id",
        "score_breakdown": f"{SEARCHED}, {_signals(PHRASED, phrases=PHRASE)} SELECT doc_id, {', '.join(f'round({c}, 6) AS {c}' for c in ('bm25', 'title', 'phrase', 'pagerank', 'freshness', 'quality', 'spam'))} FROM sig",
        "ltr_score": f"""{SEARCHED}, {_SPAM}, {_bm25(PLAIN)} SELECT doc_id, round(greatest(0.0::DOUBLE, 0.45::DOUBLE * bm25 + 0.20::DOUBLE * page_rank + 0.15::DOUBLE * quality_score
          - 0.30::DOUBLE * spam_score + 0.10::DOUBLE * least(10.0::DOUBLE, words / 500)), 6) AS score FROM bm JOIN rated USING (doc_id)""",
        "snippet": SNIPPETS,
        "highlight": f"SELECT doc_id, sha256({_bold('text', ['license', 'rights'], ['public license'])}) AS marked FROM documents",
        "suggest": f"""{INDEXED}, {LOG}, pop AS (SELECT 0 AS part, query AS suggestion, count(*) AS n FROM log WHERE starts_with(normalized_query, 'c') GROUP BY query ORDER BY n DESC, query LIMIT 8),
          voc AS (SELECT 1 AS part, term AS suggestion, count(*) AS n FROM post WHERE starts_with(term, 'c') GROUP BY term ORDER BY n DESC, term LIMIT 8),
          both_ AS (SELECT * FROM pop UNION ALL SELECT * FROM voc), once AS (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY suggestion ORDER BY part) = 1)
          SELECT row_number() OVER (ORDER BY part, n DESC, suggestion)::INT AS place, suggestion FROM once ORDER BY place LIMIT 8""",
        "popular_queries": f"WITH {LOG} SELECT query, count(*) AS n FROM log GROUP BY normalized_query, query ORDER BY n DESC, query LIMIT 8",
        "recent_searches": f"WITH {LOG} SELECT event_id, query, ts FROM log ORDER BY ts DESC, event_id DESC LIMIT 10",
        "top_domains": f"WITH {URLS} SELECT lower(regexp_extract(original, '{_GENERIC}', 2)) AS domain, count(*) AS documents FROM urls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
        "corpus_overview": f"""{INDEXED}, {_HREFS} SELECT (SELECT count(*) FROM documents) AS pages_crawled, (SELECT count(*) FROM lens) AS pages_indexed, (SELECT count(DISTINCT term) FROM post) AS unique_terms,
          (SELECT count(*) FROM events) AS searches, 0::BIGINT AS failed_urls, (SELECT count(*) FROM pages) AS queued_urls, (SELECT count(*) FROM hrefs) AS links""",
        "health": "SELECT 'healthy' AS status, 'lanternfish' AS app, false AS crawler_running, count(*) AS indexed_docs FROM documents",
        "latency_histogram": f"SELECT event_type AS query, {', '.join(f'count(*) FILTER (value <= {b}) AS le_{b}' for b in _BOUNDS)}, count(value) AS count, round(sum(value), 4) AS sum FROM events GROUP BY event_type",
        "log_redaction_json": "SELECT event_id, '{\"event\":\"' || event_type || '\",\"api_key\":\"[REDACTED]\",\"user\":\"' || user_id || '\"}' AS line FROM events",
        "url_normalize": f"WITH {URLS} SELECT page_id, url FROM urls",
        "url_domain": f"SELECT page_id, lower(regexp_extract(url, '{_GENERIC}', 2)) AS domain FROM pages",
        "display_url": "SELECT page_id, rtrim(replace(replace(url, 'https://', ''), 'http://', ''), '/') AS display_url FROM pages",
        "url_safety": f"WITH {URLS} SELECT page_id, kind IN ('http', 'https') AND host <> '' AND host <> 'localhost' AS safe FROM cleaned",
        "content_sha256": "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents",
        "exact_duplicates": "SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS keep_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
        "simhash64": f"WITH {SIMHASH} SELECT doc_id, h::VARCHAR AS simhash FROM sims",
        "near_duplicates": f"WITH {SIMHASH}, reps AS (SELECT h, min(doc_id) AS r FROM sims WHERE h <> 0 GROUP BY h) SELECT a.r AS a, b.r AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM reps a JOIN reps b ON a.r < b.r WHERE bit_count(xor(a.h, b.h)) <= 3",
        "page_title_lang": f"SELECT page_id, {_TITLE} AS title, CASE WHEN {_LANG} <> '' AND length({_LANG}) <= 8 THEN {_LANG} ELSE 'en' END AS language FROM pages",
        "page_hrefs": f"WITH {_HREFS} SELECT page_id, pos, href FROM hrefs",
        "link_first_use": f"WITH {_HREFS} SELECT page_id, href, min(pos) AS pos FROM hrefs GROUP BY page_id, href",
        "page_fields": f"""WITH {URLS}, kinds AS (SELECT page_id, kind FROM parts) SELECT page_id, 'About ' || page_id AS description, 'Writer ' || page_id AS author, 'https://canon.test/p' || page_id AS canonical_url,
          page_id % 5 = 0 AS noindex, page_id % 5 = 0 AS nofollow, CASE WHEN page_id % 5 = 0 THEN 0 END::INT AS n_links, 15::BIGINT AS n_images, kind || '://' || host || '/i/' || page_id || '.png' AS image_url, 320 AS width, 'pic' AS alt_text,
          CASE WHEN page_id % 3 = 0 THEN lower(regexp_extract(original, '{_GENERIC}', 2)) END AS publisher, CASE WHEN page_id % 3 = 0 THEN TIMESTAMP '2025-03-01 12:00:00' END AS published_date FROM urls JOIN kinds USING (page_id)""",
        "page_link_targets": f"""WITH {URLS}, {_HREFS}, kinds AS (SELECT page_id, kind FROM parts), told AS (SELECT url, kind || '://' || host AS site, regexp_replace(regexp_replace(replace(href, '&amp;', '&'), '#.*$', ''), ';[^/]*$', '') AS path FROM hrefs JOIN urls USING (page_id) JOIN kinds USING (page_id)
            WHERE href <> '' AND NOT starts_with(href, '#'))
          SELECT DISTINCT url AS source_url, site || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace(path, '/+', '/', 'g'), '(.)/$', '\\1') END AS target_url FROM told WHERE target_url <> url""",
        "pagerank": f"WITH {_pagerank(_GRAPH)} SELECT node, round(rank, 6) AS rank FROM ranked",
        "pagerank_documents": f"WITH {_pagerank(_SMALL_GRAPH)} SELECT node AS url, round(rank, 4) AS page_rank FROM ranked",
        "graph_degrees": f"""WITH {_GRAPH}, o AS (SELECT src AS node, count(*) AS n FROM edges GROUP BY src), i AS (SELECT dst AS node, count(*) AS n FROM edges GROUP BY dst)
          SELECT node, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, o.n IS NULL AS dangling FROM nodes LEFT JOIN o USING (node) LEFT JOIN i USING (node)""",
        "freshness": f"WITH {DOCS} SELECT doc_id, round({_fresh('published_at')}, 6) AS freshness FROM docs",
        "quality_score": f"WITH {DOCS}, {_SPAM} SELECT doc_id, round(quality_score, 6) AS quality FROM rated",
        "spam_score": f"WITH {DOCS}, {_SPAM} SELECT doc_id, round(spam_score, 6) AS spam FROM rated",
        "frontier_admit": f"""WITH {QUEUE} SELECT url, domain, priority, depth FROM queue WHERE domain <> '' AND depth <= 5 AND NOT contains(domain, 'spam') AND NOT contains(domain, 'pills')
          AND url NOT IN (SELECT url FROM queue WHERE contains(url, '/fr/')) QUALIFY row_number() OVER (PARTITION BY url ORDER BY priority DESC, depth) = 1""",
        "frontier_dispatch": f"WITH {QUEUE}, {ONCE} SELECT url, domain, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, discovered_at, url)::INT AS place FROM once QUALIFY place <= 2",
        "frontier_schedule": f"WITH {QUEUE}, {ONCE} SELECT url, domain, (row_number() OVER (PARTITION BY domain ORDER BY priority DESC, discovered_at, url) - 1)::DOUBLE AS wait_s FROM once",
        "link_priorities": "SELECT page_id, CASE WHEN contains(url, 'example.org') THEN 60 ELSE 40 END AS priority FROM pages",
        "next_crawl": f"""WITH {DOCS}, {_SPAM}, h AS (SELECT doc_id, quality_score, CASE WHEN language = 'es' THEN 6 WHEN doc_id % 9 = 0 THEN 24 WHEN doc_id % 9 + 1 <= 5 THEN 72 ELSE 168 END AS hours FROM rated)
          SELECT doc_id, (CASE WHEN quality_score > 1.2::DOUBLE THEN greatest(4, floor(hours * 0.7::DOUBLE)) ELSE hours END)::INT AS hours FROM h""",
        "recrawl_due": f"""WITH {DOCS} SELECT url, least(90, greatest(20, (page_rank * 20)::INT)) AS priority, TIMESTAMP '2025-12-04' AS next_crawl FROM (
          SELECT * FROM docs WHERE published_at <= TIMESTAMP '2025-12-01' ORDER BY published_at, url LIMIT 200)""",
        "recrawl_requeue": f"""WITH {DOCS}, {QUEUE}, due AS (SELECT * FROM docs WHERE published_at <= TIMESTAMP '2025-12-01' ORDER BY published_at, url LIMIT 200)
          SELECT url, domain, priority, depth, 'pending' AS status FROM queue
          UNION ALL SELECT url, domain, least(90, greatest(20, (page_rank * 20)::INT))::BIGINT, 0, 'pending' FROM due""",
        "image_search": f"WITH {DOCS} SELECT doc_id, url || '/1.png' AS image_url, title AS alt_text FROM docs WHERE contains(lower(title), 'the') ORDER BY doc_id LIMIT 20",
        "news_search": f"""WITH {DOCS} SELECT doc_id, title AS headline, url, domain AS publisher, NULL::VARCHAR AS author, published_at AS published_date, substr(content, 1, 200) AS snippet FROM docs
          WHERE contains(lower(title), 'rights reserved') OR contains(lower(content), 'rights reserved') ORDER BY published_at DESC, doc_id LIMIT 10""",
        "document_lookup": f"WITH {DOCS} SELECT doc_id, url, domain, title, language, published_at FROM docs WHERE doc_id = 7",
        "eval_queries": f"{JUDGE} SELECT query, round(precision, 6) AS precision, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall FROM each",
        "eval_summary": f"{JUDGE} SELECT {', '.join(f'round(avg({c}), 6) AS mean_{c}' for c in ('precision', 'reciprocal_rank', 'ndcg', 'recall'))} FROM each",
        "robots_rules": """SELECT page_id, NOT contains(url, 'spam') AND NOT regexp_matches(url, '^https?://[^/]*/fr/') AS allowed,
          CASE WHEN contains(url, 'spam') THEN 1.0 ELSE greatest(1.0, page_id % 4) END::DOUBLE AS crawl_delay, CASE WHEN contains(url, 'spam') THEN 0 ELSE 1 END AS sitemaps FROM pages""",
        "fetch_outcomes": """SELECT page_id, CASE WHEN contains(url, 'pills') THEN 'error' WHEN contains(url, 'spam') THEN 'http_error' WHEN ends_with(url, '/') THEN 'wrong_type' ELSE 'ok' END AS outcome,
          CASE WHEN contains(url, 'pills') THEN 2.25::DOUBLE END AS retry_after_s FROM pages""",
        "result_cache": "SELECT event_id AS key, event_type AS value FROM events WHERE ts + INTERVAL 1 HOUR > TIMESTAMP '2024-01-20'",
        "cache_eviction": """WITH live AS (SELECT * FROM events WHERE ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-05'), aged AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS age FROM live)
          SELECT event_id AS key, event_type AS value FROM aged WHERE age > CASE WHEN (SELECT count(*) FROM live) >= 1000 THEN 200 ELSE 0 END""",
        "engine_metrics": _METRICS,
        "crawl_activity": "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'failed' ELSE 'success' END AS status FROM pages ORDER BY page_id DESC, url LIMIT 50",
        "stream_index_counts": f"WITH {PLAIN_TEXT}, {TOKENS}, {STEMS} SELECT term, count(*) AS total_occurrences FROM terms GROUP BY term",
        "query_log_windows": f"WITH {LOG} SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, query, count(*) AS n, round(avg(latency_ms), 6) AS mean_latency FROM log GROUP BY ALL",
    }
