"""Pages to structured records, in Arrow batches, on the standard library's HTML reader.

A tree is built with the usual implied ends (a paragraph ends where a block
starts, a list item where the next begins).  Browsers' further repairs are not
imitated.
"""

from __future__ import annotations

import re
from datetime import datetime, timezone
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternfish.functions.urls import joined, normalize

#: Elements without content, elements that end a paragraph, elements
#: and names of noise, and the blocks of readable text.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_ENDING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
STRIPPED = set("script style noscript svg header footer nav aside form button iframe menu template".split())
NOISE = re.compile(r"(cookie|banner|consent|gdpr|newsletter|subscribe|advert|ad-|ad_|sidebar|popup|modal|share|social)", re.IGNORECASE)
BLOCKS = set("h1 h2 h3 h4 h5 h6 p li blockquote".split())
IGNORED_LINKS = ("#", "javascript:", "mailto:", "tel:")
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"\w+")

SCHEMA = (
    "url string, canonical_url string, title string, description string, language string, author string, published_date timestamp, "
    "noindex boolean, nofollow boolean, images array<struct<image_url:string,alt_text:string,title:string,width:int,height:int,surrounding_text:string>>, "
    "links array<struct<url:string,anchor:string>>, main_text string, word_count bigint, is_news boolean, news_headline string, news_publisher string"
)


class Node:
    """An element: its tag, attributes and children (elements and strings)."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self):
        """All elements below, in document order."""
        stack = [iter(self.children)]
        while stack:
            for child in stack[-1]:
                if isinstance(child, Node):
                    yield child
                    stack.append(iter(child.children))
                    break
            else:
                stack.pop()

    def strings(self):
        stack: list[Node | str] = [self]
        while stack:
            at = stack.pop()
            if isinstance(at, str):
                yield at
            elif at is self or at.tag not in ("script", "style", "template"):
                stack += reversed(at.children)

    def text(self, between: str = " ") -> str:
        return between.join(s for x in self.strings() if (s := x.strip()))

    def first(self, tag: str, test=lambda n: True) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag and test(n)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("", {}, None)

    def _close(self, tags: set[str], limit: set[str]) -> None:
        at = self.here
        while at.parent is not None and at.tag not in limit:
            if at.tag in tags:
                self.here = at.parent
                return
            at = at.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, {"button", "table", "td", "th"})
        if tag in SELF_ENDING:
            same = {"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}
            self._close(same, SELF_ENDING[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = self.here
        while at.parent is not None:
            if at.tag == tag:
                self.here = at.parent
                return
            at = at.parent

    def handle_data(self, data):
        self.here.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _number(text: str | None) -> int | None:
    digits = re.sub(r"[^0-9]", "", text or "")
    return int(digits[:9]) if digits else None


def _date(text: str) -> datetime | None:
    try:
        at = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at


def _images(root: Node, base: str) -> list[dict]:
    out = []
    for img in root.walk():
        source = img.attrs.get("src") or img.attrs.get("data-src") if img.tag == "img" else None
        url = normalize(joined(base, source)) if source else ""
        if url and not url.startswith("data:"):
            out.append({
                "image_url": url, "alt_text": img.attrs.get("alt", "").strip(), "title": img.attrs.get("title", "").strip(),
                "width": _number(img.attrs.get("width")), "height": _number(img.attrs.get("height")), "surrounding_text": img.parent.text()[:250],
            })
    return out


def _links(root: Node, base: str, own: str) -> list[dict]:
    found: dict[str, str] = {}
    for a in root.walk():
        href = a.attrs.get("href", "").strip() if a.tag == "a" else ""
        if not href or href.startswith(IGNORED_LINKS):
            continue
        url = normalize(joined(base, href))
        if url and url != own and url not in found and "nofollow" not in a.attrs.get("rel", "").lower():
            found[url] = a.text()[:200]
    return [{"url": u, "anchor": t} for u, t in found.items()]


def _without_noise(node: Node) -> None:
    kept = []
    for child in node.children:
        if isinstance(child, Node):
            if child.tag in STRIPPED or any(NOISE.search(x) for x in child.attrs.get("class", "").split() + [child.attrs.get("id", "")]):
                continue
        kept.append(child)
    node.children = kept
    # Documents may nest deeply, so this goes level by level without recursion.


def _main_text(root: Node) -> str:
    pending = [root]
    while pending:
        node = pending.pop()
        _without_noise(node)
        pending += [c for c in node.children if isinstance(c, Node)]
    content = root.first("article") or root.first("main") or root.first("body") or root
    blocks = [t for n in content.walk() if n.tag in BLOCKS and len(t := n.text()) > 10]
    return _SPACE.sub(" ", "\n\n".join(blocks) if blocks else content.text())


def parse_page(html: str | None, base: str | None) -> dict:
    """One page's record; a page without HTML has its URL and defaults only."""
    base = base or ""
    own = normalize(base)
    page = dict.fromkeys(f.split(" ")[0] for f in re.sub(r"<[^ ]*>", "", SCHEMA).split(", "))
    page |= {"url": own, "title": "", "description": "", "language": "en", "noindex": False, "nofollow": False, "images": [], "links": [], "main_text": "", "word_count": 0, "is_news": False}
    if not html:
        return page
    root = tree(html)
    metas = [n for n in root.walk() if n.tag == "meta"]
    named = lambda key, value: next((m.attrs.get("content", "") for m in metas if m.attrs.get(key) == value), None)
    robots = " ".join(m.attrs.get("content", "").lower() for m in metas if "robots" in m.attrs.get("name", "").lower())
    page["noindex"], page["nofollow"] = "noindex" in robots, "nofollow" in robots
    canonical = root.first("link", lambda n: "canonical" in n.attrs.get("rel", "").lower())
    if canonical and canonical.attrs.get("href"):
        page["canonical_url"] = normalize(joined(base, canonical.attrs["href"]))
    title, heading, og_title = root.first("title"), root.first("h1"), named("property", "og:title")
    if title and len(title.children) == 1 and isinstance(title.children[0], str):
        page["title"] = title.children[0].strip()
    elif og_title is not None:
        page["title"] = og_title.strip()
    elif heading:
        page["title"] = heading.text("")
    described = named("name", "description")
    page["description"] = ((named("property", "og:description") if described is None else described) or "").strip()
    html_tag = root.first("html")
    language = html_tag.attrs.get("lang", "").split("-")[0].strip().lower() if html_tag else ""
    if 0 < len(language) <= 8:
        page["language"] = language
    author = named("name", "author")
    page["author"] = ((named("property", "article:author") if author is None else author) or "").strip() or None
    published = named("property", "article:published_time")
    page["published_date"] = _date((named("name", "pubdate") if published is None else published) or "")
    page["images"] = _images(root, base)
    page["links"] = [] if page["nofollow"] else _links(root, base, own)
    page["main_text"] = _main_text(root)
    page["word_count"] = len(_WORDS.findall(page["main_text"]))
    if "article" in (named("property", "og:type") or "").lower() or page["published_date"]:
        host = re.match(r"[^/?#]*//([^/?#]*)", base)
        page |= {"is_news": True, "news_headline": page["title"], "news_publisher": named("property", "og:site_name") or (host[1].lower() if host else "")}
    return page


_IMAGE = pa.struct([("image_url", pa.string()), ("alt_text", pa.string()), ("title", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("surrounding_text", pa.string())])
_ARROW = {"published_date": pa.timestamp("us", tz="UTC"), "noindex": pa.bool_(), "nofollow": pa.bool_(), "is_news": pa.bool_(), "word_count": pa.int64(), "images": pa.list_(_IMAGE), "links": pa.list_(pa.struct([("url", pa.string()), ("anchor", pa.string())]))}


def _parse(batches):
    for batch in batches:
        pages = [parse_page(h, u) for h, u in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
        names = list(parse_page(None, None))
        columns = [pa.array([p[n] for p in pages], _ARROW.get(n, pa.string())) for n in names]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["page_id", *names])


def parse(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One record per page: page_id and the columns of ``SCHEMA``."""
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(_parse, f"page_id bigint, {SCHEMA}")


def images(parsed: DataFrame, per_page: int = 15) -> DataFrame:
    """(doc_id, page_url, image columns): the first images of each page."""
    return parsed.select(F.col("page_id").alias("doc_id"), F.col("url").alias("page_url"), F.inline(F.slice("images", 1, per_page)))


def news(parsed: DataFrame) -> DataFrame:
    """(doc_id, headline, publisher, author, published_date) of the news pages."""
    return parsed.where("is_news").select(F.col("page_id").alias("doc_id"), F.col("news_headline").alias("headline"), F.col("news_publisher").alias("publisher"), "author", "published_date")


def page_links(parsed: DataFrame) -> DataFrame:
    """(source_url, target_url, anchor_text), unique by the two URLs."""
    rows = parsed.select(F.col("url").alias("source_url"), F.inline("links")).select("source_url", F.col("url").alias("target_url"), F.col("anchor").alias("anchor_text"))
    return rows.groupBy("source_url", "target_url").agg(F.min("anchor_text").alias("anchor_text"))


# Single fields without a tree, inside the JVM; enough where pages are plain.


def title_of(html: Column) -> Column:
    raw = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(char))
    return raw


def language_of(html: Column) -> Column:
    found = F.lower(F.split(F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([^\"'\s>]+)", 1), "-")[0])
    return F.when((found != "") & (F.length(found) <= 8), found).otherwise("en")


def hrefs_of(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), 1)
