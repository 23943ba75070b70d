"""Raw pages: what a crawler fetches, parsed into title, description, links and text.

HTML has no Spark expression, so pages are parsed in Arrow batches by the standard library's parser.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements whose content is no text of the page, and links that lead to no page.
STRIPPED = {"script", "style", "noscript", "svg", "header", "footer", "nav", "aside", "form"}
NO_LINK = ("#", "javascript:", "mailto:", "tel:")
ANCHOR_LENGTH = 200
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Page(HTMLParser):
    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url = url
        self.titles: list[str] = []
        self.heads: list[list[str]] = []
        self.meta: dict[str, str] = {}
        self.links: list[tuple[str, list[str]]] = []
        self.text: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = {k: v or "" for k, v in reversed(attrs)}
        if tag == "title" and "svg" not in self.open:
            self.titles.append("")
        if tag == "h1":
            self.heads.append([])
        if tag == "meta" and (content := values.get("content")):
            for kind, pattern in (("name", "description"), ("property", "og:description")):
                if re.search(pattern, values.get(kind, ""), re.I):
                    self.meta.setdefault(kind, content)
        if tag == "a" and "href" in values:
            self.links.append((values["href"].strip(), []))
        if tag not in _VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if "title" in self.open and self.titles:
            self.titles[-1] += data
        if "h1" in self.open:
            self.heads[-1].append(data)
        if "a" in self.open and self.links:
            self.links[-1][1].append(data)
        if data.strip() and not STRIPPED.intersection(self.open):
            self.text.append(data.strip())


def parse_page(url: str | None, text: str | None) -> dict:
    """title, description, body_text, links (target_url, anchor_text) and word_count of one page.

    The title is that of the first title element, else of the first h1. Links count wherever they stand,
    without fragments and parameters; only those over http and https do. Null and empty pages are empty.
    """
    url = url or ""
    page = _Page(url)
    if text:
        page.feed(text)
        page.close()
    title = page.titles[0].strip() if page.titles and page.titles[0] else "".join(page.heads[0]).strip() if page.heads else ""
    links = []
    for href, anchor in page.links:
        if href.startswith(NO_LINK):
            continue
        try:
            target = urlsplit(urljoin(url, href))
        except ValueError:
            continue
        if target.scheme in ("http", "https"):
            # parameters belong to the last part of the path only
            head, slash, last = target.path.rpartition("/")
            path = head + slash + last.partition(";")[0]
            links.append({"target_url": f"{target.scheme}://{target.netloc}{path}" + (f"?{target.query}" if target.query else ""), "anchor_text": "".join(anchor).strip()[:ANCHOR_LENGTH]})
    body = re.sub(r"\s+", " ", " ".join(page.text))
    description = page.meta.get("name", page.meta.get("property", "")).strip()
    return {"title": title, "description": description, "body_text": body, "links": links, "word_count": len(body.split())}


_SCHEMA = "title string, description string, body_text string, links array<struct<target_url: string, anchor_text: string>>, word_count int"


def fetched(pages: DataFrame) -> DataFrame:
    """Of (url, html, status, content_type) the pages that were fetched as HTML. A missing content type counts as such."""
    kind = F.lower(F.coalesce("content_type", F.lit("text/html")))
    return pages.where(F.col("html").isNotNull() & (F.coalesce("status", F.lit(500)) < 400) & (kind.contains("text/html") | kind.contains("application/xhtml")))


def parse_html(pages: DataFrame, id_col: str, url: Column, html: Column) -> DataFrame:
    """(id_col, url, title, description, body_text, links, word_count): each page parsed."""
    kind = dict(pages.dtypes)[id_col]
    columns = pa.schema(
        [("title", pa.string()), ("description", pa.string()), ("body_text", pa.string()), ("links", pa.list_(pa.struct([("target_url", pa.string()), ("anchor_text", pa.string())]))), ("word_count", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_page(u, t) for u, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r[f.name] for r in rows], f.type) for f in columns]], [id_col, "url", *columns.names])

    return pages.select(id_col, url.alias("url"), html.alias("html")).mapInArrow(run, f"`{id_col}` {kind}, url string, {_SCHEMA}")


def links_of(parsed: DataFrame) -> DataFrame:
    """(source_url, target_url, anchor_text, ord): the links of parsed pages, in page order."""
    return parsed.select(F.col("url").alias("source_url"), F.posexplode("links").alias("ord", "l")).select("source_url", "l.target_url", "l.anchor_text", "ord")


def first_links(links: DataFrame, order: str) -> DataFrame:
    """(source_url, target_url, anchor_text): each pair once, with the anchor that comes first by ``order``, then
    by itself."""
    anchor = F.min_by("anchor_text", F.struct(F.col(order).isNull(), F.col(order), F.col("anchor_text")))
    return links.groupBy("source_url", "target_url").agg(anchor.alias("anchor_text"))


def allowed(urls: DataFrame, rules: DataFrame, *, agent: str = "siftline") -> DataFrame:
    """(url, allowed): what robots rules let a crawler fetch.

    ``rules`` has domain_key (scheme and host), agent, ord, allow and path_prefix. Of the rules for the
    agent on the url's site, or else of those for *, the first whose prefix the path begins with
    decides; without any, or without rules, all is allowed.
    """
    key = F.concat(F.call_function("try_parse_url", F.col("url"), F.lit("PROTOCOL")), F.lit("://"), F.call_function("try_parse_url", F.col("url"), F.lit("AUTHORITY")))
    path = F.coalesce(F.nullif(F.call_function("try_parse_url", F.col("url"), F.lit("FILE")), F.lit("")), F.lit("/"))
    u = urls.select("url").distinct().select("url", key.alias("domain_key"), path.alias("path"))
    mine = rules.where(F.lit(agent.lower()).contains(F.lower("agent")) & (F.col("agent") != "*"))
    own = mine.unionByName(rules.where("agent = '*'").join(mine.select("domain_key").distinct(), "domain_key", "left_anti"))
    hits = u.join(own, "domain_key").where(F.col("path").startswith(F.col("path_prefix")) & (F.col("path_prefix") != ""))
    decided = hits.groupBy("url").agg(F.min_by("allow", "ord").alias("allow"))
    return u.select("url").join(decided, "url", "left").select("url", F.coalesce("allow", F.lit(True)).alias("allowed"))
