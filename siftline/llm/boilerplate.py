"""Problem 5: the lines of a page that belong to its site, not to the page.

Site style tree (Yi, Liu and Li 2003), merged from all pages of a host.

Where pages have a DOM (``html_lines``), the upper presentation nodes are the paths of elements, with
their classes; pages kept as text have none. Below stand, for each line that isn't prose, the
presentation nodes of how it begins (its first word, two words, three words), the content node of
its form (its words, with digits, the site's name and the page's title replaced by signs), and as
leaves the pairs of words in it.

The importance of a node comes from the entropy H of its occurrences over the host's pages: with
m pages it can be log m at most, when all pages have the node alike, as they have furniture; what H
lacks of that, log((m - 1) / (e^H - 1)), is the importance in nats. It is taken in the host, less a
standard error of the share of pages, and over all hosts that have the node, weighted by its
pages. Importance is composed from the leaves up: a content node has the lower one of its own and
of the median of its leaves. Branches of an importance below LEAST_IMPORTANCE are removed from the
top down, at any of the nodes by which a line is reached. The node of a first word alone goes where
the lines below it go on differently each time ("Related: ...").

An element of the DOM is a branch of low importance if the entropy of its contents is low: the
composite of that, and of its contents' importance where these are few, is below LEAST_ELEMENT.

Prose is never a node: lines with a real sentence stay, and so do lines that name a topic as titles do. What is real
is told by graded samples; sentences of words that these lack are told by their shape. As sentences begin alike, and
furniture has that shape too, lines with such sentences go by their content and its leaves alone.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import keyword_pages, prose
from siftline.storage import BROADCAST_KEYS, materialize, table, without_copies

#: Importance, in nats, below which a node is furniture: about one page in 12 of the host has it.
LEAST_IMPORTANCE = 2.5
#: The evidence that is asked for: pages of a host for its nodes to count among all hosts, or for the host to be
#: judged by itself; pages of a node on it, or in all hosts together.
COUNTED_HOST, OWN_HOST, OWN_PAGES, ALL_PAGES = 5, 20, 4, 5
#: Composite importance, of 0 to 1, below which an element goes, and how fast its contents stop to count for it
#: as they are more.
LEAST_ELEMENT, GAMMA = 0.35, 0.9
#: Words of a page below which it is a stub, which says nothing of its site and is left as it is.
STUB_WORDS = 8
#: A host's size is joined to its nodes in so many parts, since one host may have a large share of them.
SALTS = 16
#: Share of a line's pairs that must be furniture.
PAIRS = 0.5
#: Share of different forms among the lines that begin alike, for them to be furniture by their beginning.
VARIETY = 0.5
#: Pages whose titles must name a topic for a line of the same words to be the page's own.
TITLED = 3

TOKEN = re.compile(r"[^\W\d_]+|\d+|[»>]")
_TITLE_CUT = re.compile(r"\s+(?:[|–—-]|::)\s+")
#: Kinds of nodes: the whole line, a pair of words, a beginning of two or three words.
LINE, PAIR, START = 0, 1, 2
#: Kinds of rows: a line, a page, a topic in a title, a node and its pages, a line of prose in a DOM.
IS_LINE, IS_PAGE, IS_TOPIC, IS_NODE, IS_PROSE = 0, 1, 2, 3, 4


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z]+://|[/?#].*$", "", (url or "").strip().lower())


def plain(text: str) -> str:
    """Small letters without entities; UTF-8 that was read as another encoding is read again."""
    if any(c in text for c in "ÃÂâ"):
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    return unicodedata.normalize("NFKC", html.unescape(text)).lower().strip()


def signs(line: str, site: str, title: str) -> list[str]:
    """The words of a line: a run of numbers as #, the site's name as @, the page's title as one sign."""
    line = plain(line)
    if len(title) > 3:
        line = line.replace(title, " titlesign ")
    out: list[str] = []
    for t in TOKEN.findall(line):
        t = "#" if t.isdigit() else "@" if t == site else t
        if t != "#" or not out or out[-1] != "#":
            out.append(t)
    return out


def _key(*words: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - 2**63


def nodes_of(words: list[str]) -> tuple[list[int], list[int]]:
    """The kinds and keys of the nodes of a line: its content node, its leaves, and how it begins."""
    edged = ["^", *words, "$"]
    pairs = sorted({_key("pair", a, b) for a, b in zip(edged, edged[1:])})
    starts = [_key("start", *words[:n]) for n in (2, 3) if len(words) >= n]
    return [LINE] + [PAIR] * len(pairs) + [START] * len(starts), [_key("line", *words), *pairs, *starts]


_LINES = pa.schema(
    [("kind", pa.int32()), ("table_name", pa.string()), ("row_id", pa.int64()), ("line_no", pa.int32()), ("host", pa.string()), ("form", pa.int64()),
     ("k", pa.int64()), ("c", pa.int64()), ("s", pa.float64()), ("path", pa.int64()), ("first", pa.string()), ("n_pairs", pa.int32()), ("kinds", pa.list_(pa.int32())), ("keys", pa.list_(pa.int64())), ("shaped", pa.bool_())]
)
_LINES_DDL = "kind int, table_name string, row_id long, line_no int, host string, form long, k long, c long, s double, path long, first string, n_pairs int, kinds array<int>, keys array<long>, shaped boolean"
TOGETHER, REMEMBERED = 500, 1_000_000


def page_lines(pages: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows of ``pages`` (table_name, row_id, url, title, text, and paths where there is a DOM), without
    stubs: each line that isn't prose or blank, with its nodes where the task meets its form on the
    host for the first time, and whether it is shaped as a sentence; one row for the page; one for each
    topic that its title names; and for each node (form) of a host, within the task, the number k of
    pages that have it, its occurrences c, and the sum s of n log n over the pages, n its occurrences on
    a page."""
    known = pages.sparkSession.sparkContext.broadcast(prose.load(samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[str, int]] = set()
        known_nodes: dict[int, tuple[list[int], list[int]]] = {}
        counts: dict[tuple[str, int], list] = {}

        def counted() -> pa.RecordBatch:
            n = len(counts)
            columns = {"kind": [IS_NODE] * n, "host": [h for h, _ in counts], "form": [x for _, x in counts], **{c: [x[j] for x in counts.values()] for j, c in enumerate("kcs")}}
            out = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _LINES]
            counts.clear()
            return pa.RecordBatch.from_arrays(out, schema=_LINES)

        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(lo, TOGETHER).to_pydict()
                texts = [(t or "").split("\n") for t in some["text"]]
                flat = [line for lines in texts for line in lines]
                s = prose.Sentences(flat, known.value)
                real = np.bincount(s.owner, s.real(), len(flat)).astype(int)
                words_of = np.bincount(s.owner, s.size, len(flat))
                rows: list[tuple] = []
                at = 0
                for name, row_id, url, title, lines, text, paths in zip(some["table_name"], some["row_id"], some["url"], some["title"], texts, some["text"], some["paths"]):
                    own, n_words = real[at : at + len(lines)], words_of[at : at + len(lines)].sum()
                    at += len(lines)
                    if n_words < STUB_WORDS:
                        continue
                    if prose.may_be_foreign(text, int(own.sum())) and (found := prose.foreign(text, known.value)):
                        own = own + np.array([n for n, _ in found])
                    path_of = [_key("path", p) for p in paths] if paths else None
                    host = host_of(url)
                    site = host.split(".")[-2] if "." in host else host
                    title = plain(title or "")
                    rows.append((IS_PAGE, name, row_id, -1, host, *[None] * 6, 0, *[None] * 3))
                    for topic in {tuple(signs(x, site, "")) for x in _TITLE_CUT.split(title)} if title else ():
                        if topic:
                            rows.append((IS_TOPIC, name, row_id, -1, host, _key("line", *topic), *[None] * 5, 0, *[None] * 3))
                    here: Counter = Counter()
                    for n, line in enumerate(lines):
                        if not line.strip():
                            continue
                        path = path_of[n] if path_of else None
                        if own[n]:
                            if path_of:
                                rows.append((IS_PROSE, name, row_id, n, host, _key("prose", line), None, None, None, path, None, 0, *[None] * 3))
                            continue
                        words = signs(line, site, title)
                        form = _key("line", *words)
                        if form not in known_nodes:
                            if len(known_nodes) > REMEMBERED // 10:
                                known_nodes.clear()
                            known_nodes[form] = nodes_of(words)
                        kinds, keys = known_nodes[form]
                        here.update(keys)
                        if (host, form) in sent:
                            kinds = keys = None
                        else:
                            if len(sent) > REMEMBERED:
                                sent.clear()
                            sent.add((host, form))
                        rows.append((IS_LINE, name, row_id, n, host, form, None, None, None, path, words[0] if words else "", kinds.count(PAIR) if kinds else 0, kinds, keys, bool(prose.shaped(line))))
                    for key, n in here.items():
                        if (sums := counts.get((host, key))) is None:
                            counts[host, key] = sums = [0, 0, 0.0]
                        sums[0] += 1
                        sums[1] += n
                        if n > 1:
                            sums[2] += n * math.log(n)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _LINES)], schema=_LINES)
                if len(counts) > REMEMBERED:
                    yield counted()
        yield counted()

    paths = F.col("paths") if "paths" in pages.columns else F.lit(None).cast("array<string>").alias("paths")
    return pages.select("table_name", "row_id", "url", "title", "text", paths).mapInArrow(run, _LINES_DDL)


def site_lines(pages: DataFrame, samples: DataFrame) -> DataFrame:
    """(table_name, row_id, line_no): the lines that belong to the site.

    ``pages`` has table_name, row_id, url, title and text; ``samples`` has sample_id, lang and text of
    graded prose; where the text comes from a DOM, paths has the element of each line. Lines count from
    0 after splitting at line feeds. Blank lines are never given, nor lines of stubs (fewer than
    STUB_WORDS words: error and waiting pages, empty and null texts). Pages with a null or empty url
    share one host. Rows of a table that are delivered twice must have been dropped; further columns
    are ignored.
    """
    rows = materialize(page_lines(pages, samples), "page-lines")
    lines = rows.where(F.col("kind") == IS_LINE)
    hosts = rows.where(F.col("kind") == IS_PAGE).groupBy("host").agg(F.count("*").alias("m"))
    topics = rows.where(F.col("kind") == IS_TOPIC).groupBy("form").agg(F.count("*").alias("c")).where(F.col("c") >= TITLED).select("form")
    forms = (
        lines.groupBy("host", "form")
        .agg(
            F.first("first").alias("first"), F.max("n_pairs").alias("n_pairs"),
            F.first("kinds", ignorenulls=True).alias("kinds"), F.first("keys", ignorenulls=True).alias("keys"), F.max("shaped").alias("shaped"),
        )
        .join(topics, "form", "left_anti")
    )
    forms = materialize(forms, "line-forms")
    parts = forms.select("host", "form", "n_pairs", "shaped", F.explode(F.arrays_zip("kinds", "keys")).alias("n")).select(
        "host", "form", "n_pairs", F.col("n.kinds").alias("kind"), F.col("n.keys").alias("node"), "shaped"
    ).where((F.col("kind") != START) | ~F.col("shaped")).drop("shaped")
    nodes = rows.where(F.col("kind") == IS_NODE).groupBy("host", F.col("form").alias("node")).agg(F.sum("k").alias("k"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    nodes = sized(nodes, hosts)
    low = low_nodes(nodes)
    hit = parts.join(low, ["host", "node"], "left_semi").groupBy("host", "form").agg(
        F.max(F.when(F.col("kind") != PAIR, 1).otherwise(0)).alias("whole"), F.sum(F.when(F.col("kind") == PAIR, 1).otherwise(0)).alias("pairs"), F.max("n_pairs").alias("n_pairs")
    )
    by_node = hit.where((F.col("whole") == 1) | (F.col("pairs") >= PAIRS * F.col("n_pairs"))).select("host", "form")
    # what is left, by its first word
    left = forms.join(by_node, ["host", "form"], "left_anti").where((F.col("first") != "#") & ~F.col("shaped")).select("host", "form", "first")
    begun_pages = lines.select("host", "form", "table_name", "row_id").join(left, ["host", "form"]).select("host", "first", "table_name", "row_id").distinct()
    begun = begun_pages.groupBy("host", "first").agg(F.count("*").alias("k")).join(left.groupBy("host", "first").agg(F.count("*").alias("forms")), ["host", "first"])
    begun = begun.withColumnRenamed("first", "node").withColumns({"c": F.col("k"), "s": F.lit(0.0)})
    alike = spread_over_hosts(sized(begun, hosts), F.sum("forms").alias("forms"))
    alike = alike.where(f"seen >= {ALL_PAGES} and importance < {LEAST_IMPORTANCE} and forms >= {VARIETY} * seen").select(F.col("node").alias("first"))
    by_first = left.join(alike, "first", "left_semi").select("host", "form")
    furniture = by_node.unionByName(by_first)
    removed = lines.join(furniture, ["host", "form"], "left_semi").select("table_name", "row_id", "line_no")
    if "paths" not in pages.columns:
        return removed
    elements = low_elements(rows, nodes, hosts)
    inside = rows.where(F.col("kind").isin(IS_LINE, IS_PROSE)).join(elements, ["host", "path"], "left_semi")
    return removed.unionByName(inside.select("table_name", "row_id", "line_no")).distinct()


def sized(counted: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows (host, node, k, c, s) with the pages m of their host, and share: by how many pages, of all but one, the
    node is spread, going by its entropy."""
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    both = counted.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"]).drop("salt")
    entropy = F.log("c") - F.col("s") / F.col("c")
    # e^H is k where each page has the node once
    spread = F.when(F.col("s") == 0, F.col("k").cast("double")).otherwise(F.exp(entropy))
    return both.withColumn("share", (spread - 1) / (F.col("m") - 1))


def low_elements(rows: DataFrame, nodes: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, path): the elements of low composite importance, as in the style tree: the entropy of the contents
    over the pages, and the importance of the contents, which counts the less the more there are."""
    content = rows.where(F.col("kind").isin(IS_LINE, IS_PROSE) & F.col("path").isNotNull()).groupBy("host", "path", F.col("form").alias("node")).agg(F.count("*").alias("n"))
    share = nodes.select("host", "node", F.greatest(F.lit(0.0), -F.log("share")).alias("own"))
    known = content.join(share, ["host", "node"], "left")
    sums = known.groupBy("host", "path").agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.col("own")).alias("own"), F.sum(F.when(F.col("own").isNull(), F.col("n")).otherwise(0)).alias("once")
    ).join(F.broadcast(hosts.where(F.col("m") >= OWN_HOST)) if hosts.count() <= BROADCAST_KEYS else hosts.where(F.col("m") >= OWN_HOST), "host")
    most = F.log("m")
    node = F.least(F.lit(1.0), (F.log("all") - F.col("s") / F.col("all")) / most)
    children = F.least(F.lit(1.0), (F.coalesce("own", F.lit(0.0)) / most + F.col("once")) / F.col("all"))
    weight = F.pow(F.lit(GAMMA), F.col("kinds"))
    return sums.where((1 - weight) * node + weight * children < LEAST_ELEMENT).select("host", "path")


def spread_over_hosts(nodes: DataFrame, *more) -> DataFrame:
    """(node, importance, seen) of rows of ``sized``: the importance in the hosts that have enough pages, weighted
    by the node's pages on each, and those pages."""
    c = nodes.where(F.col("m") >= COUNTED_HOST)
    share = F.sum(F.col("k") * F.col("share")) / F.sum("k")
    return c.groupBy("node").agg(F.sum("k").alias("seen"), F.when(share > 0, -F.log(share)).alias("importance"), *more)


def low_nodes(nodes: DataFrame) -> DataFrame:
    """(host, node) of rows of ``sized``: the nodes of low importance of each host, by its own pages or by those of
    all hosts."""
    everywhere = spread_over_hosts(nodes).where(f"seen >= {ALL_PAGES} and importance < {LEAST_IMPORTANCE}").select("node")
    share = F.least(F.col("share"), F.lit(1.0))
    # the share that is likely at least, so that a few pages of a small host don't decide
    sure = share - F.sqrt(share * (1 - share) / F.col("m"))
    own = nodes.where((F.col("m") >= OWN_HOST) & (F.col("k") >= OWN_PAGES) & (sure > 0) & (-F.log(sure) < LEAST_IMPORTANCE))
    return nodes.join(everywhere, "node", "left_semi").select("host", "node").unionByName(own.select("host", "node")).distinct()


# Elements that begin a line of text, and those whose content is none.
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "dd", "div", "dl", "dt", "figcaption", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
    "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}
_NO_TEXT = {"script", "style", "noscript", "template", "svg", "head"}


class _Lines(HTMLParser):
    """The blocks of a page, and the path of elements with their classes that leads to each."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.lines: list[str] = []
        self.paths: list[str] = []
        self.title = ""
        self.text: list[str] = []

    def end_line(self) -> None:
        if line := " ".join("".join(self.text).split()):
            self.lines.append(line)
            self.paths.append("/".join(p for _, p in self.open if p))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        block = tag in _BLOCKS
        if block or tag in ("br", "hr"):
            self.end_line()
        if tag not in ("br", "hr", "img", "input", "link", "meta", "base", "area", "col", "source", "wbr"):
            kind = dict(attrs).get("class") or dict(attrs).get("role") or ""
            self.open.append((tag, f"{tag}.{kind}" if block else ""))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS or tag in ("br", "hr"):
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            if tag in _BLOCKS:
                self.end_line()
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data: str) -> None:
        inside = {t for t, _ in self.open}
        if "title" in inside:
            self.title += data
        elif not inside & _NO_TEXT:
            self.text.append(data)


def html_lines(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(table_name, row_id, url, title, text, paths) of pages as HTML: one line of text for each block of the DOM, and
    the path of its element. Null and empty pages have an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles, texts, paths = [], [], []
            for page in batch.column(2).to_pylist():
                parser = _Lines()
                parser.feed(page or "")
                parser.close()
                parser.end_line()
                titles.append(parser.title.strip())
                texts.append("\n".join(parser.lines))
                paths.append(parser.paths)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(titles), pa.array(texts), pa.array(paths, pa.list_(pa.string()))], ["row_id", "url", "title", "text", "paths"])

    made = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(html_col)).mapInArrow(run, "row_id long, url string, title string, text string, paths array<string>")
    return made.select(F.lit("html").alias("table_name"), "*")


def pages_of(spark: SparkSession, sf_dir: str, *, with_keyword_pages: bool = False) -> DataFrame:
    """(table_name, row_id, url, title, text) of docs, without the pages of problem 3, and parsed_html."""
    docs = without_copies(table(spark, sf_dir, "docs").select("doc_id", "url", "title", "body"), "doc_id")
    if not with_keyword_pages:
        docs = docs.join(keyword_pages.p3_found(spark, sf_dir), "doc_id", "left_anti")
    parsed = without_copies(table(spark, sf_dir, "parsed_html").select("page_id", "url", "title", "body_text"), "page_id")
    return docs.select(F.lit("docs").alias("table_name"), F.col("doc_id").alias("row_id"), "url", "title", F.col("body").alias("text")).unionByName(
        parsed.select(F.lit("parsed_html").alias("table_name"), F.col("page_id").alias("row_id"), "url", "title", F.col("body_text").alias("text"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, row_id, line_no) of the lines of docs.body and parsed_html.body_text that belong to the site."""
    return site_lines(pages_of(spark, sf_dir), table(spark, sf_dir, "reading_samples"))


def main_text(pages: DataFrame, removed: DataFrame) -> DataFrame:
    """(table_name, row_id, main_text): each page's text without the removed lines and blank ones, in its
    order. A null text stays null; a page of which every line goes has an empty text."""
    gone = removed.groupBy("table_name", "row_id").agg(F.collect_set("line_no").alias("gone"))  # bounded by the page
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i) & (F.trim(x) != ""))
    joined = pages.join(gone, ["table_name", "row_id"], "left")
    return joined.select("table_name", "row_id", F.when(F.col("text").isNotNull(), F.array_join(lines, "\n")).alias("main_text"))


def p5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of docs and parsed_html; pages of problem 3 and stubs keep theirs."""
    return main_text(pages_of(spark, sf_dir, with_keyword_pages=True), p5_found(spark, sf_dir))
