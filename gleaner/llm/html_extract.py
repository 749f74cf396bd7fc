"""Site template removal: element subtrees that recur across many pages of a host are deleted, the rest is the text.

Every page is parsed into a tree. Each element's subtree is hashed from its tag, its class and the hashes below it;
a page counts a hash once, and pages of one content (the same main part, or the same page) count as one. Spark sums the
counts per host. A subtree is a template if it stands on at least `min_pages` pages and on `min_share` of the host's
pages; the share bounds the templates a page of a large host is held against. Nothing inside an article or main part is
a template. Elements that name their role (nav, footer, a class `ad`, comments, …) go as well: on a host with few pages
nothing can recur.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.shared import small, written
from gleaner.llm.url_filter import host_of

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hr main menu nav ol p pre section table ul".split())
DROPPED = frozenset("nav footer aside form button select option dialog menu head script style noscript template iframe svg textarea title "
                    "object canvas audio video input".split())
ROLES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner navigation nav navbar menu breadcrumb "
                  "breadcrumbs sidebar side-bar footer header masthead cookie cookies cookie-notice cookie-banner consent notice notices alert popup modal "
                  "newsletter subscribe share sharing social comment comments comment-list disqus related search complementary contentinfo".split())
ROLE_PARTS = frozenset("ad ads advert advertisement sponsor sponsored promo navigation nav navbar menu breadcrumb breadcrumbs sidebar footer cookie cookies "
                       "consent newsletter subscribe share sharing social comment comments disqus related popup modal".split())
_PARTS = re.compile(r"[\s_-]+")
MAIN = frozenset(("article", "main"))


class Node:
    __slots__ = ("tag", "names", "children", "main", "hash")

    def __init__(self, tag: str, names: str):
        self.tag, self.names, self.children, self.main, self.hash = tag, names, [], tag in MAIN, 0


def parse(html: str) -> Node:
    """A forgiving tree: a missing end tag is supplied where its parent ends or a block follows a paragraph."""
    root = Node("#root", "")
    stack, at, end = [root], 0, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in MAIN and tag not in MAIN and tag not in ("body", "html", "div", "section"):
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, "p", ("table", "td", "th", "button", "li", "article", "main", "div", "section", "blockquote"))
        if tag in ("li", "option", "tr"):
            _close(stack, tag, ("ul", "ol", "select", "table", "menu", "tbody", "thead"))
        elif tag in ("dt", "dd"):
            _close(stack, "dt", ("dl",))
            _close(stack, "dd", ("dl",))
        elif tag in ("td", "th"):
            _close(stack, "td", ("tr", "table"))
            _close(stack, "th", ("tr", "table"))
        names = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])).lower() if "=" in m[3] else ""
        node = Node(tag, names)
        stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
            at = stop.end() if stop else end
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str, bounds: tuple[str, ...]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in bounds:
            return


def _walk(root: Node) -> list[Node]:
    """All nodes, every one before those below it; no recursion, pages may nest deeply."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in node.children if type(c) is Node)
    return out


def hash_subtrees(root: Node, host: str) -> list[Node]:
    """Sets every node's hash and `main` (holds an article or main); the nodes, outer ones first."""
    nodes = _walk(root)
    for n in reversed(nodes):
        parts = [n.tag, n.names]
        for c in n.children:
            if type(c) is Node:
                parts.append(str(c.hash))
                n.main |= c.main
            else:
                parts.append(" ".join(c.split()))
        n.hash = xxhash.xxh3_64_intdigest("\x1f".join([host, *parts]).encode("utf-8", "surrogatepass")) - (1 << 63)
    return nodes


def candidates(root: Node, host: str) -> set[int]:
    """Hashes of a page's subtrees that may be templates: none that holds the main part or lies in it."""
    hash_subtrees(root, host)
    out, todo = set(), [root]
    while todo:
        node = todo.pop()
        if node.tag in MAIN:
            continue
        if not node.main and node.tag not in ("#root", "html", "body", "head", *RAW) and node.tag not in INLINE:
            out.add(node.hash)
        todo.extend(c for c in node.children if type(c) is Node)
    return out


def content(root: Node) -> int:
    """What tells pages from copies, after `hash_subtrees`: the main parts, or the whole page where none is marked."""
    parts, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in MAIN:
            parts.append(node.hash)
        else:
            todo.extend(c for c in reversed(node.children) if type(c) is Node and (c.main or c.tag in MAIN))
    return xxhash.xxh3_64_intdigest(repr(parts or root.hash)) - (1 << 63)


def _dropped(n: Node, inside: bool, marked: bool) -> bool:
    """The element names a role that is no main text. On a page that marks its main part, a part of a name counts too
    (`site-footer`); what holds the main part always stays."""
    if n.main:
        return False
    if n.tag in DROPPED or n.tag == "header" and not inside:
        return True
    if not n.names or n.tag in ("html", "body"):
        return False
    return not ROLES.isdisjoint(n.names.split()) or marked and not ROLE_PARTS.isdisjoint(_PARTS.split(n.names))


def main_text(root: Node, templates) -> str:
    """Blocks of the article (or main part, else the body) that are left, joined by an empty line."""
    blocks, buffer = [], []

    def flush() -> None:
        text = " ".join(unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            blocks.append(text)

    whole = not root.main
    todo: list = [(root, False)]
    while todo:
        item, inside = todo.pop()
        if item is None:
            flush()
        elif type(item) is str:
            if inside or whole:
                buffer.append(item)
        elif item.tag == "br":
            buffer.append(" ")
        else:
            inside = inside or item.tag in MAIN
            if _dropped(item, inside, not whole) or not inside and not item.main and item.hash in templates:
                if item.tag not in INLINE:
                    flush()
                continue
            if item.tag not in INLINE:
                flush()
                todo.append((None, False))
            todo.extend((c, inside) for c in reversed(item.children))
    flush()
    return "\n\n".join(blocks)


def template_counts(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, subtree, pages) for every candidate subtree; subtree 0 counts the host's pages. Copies of a page count once."""
    source = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            keys, found = [], []
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root = parse(html or "")
                found.append([0, *candidates(root, host)])
                keys.append(content(root))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["host", "key", "subtrees"])

    distinct = source.mapInArrow(read, "host string, key long, subtrees array<long>").dropDuplicates(["host", "key"])
    return distinct.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages"))


def find_templates(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", min_pages: int = 5, min_share: float = 0.02) -> DataFrame:
    """(host, subtrees): the subtrees that recur; at most 1 / min_share times those of a page."""
    counts = template_counts(pages, url_col, html_col)
    recurring = counts.filter(F.col("pages") >= min_pages)
    size = F.max(F.when(F.col("subtree") == 0, F.col("pages")))
    host = recurring.groupBy("host").agg(size.alias("size"), F.collect_list(F.struct("subtree", "pages")).alias("all"))
    return host.select("host", F.transform(F.filter("all", lambda x: (x["subtree"] != 0) & (x["pages"] >= F.col("size") * min_share)),
                                           lambda x: x["subtree"]).alias("subtrees")).filter(F.size("subtrees") > 0)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5,
            min_share: float = 0.02, max_broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(id, url, text) of every row. Null and empty html give an empty text; equal rows are each kept; other columns are left out.

    The templates are small beside the pages. Up to max_broadcast_bytes they are broadcast, beyond that joined by host.
    """
    spark = pages.sparkSession
    templates = written(find_templates(pages, url_col=url_col, html_col=html_col, min_pages=min_pages, min_share=min_share), "templates")
    size = templates.agg(F.coalesce(F.sum(F.size("subtrees") * 8 + F.octet_length("host") + 16), F.lit(0))).first()[0]
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"),
                          F.col(html_col).cast("string").alias("html"))
    held = spark.sparkContext.broadcast({r.host: frozenset(r.subtrees) for r in templates.collect()}) if size <= max_broadcast_bytes else None
    rows = source.withColumn("subtrees", F.lit(None).cast("array<long>")) if held else source.join(templates, "host", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = []
            for host, html, own in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                root = parse(html or "")
                hash_subtrees(root, host)
                texts.append(main_text(root, held.value.get(host, ()) if held else own or ()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    return (rows.select("id", "url", "host", "html", "subtrees").mapInArrow(read, f"id {kinds[0]}, url {kinds[1]}, text string")
            .select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text"))
