"""Main text of web pages by removal of site templates.

A page is parsed to a tree, and each element's subtree gets a hash of its tag, class and
id, text and children. Spark counts on how many pages of a host each hash occurs; the
subtrees that recur on many of them (navigation, banners, footers) are deleted wherever
they lie outside of the page's article. What isn't content by its role (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) goes too,
as a host of few pages can't show its template. The text of the article is what remains:
the outermost <article> or <main> elements; without any the page's core, the innermost container with most of
its words outside of links; and where no container has most of them, the whole body.

Inside an article or a core subtrees are counted apart: a block that recurs in half of a host's
differing articles, and in three of them, is the site's (share bars, adverts, notices in any
language) and goes too. What fewer articles repeat is their own words and stays, and so do
inline elements, headings, list items and table cells that recur by themselves. Copies of an
article on a host count once, so an article isn't its own template.

Character references are decoded, white space within a block becomes one space, blocks
are trimmed and joined in page order by one space.

Cases: null html is empty and gives an empty text; broken markup is parsed as far as it
goes, with open elements closed at the end; a null or odd url is a host of its own;
repeated page_ids are each returned, with their template found together; an empty table
gives an empty result; pages are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm._text import cut, map_arrow

#: A subtree is template if it occurs on this many pages of a host, and this share of them.
LEAST_PAGES, LEAST_SHARE = 3, 0.01
#: Inside articles: this many differing articles of a host, and this share of them.
LEAST_ARTICLES, LEAST_ARTICLE_SHARE = 3, 0.5

#: A page without an article: its core has this share of the words outside of links, and this many characters of them.
CORE_SHARE, CORE_CHARS = 0.6, 400

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_DROPPED = frozenset("head script style noscript template nav aside footer form iframe svg canvas object embed button select option textarea dialog menu title".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Parts of an article's own text that recur by themselves (section titles, table labels).
_CONTAINERS = frozenset("html body div section td center table tbody tr details fieldset dl dd li ul ol".split())
_PARTS = _INLINE | _VOID | frozenset("h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption".split())
#: Tells a subtree's hash inside an article from the same subtree's outside.
_INSIDE = 0x5BD1E9955BD1E995
_ROLES = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside cookie cookies consent notice notices banner ad ads advert adverts advertisement sponsor sponsored promo promotion "
    "share sharing social comment comments respond disqus breadcrumb breadcrumbs related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager skip widget toolbar".split()
)
#: Words that say nothing by themselves: with a role's name they make up names such as share-bar.
_NEUTRAL = frozenset("bar box list links link block container wrap wrapper section area panel item items inner outer group row buttons button icons site page top bottom main left right the".split())
_ARIA = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("children", "dropped", "main", "mark", "tag")

    def __init__(self, tag: str, mark: str = "", dropped: bool = False, main: bool = False) -> None:
        self.tag, self.mark, self.dropped, self.main = tag, mark, dropped, main
        self.children: list[Node | str] = []


def _names_role(names: str) -> bool:
    """Whether a class or id says that its element isn't content: post-header and related-work don't, share-bar does."""
    for name in names.split():
        words = {x.lower() for x in _WORDS.findall(name)}
        if words & _ROLES and words <= _ROLES | _NEUTRAL:
            return True
    return False


def _element(tag: str, raw: str) -> Node:
    attributes = {m[1].lower(): m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] for m in _ATTRIBUTE.finditer(raw)} if raw.strip() else {}
    names, role = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip(), attributes.get("role", "").lower()
    main = tag in ("article", "main") or role in ("main", "article")
    hidden = bool(attributes) and _HIDDEN.search(_QUOTED.sub("\"\"", raw)) is not None or raw.strip().lower() == "hidden" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
    dropped = tag in _DROPPED or role in _ARIA or tag not in ("body", "html") and _names_role(names) or hidden
    return Node(tag, names, dropped, main and not dropped)


def parse(html: str) -> Node:
    """The page's tree; a text child is kept as it stands in the source."""
    root = Node("#")
    stack = [root]
    at, lower = 0, None

    def close(tags: set[str] | frozenset[str], barrier: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in barrier:
                return

    while True:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].children.append(text)
        if not m:
            return root
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag in _INLINE | {"p", "li"}:
                    break
            continue
        if tag in _CLOSES_P:
            close({"p"}, {"td", "th", "table", "button", "object", "li", "div", "article", "section", "body"})
        if tag in _SIBLINGS:
            close({tag, "dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}, _SIBLINGS[tag])
        node = _element(tag, m[3])
        stack[-1].children.append(node)
        if tag in _RAW:
            lower = lower or html.lower()
            end = lower.find(f"</{tag}", at)
            if end < 0:
                return root
            at = max(end, 0)
            closing = html.find(">", at)
            node.children.append(html[m.end() : end])
            at = closing + 1 if closing >= 0 else len(html)
        elif tag not in _VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)


def hashes(root: Node) -> dict[int, int]:
    """id(node) -> hash of the subtree, of every element; without recursion."""
    out: dict[int, int] = {}
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo += [(x, False) for x in node.children if not isinstance(x, str)]
            continue
        h = xxhash.xxh3_64(f"{node.tag}\0{node.mark}")
        for x in node.children:
            h.update(" ".join(x.split()) if isinstance(x, str) else out[id(x)].to_bytes(8, "little"))
        out[id(node)] = h.intdigest()
    return out


def _core(root: Node) -> Node:
    """The innermost container with CORE_SHARE of the page's words outside of links, if they are CORE_CHARS characters; else the page.

    Containers have blocks of their own: a paragraph, a list or a block of text alone isn't one.
    """
    size: dict[int, int] = {}
    todo: list[tuple[Node, bool]] = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if ready:
            size[id(node)] = 0 if node.tag == "a" or node.dropped else sum(len("".join(x.split())) if isinstance(x, str) else size[id(x)] for x in node.children)
        else:
            todo.append((node, True))
            todo += [(x, False) for x in node.children if not isinstance(x, str)]
    total, core = size[id(root)], root
    if total < CORE_CHARS:
        return root
    node: Node | None = root
    while node is not None:
        core = node
        inner = [x for x in node.children if not isinstance(x, str) and x.tag in _CONTAINERS and size[id(x)] >= max(CORE_CHARS, CORE_SHARE * total)]
        node = next((x for x in inner if any(not isinstance(y, str) and y.tag not in _INLINE | _VOID for y in x.children)), None)
    return root if core.tag in ("html", "body") else core


def _regions(root: Node) -> list[Node]:
    """The outermost articles that aren't within something dropped; without any the page's core, else the page."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.main:
            found.append(node)
        elif not node.dropped:
            todo += [x for x in reversed(node.children) if not isinstance(x, str)]
    if any(x.tag == "article" for x in found):
        return found
    inner = [y for x in found for y in _articles(x)]
    return inner or found or [_core(root)]


def _articles(node: Node) -> list[Node]:
    found, todo = [], [x for x in reversed(node.children) if not isinstance(x, str)]
    while todo:
        x = todo.pop()
        if x.tag == "article" and x.main:
            found.append(x)
        elif not x.dropped:
            todo += [y for y in reversed(x.children) if not isinstance(y, str)]
    return found


def candidates(root: Node) -> set[int]:
    """Hashes of the subtrees outside of the article that may be template."""
    own, inside = hashes(root), {id(x) for x in _regions(root) if x is not root}
    out: set[int] = set()
    todo: list[Node] = [root]
    while todo:
        node = todo.pop()
        for x in node.children:
            if not isinstance(x, str) and id(x) not in inside:
                out.add(own[id(x)])
                todo.append(x)
    return out


def inner_candidates(root: Node) -> tuple[set[int], int]:
    """Hashes of the blocks inside the page's articles that may be template, and the articles' own hash."""
    regions = [x for x in _regions(root) if x is not root]
    if not regions:
        return set(), 0
    own, kept = hashes(root), {id(x) for x in regions}
    out: set[int] = set()
    todo = list(regions)
    while todo:
        for x in todo.pop().children:
            if not isinstance(x, str) and not x.dropped and id(x) not in kept:
                if x.tag not in _PARTS:
                    out.add(own[id(x)] ^ _INSIDE)
                todo.append(x)
    return out, xxhash.xxh3_64_intdigest(b"".join(own[id(x)].to_bytes(8, "little") for x in regions))


def main_text(root: Node, template: set[int]) -> str:
    """The text of the article without template subtrees and without what its role rules out."""
    regions = _regions(root)
    kept = {id(x) for x in regions}
    own = hashes(root) if template else {}
    body = regions == [root]

    def recurs(node: Node) -> bool:
        if body:
            return node is not root and own.get(id(node)) in template
        return id(node) not in kept and node.tag not in _PARTS and own.get(id(node), 0) ^ _INSIDE in template

    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = " ".join(unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    todo: list[tuple[Node | str | None, bool]] = [(x, True) for x in reversed(regions)]
    while todo:
        node, _ = todo.pop()
        if node is None:
            flush()
        elif isinstance(node, str):
            line.append(node)
        elif node.dropped and id(node) not in kept or template and recurs(node):
            if node.tag not in _INLINE:
                flush()
        else:
            block = node.tag not in _INLINE
            if block:
                flush()
                todo.append((None, False))
            todo += [(x, False) for x in reversed(node.children)]
    flush()
    return " ".join(blocks)


def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else url or ""


def _host_key(url: str | None) -> int:
    return _signed(xxhash.xxh3_64_intdigest(_host(url)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """What may be template, with the article it stands in; a row without subtree for each page and article."""
        for batch in batches:
            hosts, found, articles = [], [], []
            for url, html in zip(*(batch.column(x).to_pylist() for x in ("url", "html")), strict=True):
                root = parse(html)
                inner, article = inner_candidates(root)
                rows = [(h, None) for h in (None, *candidates(root))] + [(h, _signed(article)) for h in (None, *inner) if article]
                hosts += [_host_key(url)] * len(rows)
                found += [None if h is None else _signed(h) for h, _ in rows]
                articles += [x for _, x in rows]
            yield {"host": hosts, "subtree": found, "article": articles}

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        """The subtrees of each page that its text would leave out."""
        for batch in batches:
            ids, hosts, found = [], [], []
            for i, url, html in zip(*(batch.column(x).to_pylist() for x in ("page_id", "url", "html")), strict=True):
                root = parse(html)
                some = candidates(root) if _regions(root) == [root] else inner_candidates(root)[0]
                ids += [i] * len(some)
                hosts += [_host_key(url)] * len(some)
                found += [_signed(h) for h in some]
            yield {"page_id": ids, "host": hosts, "subtree": found}

    places = map_arrow(pages.select("url", "html"), counted, "host long, subtree long, article long").groupBy("host", "subtree", "article").agg(F.count("*").alias("n"))
    # a page counts for the subtrees outside of its article, a differing article for those inside
    n = F.sum(F.when(F.col("article").isNull(), F.col("n")).otherwise(1))
    # kept once, so pages aren't parsed again for the totals
    per_host = cut(places.groupBy("host", "subtree", F.col("article").isNotNull().alias("inside")).agg(n.alias("n")).where((F.col("n") >= min(LEAST_PAGES, LEAST_ARTICLES)) | F.col("subtree").isNull()))
    totals = per_host.where("subtree IS NULL").select("host", "inside", F.col("n").alias("total"))
    least = F.when(F.col("inside"), F.greatest(F.lit(float(LEAST_ARTICLES)), F.col("total") * LEAST_ARTICLE_SHARE)).otherwise(F.greatest(F.lit(float(LEAST_PAGES)), F.col("total") * LEAST_SHARE))
    template = per_host.where("subtree IS NOT NULL").join(totals, ["host", "inside"]).where(F.col("n") >= least).select("host", "subtree")
    seen = map_arrow(pages, wanted, "page_id long, host long, subtree long")
    marked = seen.join(template, ["host", "subtree"]).groupBy("page_id").agg(F.collect_set("subtree").alias("template"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = [main_text(parse(html), {h + (1 << 63) for h in template or ()}) for html, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)]
            yield {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(x) for x in texts]}

    joined = pages.join(marked.withColumnRenamed("page_id", "__id"), F.col("page_id") == F.col("__id"), "left").drop("__id")
    return map_arrow(joined, run, "page_id long, url string, text string, n_chars long")


def _signed(h: int) -> int:
    return h - (1 << 63)
