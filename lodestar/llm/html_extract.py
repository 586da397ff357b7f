"""Main text of web pages by the consensus of each host's pages.

A first pass parses every page and scores its containers: text outside links, paragraphs and
sentence marks speak for a container, links and telling class names against it.  Each page votes,
with the generalised tag-class paths of its best containers, and the votes of a host are summed in
Spark.  A second pass extracts every page again from the container at the host's winning path; a
page that has no container there, or none with text, falls back on its own best container.

The winning paths are written out first: joined to the pages they are broadcast only where Spark
finds them below its size limit, and shuffled beyond.

Defined cases: a null or empty html gives an empty text; a page without a host votes with the other
pages without one; ties between paths go to the smaller path; repeated rows each vote and each
get a row; broken markup is read leniently; pages are parsed whole, with memory in proportion to
the longest; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, materialise

#: An attribute: a name and a value, which may hold quotes where it begins without one; a quote that never ends is part of a name or value.
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>]++)"""
_ATTRIBUTE = re.compile(rf"""([^\s=/>]++)(?:\s*+=\s*+({_VALUE}))?+""")
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/=]++|[^\s=/>]++(?:\s*+=\s*+{_VALUE})?+)*+)(?:>|\Z)""",
    re.S,
)
_TELLING = re.compile("class|id|role|hidden|style", re.I)
#: Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead
    tr ul caption""".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINER = frozenset("article main section div td body center blockquote details".split())
DROPPED = frozenset(
    """nav footer aside form script style noscript template iframe button select input textarea svg canvas object embed
    video audio head title menu dialog datalist""".split()
)
#: An open element that the start of another one closes.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tr", "td", "th"), "tfoot": ("tr", "td", "th", "tbody"),
}
#: Where the search for an element to close ends.
SCOPE = frozenset("table ul ol dl body html article section div td th".split())
_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}
#: Words in class, id and role that mark what isn't main text.
NOISE = frozenset(
    """nav navbar navigation navigational menu menubar breadcrumb breadcrumbs masthead topbar toolbar footer sidebar
    sidebars aside widget widgets ad ads advert adverts advertisement advertising adsense adbox adslot banner sponsor sponsored
    sponsors promo promos promotion promotions cookie cookies consent gdpr notice notices notification notifications popup modal
    overlay subscribe subscription newsletter signup share sharing recommended recommendations comment comments
    commentlist disqus reply replies respond searchbox pagination pager complementary contentinfo""".split()
)
#: Words that do so alone or beside the words above and those for parts of a page.
WEAK_NOISE = frozenset("social follow related trending alert login search discussion dialog skip hidden rail foot bottom".split())
#: Words for parts of a page, which tell nothing by themselves.
PARTS = frozenset(
    """site page post article blog main content entry news story js the my us me to for at on and of bar box block card list lists item items link links
    wrapper wrap container holder inner outer area zone slot unit section group row col cols column columns left right top center
    middle primary secondary global desktop mobile button buttons btn btns icon icons form panel pane strip layout module component
    region view title heading label tags tag meta policy settings count thread tree feed posts articles stories large small medium
    sticky fixed floating header head nav body text message messages bottom foot count counter""".split()
)
MAIN = frozenset("article content main post entry story body text page blog news".split())
#: What an article that is a reader's comment is called.
COMMENTS = frozenset("comment comments reply replies".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Containers of a page that vote.
VOTES = 3


class Node:
    __slots__ = ("tag", "name", "noise", "good", "parent", "parts", "heads", "size")

    def __init__(self, tag: str, name: str = "", noise: bool = False, good: bool = False, parent: Node | None = None):
        self.tag, self.name, self.noise, self.good, self.parent = tag, name or tag, noise, good, parent
        self.parts: list = []  # strings and nodes
        self.heads = False  # holds a heading
        self.size = 0  # text in forms

    def path(self) -> str:
        names, node = [], self
        while node:
            names.append(node.name)
            node = node.parent
        return "/".join(reversed(names))


def _general(value: str) -> str:
    """A class without what differs from page to page: digits and long codes."""
    return re.sub(r"\d+", "#", value.lower()).replace("/", "|")


def _noisy(token: str, main: bool) -> bool:
    """Whether a class, id or role says that an element isn't main text: it is made of a word that does so, and of
    nothing but such words and those for parts of a page.  "cookie-notice" and "site-footer" are, "follow-up" isn't."""
    found = [w.lower() for w in _WORDS.findall(token)]
    rest = [w for w in found if w not in NOISE]
    if not found or not all(w in WEAK_NOISE or w in PARTS for w in rest):
        return False
    if main:
        return bool(COMMENTS.intersection(found))
    return len(rest) < len(found) or any(w in WEAK_NOISE and w not in PARTS for w in rest) or len(found) == 1 and found[0] in WEAK_NOISE


@lru_cache(maxsize=1 << 14)
def _read(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(name, noise, good) of an element."""
    noise, good = tag in DROPPED, tag in ("article", "main")
    if not _TELLING.search(attributes):
        return tag, noise, good
    read: dict[str, str] = {}
    for a in _ATTRIBUTE.finditer(attributes):
        value = a[2] or ""
        if value[:1] in ("'", '"') and value[-1:] == value[:1]:
            value = value[1:-1]
        read.setdefault(a[1].lower(), html.unescape(value))
    tokens = " ".join(read.get(k, "") for k in ("class", "id", "role")).split()
    words = frozenset(w.lower() for t in tokens for w in _WORDS.findall(t))
    hidden = "hidden" in read and read["hidden"].lower() != "until-found" or read.get("aria-hidden") == "true" or _HIDDEN.search(read.get("style", ""))
    if tag not in ("html", "body", "main"):
        main = tag == "article" or any(t.lower() in ("article", "main", "content") for t in tokens)
        noise = noise or bool(hidden) or any(_noisy(t, main) for t in tokens)
    classes = sorted({_general(c) for c in read.get("class", "").split()})
    return ".".join([tag, *classes]), noise, good or bool(words & MAIN)


def parse(source: str) -> Node:
    root = Node("html")
    stack = [root]
    opened: Counter = Counter(html=1)  # elements in the stack by tag
    at, size = 0, len(source)

    def add(text: str) -> None:
        if text:
            stack[-1].parts.append(html.unescape(text))

    def close(k: int) -> None:
        opened.subtract(n.tag for n in stack[k:])
        del stack[k:]

    for m in _TOKEN.finditer(source):
        if m.start() < at:  # inside an element that is read raw
            continue
        add(source[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            stack[-1].parts.append(m[0][9:].removesuffix("]]>"))
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br" or tag == "p" and not opened["p"]:
                stack[-1].parts.append(Node(tag))
                continue
            if not opened[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:  # a stray end of formatting
                    break
            continue
        if tag in ("html", "body") and (tag == "html" or opened["body"]):
            continue
        if tag in BLOCK and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):  # a block ends a paragraph
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        if tag in CLOSES and any(opened[c] for c in CLOSES[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    close(k)
                elif stack[k].tag in SCOPE and not (tag in ("tr", "tbody", "tfoot") and stack[k].tag in ("td", "th")):
                    break
        node = Node(tag, *_read(tag, m[3]), stack[-1])
        if tag in HEADING or tag in ("article", "main"):
            above = stack[-1]
            while above and not above.heads:
                above.heads, above = True, above.parent
        stack[-1].parts.append(node)
        if tag in RAW:
            end = _END[tag].search(source, at)
            at = end.end() if end else size
        elif tag not in VOID and (not m[3].rstrip().endswith("/") or tag in BLOCK or tag in ("span", "a")):  # "/" means nothing there
            stack.append(node)
            opened[tag] += 1
    add(source[at:])
    _forms(root)
    return root


def _forms(root: Node) -> None:
    """Forms that hold a page's headings, articles or most of its text are but containers."""
    order, forms = [root], False
    for node in order:
        node.size = sum(len(p) for p in node.parts if isinstance(p, str))
        forms |= node.tag == "form"
        if node.tag not in RAW:
            order += [p for p in node.parts if isinstance(p, Node)]
    if forms:
        for node in reversed(order):
            if node.parent and node.tag not in RAW and node.tag != "head":
                node.parent.size += node.size
        for node in order:
            if node.tag == "form" and (node.heads or 2 * node.size > root.size):
                node.tag, node.noise = "div", False


def _dropped(node: Node, within: str) -> bool:
    if node.tag == "header":  # a page's header goes, an article's own heading stays
        return within not in ("article", "main", "section") or not node.heads or node.noise
    return node.noise


def _kind(node: Node) -> str:
    return "article" if node.good and node.tag != "body" else node.tag


def blocks(node: Node) -> list[str]:
    """The text of a container, block by block, without what isn't main text."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list = [(iter(node.parts), _kind(node), False)]  # no recursion: markup nests deeply
    while todo:
        parts, tag, block = todo[-1]
        for part in parts:
            if isinstance(part, str):
                line.append(part)
            elif part.tag in ("br", "wbr", "img"):
                line.append(" " if part.tag != "wbr" else "")
            elif not _dropped(part, tag):
                inside = part.tag in BLOCK
                if inside:
                    end()
                todo.append((iter(part.parts), _kind(part) if inside else tag, inside))
                break
            elif part.tag in BLOCK:
                end()
        else:
            todo.pop()
            if block:
                end()
    end()
    return out


def containers(root: Node) -> list[tuple[float, Node]]:
    """(score, container), best first.  A container's own paragraphs count in full, those below it less."""
    order: list[tuple[Node, Node | None, bool]] = []
    todo: list[tuple[Node, Node | None, str, bool]] = [(root, None, root.tag, False)]
    while todo:
        node, above, within, link = todo.pop()
        order.append((node, above, link))
        for part in node.parts:
            if isinstance(part, Node) and part.tag not in VOID and not _dropped(part, within):
                todo.append((part, node, _kind(part) if part.tag in BLOCK else within, link or part.tag == "a"))
    totals: dict[int, list] = {}  # of a node: own characters, link characters, marks, score from below
    for node, _, link in order:
        text = "".join(p for p in node.parts if isinstance(p, str))
        n = len(" ".join(text.split()))
        totals[id(node)] = [n, n if link else 0, sum(map(text.count, ".,;:!?")), 0.0]
    found: list[tuple[float, int, Node]] = []
    for rank in range(len(order) - 1, -1, -1):
        node, above, _ = order[rank]
        n, linked, marks, below = totals[id(node)]
        if node.tag in CONTAINER:
            plain = max(0, n - 2 * linked)
            own = plain + 8 * marks
            score = (own + below) * (1.25 if node.good else 1.0)
            found.append((score, rank, node))
            if above is not None:
                totals[id(above)][3] += 0.9 * (own + below)  # an outer container must add something
        elif above is not None:
            for k, value in enumerate((n, linked, marks, below)):
                totals[id(above)][k] += value
    found.sort(key=lambda x: (-x[0], x[1]))
    return [(score, node) for score, _, node in found if score > 0]


def _at(root: Node, ranked: list[tuple[float, Node]], path: str | None) -> Node | None:
    """The best container at a path.  Only nodes along the path are looked at."""
    names = (path or "").split("/")
    level = [root] if root.name == names[0] else []
    for name in names[1:]:
        level = [p for node in level for p in node.parts if isinstance(p, Node) and p.name == name]
    here = {id(n) for n in level}
    return next((node for _, node in ranked if id(node) in here), None)


def _home(node: Node) -> Node:
    """The nearest article or main that a node is or stands in, else the node."""
    above: Node | None = node
    while above:
        if above.tag in ("article", "main"):
            return above
        above = above.parent
    return node


def votes(source: str) -> list[tuple[str, float]]:
    """The paths that a page votes for, with weights that sum to one."""
    best: dict[str, float] = {}
    for score, node in containers(parse(source))[:VOTES]:
        path = node.path()
        best[path] = max(best.get(path, 0.0), score)
    total = sum(v**4 for v in best.values())
    return [(p, v**4 / total) for p, v in best.items()] if total > 0 else []


def extract(source: str, path: str | None) -> str:
    """The main text, from the best container at the path, or else from the page's best one; a container within
    an article gives way to the article, whose heading and lead may stand beside it."""
    root = parse(source)
    ranked = containers(root)
    here = _at(root, ranked, path)
    for node in [*([here] if here else []), *[n for _, n in ranked[:1]]]:
        if text := "\n".join(blocks(_home(node))):
            return text
    return "\n".join(blocks(root))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def winning_paths(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, path): the path with most votes of each host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h.as_py(), p, v) for h, t in zip(*batch.columns) for p, v in votes(t.as_py())]
            columns = list(zip(*rows)) or [(), (), ()]
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "path", "vote"])

    ballots = pages.select(host_of(F.col(url)).alias("host"), F.coalesce(F.col(source), F.lit("")).alias("html"))
    counted = ballots.mapInArrow(run, "host string, path string, vote double").groupBy("host", "path").agg(
        F.sum(F.round("vote", 6).cast("decimal(18,6)")).alias("votes")
    )
    top = counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col("path"))).alias("top"))
    return top.select("host", F.col("top.path").alias("path"))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    winners = materialise(winning_paths(pages, url, source), "host-paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [extract(t.as_py(), p.as_py()) for t, p in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(source), F.lit("")).alias("html"),
        host_of(F.col(url)).alias(P + "host"),
    )
    joined = rows.join(winners, F.col(P + "host") == F.col("host"), "left").select("page_id", "url", "html", "path")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
