"""HTML extraction with site template removal.

Pages are parsed into element trees; each element's subtree has a hash of its
tag, its attributes' names and classes, and the text below it. Subtrees that
recur across many pages of a host, outside the article and away from plain
paragraphs, are template and go, as do the elements whose tag, role or class
says that they are no article. What stays is read block by block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import texts, written

#: Pages of a host that a subtree must be on to be template, and the share of the host's pages; on so many pages it is one whatever the share.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 10, 0.05, 100
#: Share of the text in links from which on an element is a list of links.
LINKED = 0.5
# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset(
    "aside button canvas datalist dialog footer form head header iframe input label link menu meta nav noembed noframes noscript object option search "
    "script select style svg template textarea title video audio embed map".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alertdialog alert form toolbar".split())
# Names of classes and ids, whole: such an element is no part of an article.
_PLACES = r"(?:(?:site|page|global|top|main|left|right|bottom|primary|secondary|side)[-_])*"
_ADDED = r"(?:[-_](?:\d+|box|bar|wrap|wrapper|container|area|list|block|section|inner|content|top|bottom|left|right|form|thread|widget))*"
_SURE = re.compile(
    _PLACES + r"(?:ads?|advert(?:isement|ising)?s?|adsense|adsbygoogle|ad-?(?:slot|unit|banner)|banner|sponsored|promo|nav|navbar|navigation|menu|breadcrumbs?|sidebar|footer|masthead|topbar|toolbar|"
    r"(?:cookies?|gdpr|consent)(?:[-_](?:notice|banner|consent|popup|message))?|notices?|notifications?|newsletter|subscribe|subscription|comments?|disqus|replies|reply|respond|pagination|pager|popup|modal|"
    r"overlay|skip-?link|copyright|outbrain|taboola|hidden|sr-only|visually-hidden)" + _ADDED + r"|(?:site|page|global|top|main)-?header",
)
# Parts of names that many articles use too: with these, an element that is mostly links isn't part of one.
_MAYBE = re.compile(r"(?:^|[-_])(?:ads?|sponsor\w*|promo\w*|nav\w*|menu\w*|share|sharing|social\w*|related|recommend\w*|widget\w*|teaser\w*|login|signup|search\w*|legal|disclaimer|comment\w*|sidebar\w*|footer\w*)(?:$|[-_])")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_LINKS = re.compile(r"\d+|(?:href|src|content|action)\s*=\s*(?:\"[^\"]*\"|'[^']*'|\S+)")
#: An element that is opened ends these open elements first.
_ENDS = {k: frozenset(v.split()) for k, v in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}.items()}
_ENDS_P = BLOCK - {"body", "html", "caption", "tbody", "thead", "tfoot", "legend"}
_LISTS = frozenset(("ul", "ol", "dl", "table", "select"))
_FRAME = frozenset(("#root", "html", "body", "article", "main"))
_STOPS = frozenset("article main section aside div ul ol table nav header footer form body html td th blockquote dl".split())


class Node:
    __slots__ = ("tag", "attributes", "children", "digest")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children, self.digest = tag, attributes, [], b""


def _close(stack: list[Node], tag: str, stops: frozenset[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in stops:
            return


def parse(source: str) -> Node:
    """The tree of a page: children are nodes or strings. Ends of elements may lack; what never closes goes to the end."""
    root = Node("#root")
    stack, at, n, match, find = [root], 0, len(source), _TAG.match, source.find
    text_from = 0
    while (k := find("<", at)) >= 0:
        m = match(source, k)
        if m is None:
            at = k + 1
            continue
        if k > text_from:
            stack[-1].children.append(source[text_from:k])
        at = text_from = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if stack[-1].tag == tag:
                stack.pop()
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                _close(stack, tag, frozenset() if tag in _STOPS else _STOPS)
            continue
        if tag in _ENDS_P:
            _close(stack, "p", _STOPS)
            for old in _ENDS.get(tag, ()):
                _close(stack, old, _LISTS)
        node = Node(tag, m[3])
        stack[-1].children.append(node)
        if tag in RAW:
            low = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            end = low.start() if low else n
            node.children.append(source[at:end])
            at = text_from = (find(">", end) + 1 or n) if low else n
        elif tag not in VOID:  # the slash of an element that isn't void means nothing
            stack.append(node)
    if text_from < n:
        stack[-1].children.append(source[text_from:])
    return root


def _clean(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _named(node: Node) -> bool:
    """Whether tag, role, class or id say that the element is no part of an article."""
    if node.tag in DROPPED:
        return True
    if not node.attributes or node.tag in ("html", "body", "article", "main"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(node.attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in _ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True
    names = [x.lower() for k in ("class", "id") for x in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", found.get(k, "")).split()]
    return any(map(_SURE.fullmatch, names)) or any(map(_MAYBE.search, names)) and _linked(node) >= LINKED


def _linked(node: Node) -> float:
    """The share of an element's text that is in links; 1 without text."""
    inside = total = 0
    work: list = [(c, node.tag == "a") for c in node.children]
    while work:
        x, link = work.pop()
        if isinstance(x, str):
            n = len("".join(x.split()))
            total += n
            inside += n if link else 0
        elif x.tag not in DROPPED:
            work.extend((c, link or x.tag == "a") for c in x.children)
    return inside / total if total else 1.0


def _order(root: Node) -> list[tuple[Node, bool, bool]]:
    """All elements, parents first, without recursion, so depth doesn't matter: (element, in an article, may be template).

    What may be template: elements around no article that stand outside one, and those in one that have attributes.
    """
    out, open_nodes = [], [(root, False, True)]
    while open_nodes:
        node, inside, may = open_nodes.pop()
        may = may if not inside else may or bool(node.attributes.strip())
        out.append((node, inside, may and node.tag not in _FRAME))
        if node.tag in ("article", "main"):
            inside, may = True, False
        for c in reversed(node.children):
            if type(c) is Node:
                open_nodes.append((c, inside, may))
    return out


def digests(order: list[tuple[Node, bool, bool]]) -> None:
    """Sets the hash of each subtree that may be template: tag, attributes less links and digits, text, children's hashes."""
    for node, _, may in reversed(order):
        if may:
            parts = [node.tag.encode(), _LINKS.sub("", node.attributes).encode("utf-8", "surrogatepass") if node.attributes else b""]
            parts += [c.digest if type(c) is Node else b"\1" + " ".join(c.split()).encode("utf-8", "surrogatepass") for c in node.children]
            node.digest = xxhash.xxh3_128_digest(b"\0".join(parts))


def template_candidates(source: str) -> list[bytes]:
    """Hashes of the block subtrees that may be template if they recur, each once.

    Subtrees that hold an article, and elements without attributes inside one, are none: an article may well be on many pages.
    """
    order = _order(parse(source))
    digests(order)
    holds = set()
    for node, _, _ in reversed(order):
        if node.tag in _FRAME or holds and any(id(c) in holds for c in node.children):
            holds.add(id(node))
    return list({n.digest: 0 for n, inside, may in order if may and n.tag in BLOCK and id(n) not in holds and n.children and (not inside or n.attributes)})


def extract(source: str, template: frozenset[bytes] | set[bytes] = frozenset()) -> str:
    """The main text: blocks in order, joined by an empty line.

    If the page has an article or main element that isn't named away, only those are read, else the whole body.
    """
    root = parse(source)
    order = _order(root)
    if template:
        digests(order)
    gone = set()
    for node, inside, may in order:
        recurs = may and node.digest in template
        if node.tag == "header" and inside:
            continue  # an article's own header holds its headings
        if _named(node) or recurs:
            gone.add(id(node))
    tops = [root]
    mains, open_nodes = [], [root]
    while open_nodes:
        node = open_nodes.pop()
        if id(node) in gone:
            continue
        if node.tag in ("article", "main"):
            mains.append(node)
            continue
        open_nodes.extend(c for c in reversed(node.children) if isinstance(c, Node))
    tops = mains or tops
    blocks: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = _clean("".join(held))
        held.clear()
        if text:
            blocks.append(text)

    work: list = list(reversed(tops))
    while work:
        x = work.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif id(x) in gone:
            if x.tag in BLOCK:
                end()
        elif x.tag == "br":
            held.append(" ")
        else:
            block = x.tag in BLOCK or x.tag == "#root"
            if block:
                end()
                work.append(None)
            work.extend(reversed(x.children))
    end()
    return "\n\n".join(blocks)


def host(url):
    """The host of a URL, lower case; null and odd URLs have the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def template_hashes(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many: int = MANY_PAGES) -> DataFrame:
    """(host, h1, h2, n_pages): subtrees on at least ``min_pages`` pages of a host that are ``min_share`` of its pages, or on at least ``many``.

    Each task counts what it meets and sends a row per host and subtree, so a host with a third of all pages has no task of its own.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, bytes], int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list(seen.items())
            for lo in range(0, len(rows), 20_000):
                part = rows[lo : lo + 20_000]
                h1 = [int.from_bytes(d[:8], "big", signed=True) for (_, d), _ in part]
                h2 = [int.from_bytes(d[8:], "big", signed=True) for (_, d), _ in part]
                arrays = [pa.array([h for (h, _), _ in part], pa.string()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array([n for _, n in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["host", "h1", "h2", "n"])
            seen.clear()

        for batch in batches:
            for site, source in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                seen[site, b"\0" * 16] = seen.get((site, b"\0" * 16), 0) + 1  # the host's pages
                for d in template_candidates(source):
                    seen[site, d] = seen.get((site, d), 0) + 1
            if len(seen) > 200_000:
                yield from flush()
        yield from flush()

    rows = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(count, "host string, h1 long, h2 long, n long")
    counts = written(rows.groupBy("host", "h1", "h2").agg(F.sum("n").alias("n_pages")).where(F.col("n_pages") >= min_pages), "subtrees")
    totals = counts.where("h1 = 0 and h2 = 0").select("host", F.col("n_pages").alias("total"))
    found = counts.where("not (h1 = 0 and h2 = 0)").join(totals, "host")
    return found.where((F.col("n_pages") >= min_share * F.col("total")) | (F.col("n_pages") >= many)).select("host", "h1", "h2", "n_pages")


def _templates_by_host(spark, template: DataFrame, most: int):
    """The template sent to every task if it has at most ``most`` subtrees, else None."""
    rows = template.limit(most + 1).collect()
    if len(rows) > most:
        return None
    out: dict[str, set[bytes]] = {}
    for r in rows:
        out.setdefault(r["host"], set()).add(r["h1"].to_bytes(8, "big", signed=True) + r["h2"].to_bytes(8, "big", signed=True))
    return spark.sparkContext.broadcast(out)


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, most_broadcast: int = 1_000_000) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row of ``pages(page_id, url, html)``; other columns are left out.

    Null and empty pages have an empty text; rows and ids may repeat. The template goes to the tasks by broadcast while it is
    at most ``most_broadcast`` subtrees, beyond that a host's subtrees are joined to its pages as one array. Classes and ids tell what
    is no article only by names that say nothing else, or where the element is mostly links.
    """
    pages = pages.select("page_id", "url", "html")
    template = template_hashes(pages, min_pages, min_share)
    shared = _templates_by_host(pages.sparkSession, template, most_broadcast)
    rows = pages.withColumn("host", host(F.col("url")))
    if shared is None:
        per_host = template.groupBy("host").agg(F.collect_list(F.struct("h1", "h2")).alias("template"))
        rows = rows.join(per_host, "host", "left")
        digest = lambda x: F.concat(F.to_binary(F.lpad(F.hex(x["h1"]), 16, "0"), F.lit("hex")), F.to_binary(F.lpad(F.hex(x["h2"]), 16, "0"), F.lit("hex")))
        rows = rows.withColumn("template", F.transform("template", digest))
    else:
        rows = rows.withColumn("template", F.lit(None).cast("array<binary>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for site, source, own in zip(batch.column("host").to_pylist(), texts(batch.column("html")), batch.column("template").to_pylist(), strict=True):
                out.append(extract(source, {*own} if own is not None else shared.value.get(site, frozenset()) if shared else frozenset()))
            more = [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *more], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
