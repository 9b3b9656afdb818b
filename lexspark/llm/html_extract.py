"""Main text of web pages, by site style trees.

Pages of one host are merged into a style tree: a node for each path of elements (tag,
class, id), with the presentations (sequences of child tags) and the contents that the
host's distinct pages have there. A node's importance mixes the normalised entropies of both,
``GAMMA`` of it from the contents: what looks and reads the same on every page scores near
zero. Branches under ``LEAST_IMPORTANCE`` go, if at least ``LEAST_PAGES`` pages have them.

Entropy alone can't tell a menu whose entries change from page to page, so outside the article elements whose tag, role,
class or id says that they are menus, headers, footers, sidebars, notices, adverts, forms or reader
comments go too; and where a page marks its article, only that is read. Within it, only elements go whose tag or role is never content, or one of whose
classes is, as a whole, a name for such things (``NOISE_TOKEN``), and
plain text elements (no class or id) stay whatever their importance, as pages may quote each other.

Parsing is lenient: unclosed elements, missing ends, stray end tags and cut pages are
read as browsers do in the main. The counts are sums by host and path, combined map-side, so a host
with a third of all pages is no single task's. The few unimportant branches are broadcast
if they are at most ``MOST_BROADCAST``; else they join by host, which adaptive execution splits.

Defined cases: null and empty pages give an empty text, as do pages without any. A page with
no url belongs to a host of its own name "". Repeated rows are extracted alike and count as one page.
An empty table gives no rows. Whole pages count; no text is capped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

GAMMA = 0.9
LEAST_IMPORTANCE = 0.2
LEAST_PAGES = 5
MOST_BROADCAST = 100_000

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search".split()
)
#: What an opening tag closes, up to the elements that hold it back.
CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tr td th", "table"), "option": ("option", "select"), "body": ("head", ""),
}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th caption figure figcaption b i em strong a span code br u s small sub sup q cite mark abbr time del ins article main body html".split())
NOISE = frozenset("head nav footer aside form script style noscript iframe template svg canvas button select option textarea object embed dialog search math".split()) - {"math"}
NOISE_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_NAME = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notices?|notification|alerts?|popup|modal|overlay|subscribe|newsletter|signup|"
    r"share|sharing|social|related|recommend\w*|sidebar|aside|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|topbar|comments?|commentlist|disqus|replies|respond|widget|pagination|pager|login|"
    r"site-header|page-header|header)(?:$|[-_ \d])",
    re.I,
)
#: Within the article, only whole names of things that aren't content.
NOISE_TOKEN = re.compile(
    r"(?:ads?|advert|advertisement|adsense|ad-(?:slot|unit|box|container|banner)|banner-ad|sponsored|promo|cookie-(?:notice|banner|consent)|consent|newsletter(?:-signup)?|subscribe|signup|popup|modal|overlay|"
    r"share|sharing|share-(?:bar|buttons|links)|social-(?:share|links|buttons|media)|sidebar|navbar|breadcrumbs?|comments|comment-list|commentlist|disqus|replies|pagination|pager)",
    re.I,
)
MAIN_NAME = re.compile(r"(?:^| )(?:content|main|main-content|article|article-body|post|post-content|post-body|entry|entry-content|story|story-body)(?:$| )", re.I)


class Element:
    __slots__ = ("tag", "name", "role", "noise", "path", "kids", "texts", "main")

    def __init__(self, tag: str, attributes: str, parent: Element | None):
        self.tag, self.name, self.role = tag, "", ""
        if "=" in attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                if (key := key.lower()) in ("class", "id"):
                    self.name = f"{self.name} {next(filter(None, values), '')}".strip()
                elif key == "role":
                    self.role = next(filter(None, values), "").lower()
        within = parent is not None and parent.main
        self.main = within or tag in ("article", "main") or self.role in ("main", "article")
        named = bool(self.name) and (any(map(NOISE_TOKEN.fullmatch, self.name.split())) if within else bool(NOISE_NAME.search(self.name)))
        self.noise = tag in NOISE or self.role in NOISE_ROLE or named or tag == "header" and not within
        self.path = hashed(f"{parent.path if parent else ''}/{tag}{'.' + self.name if self.name else ''}")  # of one size, however deep
        self.kids: list = []  # elements and texts, in page order


def parse(page: str) -> Element:
    """The tree of a page."""
    root = Element("html", "", None)
    stack = [root]

    def close_to(k: int) -> None:
        del stack[k:]

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        upto = m.start() if m else len(page)
        if upto > at:
            stack[-1].kids.append(entities.unescape(page[at:upto]))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1] or m[4]:  # an end tag
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close_to(k)
                    break
                if stack[k].tag in ("article", "main", "td", "th", "table") and tag not in BLOCK:
                    break  # a stray end of an inline element outside
            continue
        if tag == "html":
            continue
        if tag in BLOCK:  # closes an open paragraph
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close_to(k)
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in CLOSES:
            what, until = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in until:
                    break
                if stack[k].tag in what:
                    close_to(k)
                    if tag in ("li", "option", "dt", "dd", "td", "th"):
                        break
        attributes = m[3] or m[6] or ""
        element = Element(tag, attributes, stack[-1])
        stack[-1].kids.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if tag not in NOISE and tag != "title":
                element.kids.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and not (attributes.rstrip().endswith("/") and tag in ("svg", "path")):
            stack.append(element)
    return root


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def walk(element: Element) -> Iterator[Element]:
    """All elements in page order, without recursion: pages may nest deeply."""
    stack = [element]
    while stack:
        e = stack.pop()
        yield e
        stack.extend(k for k in reversed(e.kids) if not isinstance(k, str))


def style_nodes(page: str) -> tuple[int, list[tuple[int, int, int]]]:
    """(hash of the page's text, (path, presentation, content) hashes of each path)."""
    order = list(walk(parse(page)))
    inner: dict[int, int] = {}
    nodes: dict[int, list[tuple[str, int]]] = {}
    for e in reversed(order):  # children first
        tags = [k if isinstance(k, str) else k.tag for k in e.kids if not isinstance(k, str)]
        shape = " ".join(t for n, t in enumerate(tags) if not n or tags[n - 1] != t)
        inner[id(e)] = hashed("\x01".join(" ".join(k.split()) if isinstance(k, str) else str(inner[id(k)]) for k in e.kids))
        nodes.setdefault(e.path, []).append((shape, inner[id(e)]))
    out = []
    for path, own in nodes.items():
        shapes = [s for s, _ in reversed(own)]
        out.append((path, hashed("\x02".join(s for n, s in enumerate(shapes) if not n or shapes[n - 1] != s)), hashed(" ".join(str(c) for _, c in own))))
    return inner[id(order[0])], out


def main_text(page: str, unimportant: frozenset[int] = frozenset()) -> str:
    """The blocks of the page's article, joined by line ends."""
    root = parse(page)

    def gone(e: Element) -> bool:
        return e.noise or bool(unimportant) and not (e.tag in PLAIN and not e.name) and not e.tag in ("article", "main") and e.path in unimportant

    def outermost(test) -> list[Element]:
        found, stack = [], [root]
        while stack:
            e = stack.pop()
            if e is not root and gone(e):
                continue
            if test(e):
                found.append(e)
            else:
                stack.extend(k for k in reversed(e.kids) if not isinstance(k, str))
        return found

    starts = outermost(lambda e: e.tag == "article" or e.role == "article") or outermost(lambda e: e.tag == "main" or e.role == "main") or outermost(lambda e: bool(e.name and MAIN_NAME.search(e.name))) or [root]
    blocks: list[str] = []
    words: list[str] = []

    def end_block() -> None:
        if text := " ".join("".join(words).split()):
            blocks.append(text)
        words.clear()

    for start in starts:
        stack: list = [start]
        while stack:
            e = stack.pop()
            if e is None:
                end_block()
            elif isinstance(e, str):
                words.append(e)
            elif e is not start and gone(e):
                words.append(" ")
            elif e.tag == "br":
                words.append(" ")
            else:
                if e.tag in BLOCK:
                    end_block()
                    stack.append(None)
                stack.extend(reversed(e.kids))
        end_block()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def unimportant_branches(pages: DataFrame) -> DataFrame:
    """(host, path) of the branches that all pages of a host have alike."""
    kind = pa.struct([("page", pa.int64()), ("nodes", pa.list_(pa.struct([("path", pa.int64()), ("shape", pa.int64()), ("content", pa.int64())])))])

    @F.arrow_udf("struct<page:long,nodes:array<struct<path:long,shape:long,content:long>>>")
    def styles(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            page, nodes = style_nodes(t.as_py() or "")
            out.append({"page": page, "nodes": [dict(zip(("path", "shape", "content"), n)) for n in nodes]})
        return pa.array(out, kind)

    found = pages.select(F.xxhash64(host_of(F.col("url"))).alias("host"), styles(F.col("html")).alias("s")).select("host", "s.page", F.explode("s.nodes").alias("n"))
    nodes = written(found.select("host", "page", "n.*").distinct(), "styles")  # equal pages are one

    def entropy(column: str) -> DataFrame:
        counts = nodes.groupBy("host", "path", column).agg(F.count("*").alias("n"))
        sums = counts.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
        value = F.when(F.col("m") > 1, 1 - F.col("s") / F.col("m") / F.log("m")).otherwise(1.0)
        return sums.select("host", "path", "m", value.alias(column))

    both = entropy("content").join(entropy("shape").drop("m"), ["host", "path"])
    importance = GAMMA * F.col("content") + (1 - GAMMA) * F.col("shape")
    return both.where((F.col("m") >= LEAST_PAGES) & (importance < LEAST_IMPORTANCE)).select("host", "path")


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``."""
    low = written(unimportant_branches(pages).groupBy("host").agg(F.collect_list("path").alias("paths")), "branches")
    size = low.agg(F.sum(F.size("paths"))).first()[0] or 0

    @F.arrow_udf("string")
    def extract(texts: pa.Array, paths: pa.Array) -> pa.Array:
        sets: dict = {}
        out = []
        for t, p in zip(texts, paths):
            key = tuple(p.as_py() or ())
            out.append(main_text(t.as_py() or "", sets.setdefault(key, frozenset(key))))
        return pa.array(out, pa.string())

    keyed = pages.select("page_id", "url", "html", F.xxhash64(host_of(F.col("url"))).alias("host"))
    joined = keyed.join(F.broadcast(low) if size <= MOST_BROADCAST else low, "host", "left")
    text = joined.select("page_id", "url", extract(F.col("html"), F.col("paths")).alias("text"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
