"""Main text of web pages, with site templates removed.

Every element subtree of a page gets a hash. Spark counts, per host, on how many pages with different main text a
subtree occurs; those that recur across many pages of the host are its template and are deleted, as are elements whose
tag, role, class or id names furniture (menus, headers, footers, side bars, notices, adverts, forms, comments). What is
left of the article gives the text, block by block.

Inside an article only containers can be template: a paragraph, heading, quotation or list item there is the author's,
however often it is repeated. Pages with equal main text count once, so copies of a page do not make its content look
like a template.

Defined results: null and empty html has an empty text; broken markup is read as far as it goes; a null or odd url
counts as one host without name; repeated rows and null ids give a row each; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
AUTHORED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr figcaption".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "thead": ("tbody", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"),
}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}

# What names furniture.
DROPPED_TAGS = frozenset("head script style noscript template textarea title iframe nav aside footer form button select option input label dialog menu svg canvas object audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription "
    "sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer foot masthead topbar "
    "share sharing social related recommended recommendations comment comments commentlist respond replies reply disqus discussion "
    "login signin signup search toolbar skip legal copyright disclaimer hidden".split()
)
HEADER_WORDS = frozenset(("header", "head", "top"))
COMMENT_WORDS = frozenset(("comment", "comments", "reply", "replies", "commentlist"))
_UNTESTED = frozenset(("html", "body", "main"))

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "attrs", "items", "key", "size")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.items, self.key, self.size = tag, attrs, [], 0, 0


def parse(text: str) -> Node:
    """Tree of a page. ``items`` of a node are strings and nodes. Missing end tags are implied as in HTML."""
    root = Node("", {})
    stack, at, end = [root], 0, len(text)

    def pop_to(names, stop=()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                del stack[k:]
                return
            if stack[k].tag in stop:
                return

    while at < end:
        m = _TOKEN.search(text, at)
        if not m:
            stack[-1].items.append(text[at:])
            break
        if m.start() > at:
            stack[-1].items.append(text[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            pop_to((tag,), () if tag in BLOCK else BLOCK)
            continue
        attrs = {}
        if m[3] and "=" in m[3] or m[3].strip(" /"):
            for a in _ATTRIBUTE.finditer(m[3]):
                attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        if tag in BLOCK:
            # a block ends an open paragraph of the same block
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in CLOSES:
            pop_to(CLOSES[tag], SCOPE.get(tag, ()))
        node = Node(tag, attrs)
        stack[-1].items.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.I).search(text, at)
            node.items.append(text[at : stop.start() if stop else end])
            at = stop.end() if stop else end
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCK and tag != "hr":
            stack.append(node)
    return root


def _words(value: str) -> set[str]:
    return {w.lower() for w in _SPLIT.split(value) if w}


def furniture(node: Node, in_article: bool) -> bool:
    """Does the element's tag, role, class or id say that it is no part of the article?"""
    tag, attrs = node.tag, node.attrs
    if tag in _UNTESTED:
        return False
    if tag in DROPPED_TAGS or tag == "header" and not in_article:
        return True
    if not attrs:
        return False
    words = _words(attrs.get("class", "") + " " + attrs.get("id", ""))
    if tag == "article":
        return bool(words & COMMENT_WORDS)
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if attrs.get("role", "").lower() in DROPPED_ROLES:
        return True
    return bool(words & DROPPED_WORDS) or not in_article and bool(words & HEADER_WORDS)


def _seal(node: Node) -> None:
    """Hashes and text sizes of all subtrees, children before parents, without recursion."""
    order, todo = [], [node]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [y for y in x.items if isinstance(y, Node)]
    for x in reversed(order):
        h = xxhash.xxh3_64(f"{x.tag} {x.attrs.get('class', '')} {x.attrs.get('id', '')}".encode("utf-8", "surrogatepass"))
        size = 0
        for y in x.items:
            if isinstance(y, Node):
                h.update(y.key.to_bytes(8, "little"))
                size += y.size
            elif part := " ".join(y.split()):
                h.update(part.encode("utf-8", "surrogatepass"))
                size += len(part)
        x.key, x.size = h.intdigest(), size


def _roots(page: Node) -> list[Node]:
    """The articles that are not furniture and lie in no other; else the main element; else the body or the page."""
    articles, mains, bodies = [], [], []
    todo = [page]
    while todo:
        x = todo.pop()
        if x is not page and furniture(x, False):
            continue
        if x.tag == "article":
            articles.append(x)
            continue
        if x.tag == "main" or x.attrs.get("role") == "main":
            mains.append(x)
        elif x.tag == "body":
            bodies.append(x)
        todo += [y for y in reversed(x.items) if isinstance(y, Node)]
    return articles or mains[:1] or bodies[:1] or [page]


def blocks(page: Node, template: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Text blocks of the main part, in page order, without furniture and without subtrees in ``template``."""
    out: list[str] = []
    open_parts: list[str] = []

    def close() -> None:
        if open_parts and (text := " ".join(entities.unescape("".join(open_parts)).split())):
            out.append(text)
        open_parts.clear()

    for root in _roots(page):
        authored = root.tag == "article"
        # items still to visit, last first; True marks the end of a block
        todo: list = [root]
        while todo:
            x = todo.pop()
            if x is True:
                close()
            elif isinstance(x, str):
                open_parts.append(x)
            elif x is not root and (furniture(x, authored) or x.key in template and not (authored and x.tag in AUTHORED)):
                # what is cut out of a block parts the words around it
                open_parts.append(" ")
            elif x.tag in ("br", "wbr", "img"):
                open_parts.append(" " if x.tag == "br" else "")
            else:
                if x.tag in BLOCK:
                    close()
                    todo.append(True)
                todo += reversed(x.items)
        close()
    return out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def _subtrees(mark, url, html):
    page = parse(html or "")
    _seal(page)
    keys = set()
    todo = [(y, False) for y in page.items if isinstance(y, Node)]
    while todo:
        x, inside = todo.pop()
        if x.tag in ("head", "script", "style"):
            continue
        if x.size and x.tag in BLOCK and x.tag not in _UNTESTED and x.tag != "article" and not (inside and x.tag in AUTHORED):
            keys.add(_signed(x.key))
        inside = inside or x.tag == "article"
        todo += [(y, inside) for y in x.items if isinstance(y, Node)]
    digest = xxhash.xxh3_64_intdigest("\n".join(blocks(page)).encode("utf-8", "surrogatepass"))
    host = xxhash.xxh3_64_intdigest(host_of(url).encode("utf-8", "surrogatepass"))
    yield mark, _signed(host), _signed(digest), sorted(keys)


def extract(pages: DataFrame, *, least_pages: int = 5, share: float = 0.2) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html).

    A subtree is template where it occurs on at least ``least_pages`` pages with different main text, and on at least
    ``share`` of those of its host. Counting moves hashes only; a host with a third of all pages is summed before the
    shuffle and spread by subtree. The deletions of each page are written to the shared folder and come back in a join
    whose side Spark picks by the written size.
    """
    from ..session import ensure_checkpoint_dir, scratch_path

    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    marked = pages.select("page_id", "url", "html", F.xxhash64("url", "html").alias("mark"))
    parsed = common.map_rows(marked, _subtrees, ["mark", "url", "html"], "mark long, host long, digest long, keys array<long>").checkpoint()

    seen = parsed.select("host", "digest", F.explode("keys").alias("key")).distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
    hosts = parsed.select("host", "digest").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    template = seen.filter(F.col("n") >= least_pages).join(hosts, "host").filter(F.col("n") >= share * F.col("pages")).select("host", "key")
    each = parsed.select("mark", "host", F.explode("keys").alias("key"))
    # a page's list is no longer than the page has elements
    gone = each.join(template, ["host", "key"]).groupBy("mark").agg(F.sort_array(F.collect_set("key")).alias("gone"))
    path = scratch_path(spark, "page-templates")
    gone.write.parquet(path)
    rows = marked.join(spark.read.schema("mark long, gone array<long>").parquet(path), "mark", "left")

    def text_of(page_id, url, html, gone):
        page = parse(html or "")
        if gone:
            _seal(page)
        text = "\n".join(blocks(page, {x % (1 << 64) for x in gone or ()}))
        yield page_id, url, text, len(text)

    return common.map_rows(rows, text_of, ["page_id", "url", "html", "gone"], "page_id long, url string, text string, n_chars long")
