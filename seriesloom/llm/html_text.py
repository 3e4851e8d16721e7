"""Main text of web pages by composite text density.

A page is read into its DOM. Menus, forms, notices and the like are taken out where
their element or its names say so. Every node then has its characters C and tags T,
those inside links LC and LT, and its composite text density

    C / T * log(C * T / (LC * LT)) to the base ln(C * LC / (C - LC) + C * LCbody / Cbody + e)

with 1 for zero divisors: characters per tag, lowered by links. A node's density sum is that of
its children. The node with the largest sum leads to the article; the least density
on its path up to the body is the threshold, and every other node that reaches it
adds the node of the largest sum below it. The text is that of these nodes, widened
to the article or main element around them, with what lies between them and the
headings just before.

Inside, character references are decoded, white space becomes one space per run,
and blocks are joined by an empty line. Nothing is shortened.

Null, empty and text-free pages give an empty text. A page whose text lies only in
elements named like boilerplate is read again without looking at names. Broken
markup (unclosed or stray tags, cut-off pages) is read as far as it goes. Repeated
rows are extracted each; other columns are kept.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .batches import add_column

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_PARAGRAPH = BLOCK - frozenset("html body caption tbody td tfoot th thead tr option optgroup legend".split())
SCOPES = frozenset("applet caption html table td th marquee object template button".split())
# An opening tag that ends an open one of these, unless a listed parent lies between.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)),
    "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ()),
}
# What is never part of an article.
DROPPED = frozenset(
    "head script style noscript template title nav footer aside form menu dialog button select input textarea label "
    "fieldset svg canvas iframe object embed audio video map noframes noembed frameset datalist search".split()
)
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status tooltip".split()
)
#: Words of class names and ids that name what surrounds an article.
SURROUNDINGS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promoted promotion "
    "promotions banner nav navbar navigation menu menus submenu topbar breadcrumb breadcrumbs sidebar sidebars aside rail footer foot masthead "
    "cookie cookies consent gdpr notice notices notification notifications popup popover modal overlay newsletter subscribe subscription signup "
    "login signin register paywall share sharing sharebar social related recommended recommendations trending popular comment comments "
    "commentlist commentform disqus respond reply replies reactions discussion feedback widget widgets toolbar pagination pager paging skip "
    "skiplink copyright legal disclaimer alert toast outbrain taboola tags tagcloud byline-share search searchbox form".split()
)
HEADERS = frozenset("header topheader siteheader pageheader".split())
#: A class such as has-sidebar or comments-open describes its element's neighbours, not the element.
SKIPPED_FIRST = frozenset("has no with without not hide show is".split())
SKIPPED_LAST = frozenset("open enabled on off closed".split())
KEPT = frozenset("html body main article".split())
ARTICLE_WORDS = frozenset("article entry post story".split())

TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?)*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z0-9]+")
HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "parent", "parts", "attrs", "chars", "tags", "link_chars", "link_tags", "density", "total", "named", "order")

    def __init__(self, tag: str, parent: Node | None, attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.parts: list[Node | str] = []  # children and texts in page order
        self.named = False

    def up(self) -> Iterator[Node]:
        node = self
        while node is not None:
            yield node
            node = node.parent


def parse(page: str) -> Node:
    """The DOM of a page, whatever its markup."""
    root = at = Node("html", None)
    position, size = 0, len(page)
    while position < size:
        found = TAG.search(page, position)
        start = found.start() if found else size
        if start > position:
            at.parts.append(page[position:start])
        if not found:
            break
        position = found.end()
        slash, name, attrs = found.groups()
        if not name:
            continue
        name = name.lower()
        if slash:
            at = _close(at, name)
            continue
        if name == "html":
            continue
        at = _implied(at, name)
        node = Node(name, at, attrs)
        at.parts.append(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(f"</{name}(?=[\\s/>]|\\Z)", re.I).search(page, position)
            inside = page[position : end.start() if end else size]
            if name != "noscript" and name in ("title", "textarea"):
                node.parts.append(inside)
            tail = page.find(">", end.start()) if end else -1
            position = tail + 1 if tail >= 0 else size
            continue
        at = node
    return root


def _close(at: Node, name: str) -> Node:
    """The open node after an end tag; a stray one changes nothing."""
    for node in at.up():
        if node.tag == name and node.parent is not None:
            return node.parent
        if node.tag in ("table", "td", "th") and name not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "body"):
            return at
        if name == "p" and node.tag in SCOPES or name not in BLOCK and node.tag in BLOCK:
            return at
    return at


def _implied(at: Node, name: str) -> Node:
    if name in ENDS_PARAGRAPH:
        for node in at.up():
            if node.tag == "p":
                at = node.parent
                break
            if node.tag in SCOPES:
                break
    if name in IMPLIED_END:
        ended, stops = IMPLIED_END[name]
        for node in at.up():
            if node.tag in stops:
                break
            if node.tag in ended and node.parent is not None:
                at = node.parent
                if name != "tr" or node.tag == "tr":
                    break
    return at


def surrounding(node: Node, inside_article: bool, names: bool) -> bool:
    """Whether an element is no part of an article, by its tag, role, state and names."""
    tag = node.tag
    if tag in DROPPED:
        return True
    if tag == "header":
        return not inside_article
    if not node.attrs or tag in KEPT:
        return False
    values = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(node.attrs)}
    if "hidden" in values or values.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style", ""), re.I):
        return True
    if values.get("role", "").lower() in DROPPED_ROLES:
        return True
    if not names or values.get("role", "").lower() in ("main", "article") or values.get("itemprop", "").lower() == "articlebody":
        return False
    for value in f"{values.get('class', '')} {values.get('id', '')}".split():
        words = WORDS.findall(HUMPS.sub(" ", value).lower())
        if not words or words[0] in SKIPPED_FIRST or words[-1] in SKIPPED_LAST:
            continue
        if not SURROUNDINGS.isdisjoint(words):
            return True
        if not HEADERS.isdisjoint(words) and not inside_article and ARTICLE_WORDS.isdisjoint(words):
            return True
    return False


def pruned(root: Node, names: bool) -> list[Node]:
    """Take surroundings out of the DOM and measure what stays; its nodes, parents first."""
    order: list[Node] = []
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        node.order = len(order)
        order.append(node)
        inside = inside or node.tag in ("article", "main")
        kept = [p for p in node.parts if isinstance(p, str) or not surrounding(p, inside, names)]
        node.parts = kept
        stack.extend((p, inside) for p in reversed(kept) if not isinstance(p, str))
    for node in reversed(order):
        chars = tags = link_chars = link_tags = 0
        for part in node.parts:
            if isinstance(part, str):
                chars += len("".join(part.split()))
            else:
                chars += part.chars
                tags += part.tags + 1
                link_chars += part.link_chars
                link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            link_chars, link_tags = chars, tags
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    whole = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        c, t = node.chars, max(node.tags, 1)
        if c:
            base = math.log(c * node.link_chars / max(c - node.link_chars, 1) + whole * c + math.e)
            ratio = c * t / (max(node.link_chars, 1) * max(node.link_tags, 1))
            node.density = c / t * math.log(max(ratio, 1.0)) / math.log(base) if base > 1 else c / t * math.log(max(ratio, 1.0))
        else:
            node.density = 0.0
        children = [p for p in node.parts if not isinstance(p, str)]
        node.total = sum(p.density for p in children) if any(p.density for p in children) else node.density
    return order


def best_below(node: Node) -> Node:
    """The node of the largest density sum; the outermost of equals."""
    best, stack = node, [node]
    while stack:
        at = stack.pop()
        if at.total > best.total or at.total == best.total and at.order < best.order:
            best = at
        stack.extend(p for p in at.parts if not isinstance(p, str))
    return best


def content(root: Node) -> list[Node | str]:
    """The parts of the page that are its article, in page order."""
    body = next((p for p in root.parts if not isinstance(p, str) and p.tag == "body"), root)
    if not body.chars:
        body = root
    top = best_below(body)
    path = [n for n in top.up()]
    threshold = min(n.density for n in path[: path.index(body) + 1])
    chosen = {id(top): top}
    inside = {id(n) for n in path}
    stack: list[tuple[Node, bool]] = [(body, False)]
    while stack:
        node, covered = stack.pop()
        covered = covered or id(node) in chosen
        if covered:
            continue
        if id(node) not in inside and node.chars and node.density >= threshold:
            found = best_below(node)
            chosen[id(found)] = found
            continue
        stack.extend((p, covered) for p in node.parts if not isinstance(p, str))
    return _widened(list(chosen.values()), body)


def _widened(nodes: list[Node], body: Node) -> list[Node | str]:
    wide = [next((u for u in n.up() if u.tag == "article"), None) or next((u for u in n.up() if u.tag == "main"), n) for n in nodes]
    paths = [list(reversed(list(n.up()))) for n in wide]
    depth = 0
    while all(len(p) > depth and p[depth] is paths[0][depth] for p in paths):
        depth += 1
    common = paths[0][depth - 1]
    if any(n is common for n in wide):
        first, last, parent = common, common, common.parent
    else:
        heads = sorted((p[depth] for p in paths), key=lambda n: n.order)
        first, last, parent = heads[0], heads[-1], common
    if parent is None or common is body and first is common:
        return [common]
    parts = parent.parts
    a = next(i for i, p in enumerate(parts) if p is first)
    b = next(i for i, p in enumerate(parts) if p is last)
    while first.tag not in ("article", "main", "body") and a:  # headings just before
        before = parts[a - 1]
        if isinstance(before, str) and not before.strip() or not isinstance(before, str) and before.tag in HEADINGS:
            a -= 1
        else:
            break
    return parts[a : b + 1]


def blocks(parts: list[Node | str]) -> list[str]:
    """Texts of the blocks in page order."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = list(reversed(parts))
    while stack:
        part = stack.pop()
        if part is None:
            end()
        elif isinstance(part, str):
            run.append(part)
        elif part.tag == "br":
            run.append("\n")
        elif part.tag in BLOCK:
            end()
            stack.append(None)
            stack.extend(reversed(part.parts))
        else:
            stack.extend(reversed(part.parts))
    end()
    return out


def main_text(page: str | None) -> str:
    """The article's text; empty if there is none."""
    if not page:
        return ""
    for names in (True, False):
        root = parse(page)
        pruned(root, names)
        if root.chars:
            return "\n\n".join(blocks(content(root)))
    return ""


def extract(pages: DataFrame, source: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``source``, with its main text as ``out``."""

    def compute(sources: list[str | None]) -> pa.Array:
        return pa.array([main_text(page) for page in sources], pa.string())

    return add_column(pages, source, out, T.StringType(), compute, drop=True)
