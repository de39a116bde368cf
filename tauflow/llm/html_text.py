"""Main text of web pages by composite text density.

The page becomes a tree of all nodes that are shown, menus and footers among them; scripts, styles and hidden nodes
have no shown text. For every node the composite density weighs characters per tag down where much of the text is in links
(on a page without any link it is characters per tag); a node's density sum is that of its children, text that stands
right in the node counting as one. The node with the largest sum is the content; the least density on its path up to the
body is the threshold, and other subtrees above it give their largest-sum node, too. Only then menus, headers, footers,
asides, forms and nodes whose class, id or role says advert, notice, comments and the like are cut out of what was chosen (a
node inside one is never chosen). Such a node that holds nearly all of the page's text (a form or a class around the whole
page) is a wrapper and not cut; only the marked nodes inside it are. Of a class name every word must say so or say
nothing ("sidebar-left", not "has-sidebar"). A chosen node inside an ``article`` is widened to the whole of it, and then only articles are
chosen; a ``main`` that holds the largest sum bounds what else is looked at. An article inside the chosen node replaces nothing.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed. Null
and empty pages give an empty text; so does a page with nothing but menus and footers; an empty table gives an empty one; of
equal density sums the first node in page order counts; broken and unclosed tags are read like a browser would nearly do; pages of any
length are taken whole; repeated rows each get their row. Other columns are not read.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tauflow.llm.common import record

# Element names of the HTML standard, and names that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
NOT_SHOWN_TAGS = frozenset("head script style noscript template svg math iframe object embed canvas audio video title".split())
CUT_TAGS = frozenset("nav footer aside form button select textarea input dialog menu".split())
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent"
    " gdpr notice notices alert newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs"
    " sidebar widget widgets related recommended recommendations share sharing social comment comments disqus reply replies"
    " popup modal overlay toolbar pagination pager paging skip footer topbar masthead".split()
)
# Words that say where or how, not what: a class name of these and words above only still marks clutter ("sidebar-left"), one
# with any other word does not ("has-sidebar", "share-prices").
NEUTRAL = frozenset(
    "area bar block bottom box center column container content global group header inner item items left links list main outer page"
    " panel primary right row secondary section site sticky top wrap wrapper".split()
)
KEPT_TAGS = frozenset("nav footer button select textarea input menu".split())  # never taken for a wrapper of the page
CUT_ARTICLES = frozenset("comment comments reply replies related recommended ad ads advert promo sponsored".split())
TITLED = frozenset("post entry article content story".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
CLOSED_BY = {  # an open element that a new one of these ends
    "p": BLOCKS - {"body", "html", "head", "option", "optgroup"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option", "optgroup"}, "head": {"body"},
}
WALLS = frozenset("table td th article section main div body html ul ol dl blockquote".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?|["'=]""")
#: A marked node that holds so many times the text outside all marked nodes is a wrapper of the page, not clutter in it.
WRAPPER = 10
_PARTS = re.compile(r"[^a-z0-9]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
PAGE = record(text="string", n_chars="long")


class Node:
    __slots__ = ("tag", "parent", "children", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "hidden", "mark", "cut")

    def __init__(self, tag: str, parent: Node | None, hidden: bool = False, mark: int = 0):
        self.tag, self.parent, self.hidden, self.mark, self.cut = tag, parent, hidden, mark, hidden
        self.children: list[Node] = []
        self.parts: list = []  # texts and child nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _attributes(text: str) -> dict[str, str]:
    """Names and values; the first of equal names counts, a name without a value has an empty one."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text) if text else ():
        if m[1]:
            found.setdefault(m[1].lower(), (m[2] or "").strip("\"'").lower())
    return found


def _is_hidden(tag: str, attributes: dict[str, str]) -> bool:
    return tag in NOT_SHOWN_TAGS or "hidden" in attributes or bool(_NOT_SHOWN.search(attributes.get("style", "")))


def _is_clutter(tag: str, attributes: dict[str, str], inside_article: bool) -> bool:
    if tag in CUT_TAGS or tag == "header" and not inside_article or attributes.get("role", "").strip() in CUT_ROLES:
        return True
    if tag in ("body", "html", "main"):
        return False
    cut = CUT_ARTICLES if tag == "article" else CUT_NAMES
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    titled = inside_article or tag == "article" or tag in HEADINGS or any(TITLED.intersection(_PARTS.split(n)) for n in names)
    for name in names:
        parts = set(_PARTS.split(name)) - {""}
        # The head of the page counts, but not that of a post, which holds its title.
        if parts <= cut | NEUTRAL and (parts & cut or "header" in parts and not titled):
            return True
    return False


def settle_cuts(body: Node) -> None:
    """Decide which marked nodes are cut: those outermost, unless one wraps the page, whose own marked parts then count.

    Needs the characters of ``weigh``.
    """
    outer, left = _outermost(body), 0
    left = body.chars - sum(n.chars for n in outer)
    while True:
        most = max((n for n in outer if n.tag not in KEPT_TAGS), key=lambda n: n.chars, default=None)
        if most is None or not most.chars or most.chars < WRAPPER * left:
            break
        most.mark = 0
        inner = _outermost(most)
        outer = [*(n for n in outer if n is not most), *inner]
        left += most.chars - sum(n.chars for n in inner)
    for n in _in_order(body):
        n.cut = n.hidden or n.mark > 0 or n is not body and n.parent.cut


def _outermost(node: Node) -> list[Node]:
    """Marked nodes below a node that are in no other marked one below it."""
    found, todo = [], list(node.children)
    while todo:
        n = todo.pop()
        if n.mark:
            found.append(n)
        else:
            todo.extend(n.children)
    return found


def parse(page: str) -> Node:
    """Tree of the page; what is not shown is left off the tree, what looks like clutter is in it and marked."""
    root = Node("html", None)
    here, at, articles = root, 0, 0
    opened: list[Node] = [root]
    while True:
        m = _MARKUP.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not here.hidden:
            here.parts.append(text)
        if not m:
            return root
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not here.hidden:
                here.parts.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        if m[1] or m[4]:
            for k in range(len(opened) - 1, 0, -1):
                if opened[k].tag == tag:
                    articles -= sum(n.tag in ("article", "main") for n in opened[k:])
                    del opened[k:]
                    break
                if opened[k].tag in WALLS and tag not in BLOCKS:
                    break
            here = opened[-1]
            continue
        for k in range(len(opened) - 1, 0, -1):
            if tag in CLOSED_BY.get(opened[k].tag, ()):
                del opened[k:]
                break
            if opened[k].tag in WALLS:
                break
        here = opened[-1]
        if tag in ("html", "body") and any(n.tag == tag for n in opened[1 if tag == "body" else 0 :]):
            continue
        written = m[3] or m[6] or ""
        attributes = _attributes(written)
        hidden = here.hidden or _is_hidden(tag, attributes)
        node = Node(tag, here, hidden, int(not hidden and _is_clutter(tag, attributes, articles > 0)))
        if not here.hidden:
            here.parts.append(node)
            if not hidden:
                here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not written.rstrip().endswith("/") or tag in BLOCKS - VOID:
            opened.append(node)
            articles += tag in ("article", "main")
            here = node


def _in_order(root: Node) -> list[Node]:
    """All nodes, parents first (no recursion: trees may be deep)."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo.extend(reversed(n.children))
    return out


def _density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite density; ``share`` is that of the page's characters in links."""
    if not chars:
        return 0.0
    base = log(chars / max(chars - link_chars, 1) * link_chars + share * chars + e)
    if base <= 1:  # no link on the page
        return chars / max(tags, 1)
    worth = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * max(log(worth) / log(base), 0.0)


def weigh(root: Node) -> list[Node]:
    """Fill in characters, tags, link shares, density and density sum of every node; returns them parents first."""
    nodes = _in_order(root)
    own = {id(n): sum(len("".join(p.split())) for p in n.parts if isinstance(p, str)) for n in nodes}
    for n in reversed(nodes):
        n.chars += own[id(n)]
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
        if n.parent is not None:
            up = n.parent
            up.chars, up.tags = up.chars + n.chars, up.tags + n.tags + 1
            up.link_chars, up.link_tags = up.link_chars + n.link_chars, up.link_tags + n.link_tags
    body = next((n for n in nodes if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for n in nodes:
        n.density = _density(n.chars, n.tags, n.link_chars, n.link_tags, share)
    for n in nodes:
        linked = own[id(n)] if n.tag == "a" else 0
        n.total = _density(own[id(n)], 1, linked, linked and 1, share) + sum(c.density for c in n.children)
    return nodes


def content_nodes(root: Node) -> list[Node]:
    """Nodes that hold the article, outermost only, in page order."""
    nodes = weigh(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    settle_cuts(body)
    inside = [n for n in _in_order(body) if not n.cut]
    best = max(inside, key=lambda n: n.total, default=body)
    if best.total <= 0:
        return [body]
    path = best
    threshold = best.density
    while path is not body and path.parent is not None:
        path = path.parent
        threshold = min(threshold, path.density)
    scope = next((n for n in _path(best) if n.tag == "main"), body)
    # Each node widened to the outermost article that holds it.
    widened: dict[int, Node] = {}
    for n in inside:
        above = widened.get(id(n.parent), n)
        widened[id(n)] = above if above.tag == "article" else n
    in_article = widened[id(best)].tag == "article"
    marked = {id(widened[id(best)])}
    # Largest sum in each subtree, bottom up; a subtree counts if its density reaches the threshold.
    top: dict[int, Node] = {}
    for n in reversed(inside):
        top[id(n)] = max([n, *[top[id(c)] for c in n.children if not c.cut]], key=lambda x: x.total)
    todo = [scope]
    while todo:
        n = todo.pop()
        if n.density >= threshold:
            wide = widened[id(top[id(n)])]
            if wide.total > 0 and (wide.tag == "article" or not in_article):
                marked.add(id(wide))
            todo.extend(c for c in n.children if not c.cut)
    out, todo = [], [body]
    while todo:
        n = todo.pop()
        if id(n) in marked:
            out += [*_headings_before(n), n]
        else:
            todo.extend(reversed(n.children))
    return out or [body]


def _headings_before(node: Node) -> list[Node]:
    """Headings that stand right before a node, among the children of its parent."""
    found: list[Node] = []
    for n in node.parent.children if node.parent is not None else []:
        if n is node:
            return found
        found = [*found, n] if n.tag in HEADINGS else []
    return []


def _path(node: Node) -> list[Node]:
    """The node and all above it, the node first."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks below a node, white space made one space."""
    out, pieces = [], []

    def end_block():
        text = " ".join(unescape("".join(pieces)).split())
        if text:
            out.append(text)
        pieces.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end_block()
        elif isinstance(x, str):
            pieces.append(x)
        else:
            block = x.tag in BLOCKS
            if block:
                end_block()
                todo.append(None)
            elif x.tag == "br":
                pieces.append(" ")
            if not x.cut:
                todo.extend(reversed(x.parts))
    end_block()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(b for n in content_nodes(parse(page)) for b in blocks_of(n))


@F.pandas_udf(PAGE)
def main_texts(pages: pd.Series) -> pd.DataFrame:
    texts = [main_text(p) for p in pages]
    return pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars."""
    return pages.select("page_id", "url", main_texts("html").alias("_p")).select("page_id", "url", "_p.*")
