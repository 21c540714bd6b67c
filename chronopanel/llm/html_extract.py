"""Main text of web pages by tree scoring.

Paragraphs pass points for their length and commas to their ancestors, in full to the parent, half to the next and less
beyond; a container's points are discounted by the share of its text that is in links. The best container is kept, or
the article element that it lies in; where there is none, those of its siblings stay too that score near it or read like
paragraphs of it. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
cut before, by element, role and the words of class and id: by all words of a name, or by one where the element doesn't
read as running text. Nothing in an article element is cut for its links; in other containers, lists of short links are
that no heading for references and no colon announces. Titles of a main element before its article stay with it.

Blocks are what block elements bound. Within a block white space (and a line break element) is one space; blocks are
trimmed, and joined in page order by one newline.

Cases: null, empty or markup-only html gives an empty text; html without tags is one block; unclosed and crossed
elements are closed where an ancestor ends, an end tag without its start is passed over; pages may be of any length and
depth, in linear time; a null url passes through; repeated rows get equal results; an empty table gives no rows; other
columns pass through, and where one has the name of the result, the result's name gets underscores.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronopanel.llm.rows import free_name, with_verdict

# Fixed values of HTML: element names by role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "search",
}
#: A start tag of the key closes open elements of the value, up to the stop elements.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
CLOSED = set().union(*CLOSES.values())
STOPS = {"ul", "ol", "dl", "table", "select", "menu", "dir"}

# Elements, roles, and words of class or id that mark what isn't the main text.
CUT = {"nav", "aside", "footer", "form", "button", "select", "svg", "canvas", "template", "dialog", "object", "embed", "menu", "head", "input", "label", "fieldset", "audio", "video", "search"} | RAW
CUT_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form", "status", "tablist"}
#: Words that say so wherever they stand.
CUT_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsored", "promo", "promoted", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "sidebar", "related", "recommended", "recommendations", "share", "sharing", "social", "comment", "comments", "commentlist", "disqus", "footer", "masthead", "menu", "nav", "navbar", "navigation",
    "breadcrumb", "breadcrumbs", "pagination", "pager", "newsletter", "subscribe", "subscription", "signup", "login", "popup", "modal", "paywall", "outbrain", "taboola", "widget", "widgets", "toolbar",
}
#: Words that may name a part of an article, and say so outside of one.
CUT_WORDS_OUTSIDE = CUT_WORDS | {
    "banner", "sponsor", "promotion", "notification", "alert", "disclaimer", "aside", "rail", "respond", "replies", "reply", "foot", "overlay", "toc", "skip", "hidden", "copyright", "legal", "discussion",
    "feedback", "print", "search", "topbar", "header",
}
#: Words that name what readers write; they cut whatever the element holds.
COMMENT_WORDS = {"comment", "comments", "commentlist", "disqus", "respond", "responses", "reactions", "replies"}
#: Words that say nothing by themselves: a name of cut words and these alone says that it is to be cut.
FILLER = {
    "a", "above", "after", "all", "and", "area", "article", "articles", "aside", "author", "bar", "before", "below", "block", "blocks", "body", "bottom", "box", "boxes", "btn", "button", "buttons", "card", "cards",
    "center", "col", "column", "container", "content", "count", "desktop", "div", "dropdown", "extra", "fixed", "float", "form", "global", "grid", "group", "header", "heading", "holder", "icon", "icons", "id", "inline",
    "inner", "item", "items", "js", "left", "level", "link", "links", "list", "lists", "local", "main", "media", "mid", "mini", "mobile", "module", "more", "new", "news", "of", "on", "outer", "page", "panel", "part",
    "post", "posts", "primary", "reader", "readers", "right", "row", "secondary", "section", "sidebar", "site", "slot", "small", "sticky", "stories", "story", "strip", "sub", "text", "the", "thread", "title", "tools",
    "top", "unit", "user", "users", "view", "visitor", "wrap", "wrapper", "your", "zone",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: Characters of running text from which an element reads as a part of the page, whatever one word of its name says.
PROSE_CHARS = 60
_REFERENCES = re.compile(r"(references?|sources?|notes|footnotes|bibliography|literature|works cited|citations?|further reading)\W*$", re.I)
#: Names made of these alone mark the main text.
MAIN_WORDS = {"article", "main", "content", "body", "post", "entry", "story", "text"}
#: Elements of running text; what is inline in them isn't cut for its class.
PROSE = {"p", "li", "td", "th", "pre", "code", "blockquote", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "span", "a", "em", "strong", "b", "i"}
LEAST_PARAGRAPH = 25
#: Mean characters of a link's text in a list of short links.
SHORT_LINK = 25

_TOKEN = re.compile(r"<!--(?:>|->)|<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_QUOTE_OR_END = re.compile("[\"'>]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")


class Node:
    """An element; items are texts and elements in page order.

    block: the nearest block element, itself included. tops: of each tag that a start tag may close, the outermost open
    element up to the nearest stop element, with its depth.
    """

    __slots__ = ("attributes", "block", "depth", "items", "parent", "tag", "tops")

    def __init__(self, tag: str, parent: Node | None, attributes: dict[str, str]) -> None:
        self.tag, self.parent, self.attributes, self.items = tag, parent, attributes, []
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if parent is None or tag in BLOCK else parent.block
        self.tops: dict[str, tuple[int, Node]] = {} if parent is None or tag in STOPS else parent.tops
        if tag in CLOSED and tag not in self.tops:
            self.tops = {**self.tops, tag: (self.depth, self)}

    def elements(self) -> Iterator[Node]:
        return (x for x in self.items if isinstance(x, Node))


def parse(page: str) -> Node:
    """The tree of a page; text is decoded, raw text elements and comments stay empty."""
    root = now = Node("#root", None, {})
    n_open: Counter[str] = Counter()
    at, size, quotes = 0, len(page), True

    def tag_end(start: int) -> int:
        """Where the tag ends whose attributes begin at start, -1 if nowhere. Once a quote isn't closed in the rest of the page, quotes are plain characters."""
        nonlocal quotes
        here = start
        while quotes:
            m = _QUOTE_OR_END.search(page, here)
            if not m:
                quotes = False
            elif m[0] == ">":
                return m.start()
            else:
                here = page.find(m[0], m.end()) + 1
                quotes = here > 0
        return page.find(">", start)

    def close_to(parent: Node) -> None:
        nonlocal now
        while now is not parent:
            n_open[now.tag] -= 1
            now = now.parent

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            now.items.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            now.items.append(html.unescape(page[at : m.start()]))
        end = m.end() if m[2] is None else tag_end(m.end())
        if end < 0:
            now.items.append(html.unescape(page[m.start() :]))
            break
        at = end + (m[2] is not None)
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                now.items.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if n_open[tag]:
                while now.tag != tag:
                    close_to(now.parent)
                close_to(now.parent)
            continue
        if tag in BLOCK and now.block.tag == "p":
            close_to(now.block.parent)
        if tag in CLOSES:
            tops = [now.tops[t] for t in CLOSES[tag] if t in now.tops]
            if tops:
                close_to(min(tops, key=lambda x: x[0])[1].parent)
        raw = page[m.end() : end].strip()
        attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(raw)} if raw.strip("/") else {}
        made = Node(tag, now, attributes)
        now.items.append(made)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not (raw.endswith("/") and tag in ("path", "circle", "rect", "use")):
            now = made
            n_open[tag] += 1
    return root


def _words(name: str) -> set[str]:
    return {w.lower() for w in _WORD.findall(name)}


def _hides(node: Node) -> bool:
    a = node.attributes
    return "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I))


def is_boilerplate(node: Node, within_article: bool, reads: Callable[[Node], bool]) -> bool:
    """reads: whether a node holds running text, more of it than links.

    A class or id cuts where all of its words say so, or fill in; where only some do, what reads as running text stays.
    Paragraphs and headings of an article aren't cut for a name, and its sections not while they read as running text.
    What readers write goes, in an article a section of it only at the end.
    """
    if node.tag in CUT:
        return True
    if node.tag == "header":
        return not within_article
    names = [_words(x) for x in f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".split()]
    if node.tag in ("html", "body", "article", "main"):
        return node.tag == "article" and any(x & {"comment", "comments", "reply"} for x in names)
    if not node.attributes:
        return False
    if _hides(node) or node.attributes.get("role", "").lower() in CUT_ROLES:
        return True
    if within_article and (node.tag in HEADINGS or node.tag == "p" or node.tag not in BLOCK and node.parent.tag in PROSE):
        return False
    cut = CUT_WORDS | COMMENT_WORDS if within_article else CUT_WORDS_OUTSIDE | COMMENT_WORDS
    marked = [w for w in names if w & cut]
    if not marked or any(w and w <= MAIN_WORDS for w in names):
        return False
    sure = [w for w in marked if not w - cut - FILLER]
    if any(w & COMMENT_WORDS for w in sure):
        return not (within_article and node.tag == "section" and not any(w & {"comment", "comments"} for w in sure) and _is_followed(node))
    if not reads(node):
        return True
    return bool(sure) and not (node.tag in ("section", "p", *HEADINGS) and (within_article or not any(w & CUT_WORDS for w in sure)))


def _is_followed(node: Node) -> bool:
    """Whether a paragraph, heading or section comes after a node in its parent."""
    seen = False
    for x in node.parent.elements():
        if seen and x.tag in ("p", "section", "blockquote", *HEADINGS):
            return True
        seen = seen or x is node
    return False


def prune(root: Node) -> None:
    """Cut boilerplate elements everywhere below root."""
    measured: list[tuple[dict[Node, int], dict[Node, int]]] = []

    def reads(node: Node) -> bool:
        if not measured:
            measured.append(measure(_in_order(root))[:2])
        chars, links = measured[0]
        return chars[node] >= PROSE_CHARS and 2 * links[node] < chars[node]

    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        within = within or node.tag in ("article", "main")
        if any(isinstance(x, Node) for x in node.items):
            kept = {x for x in node.elements() if not is_boilerplate(x, within, reads)}
            node.items = [x for x in node.items if not isinstance(x, Node) or x in kept]
        todo += [(x, within) for x in node.elements()]


def _in_order(root: Node) -> list[Node]:
    """Elements below root and root itself, each before those in it."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(list(node.elements()))
    return out


def measure(nodes: Sequence[Node]) -> tuple[dict[Node, int], dict[Node, int], dict[Node, int]]:
    """Characters, characters in links, and commas of each element."""
    chars: dict[Node, int] = {}
    links: dict[Node, int] = {}
    commas: dict[Node, int] = {}
    for node in reversed(nodes):
        own = [x for x in node.items if isinstance(x, str)]
        chars[node] = sum(len(_SPACE.sub(" ", x).strip()) for x in own) + sum(chars[x] for x in node.elements())
        commas[node] = sum(x.count(",") + x.count("，") + x.count("、") for x in own) + sum(commas[x] for x in node.elements())
        links[node] = chars[node] if node.tag == "a" else sum(links[x] for x in node.elements())
    return chars, links, commas


def _is_paragraph(node: Node) -> bool:
    return node.tag in ("p", "pre", "blockquote", "td", "dd") or node.tag in ("div", "section", "article", "main", "body", "#root", "center") and any(isinstance(x, str) and x.strip() for x in node.items)


def main_nodes(root: Node) -> list[Node]:
    """The best container and those of its siblings that are kept, in page order."""
    nodes = _in_order(root)
    chars, links, commas = measure(nodes)
    if not chars[root]:
        return []
    density = lambda x: links[x] / chars[x] if chars[x] else 0.0
    points: dict[Node, float] = {}
    for node in nodes:
        if not _is_paragraph(node) or chars[node] < LEAST_PARAGRAPH:
            continue
        nested = [x for x in node.elements() if x.tag in BLOCK]
        size = chars[node] - sum(chars[x] for x in nested)
        if size < LEAST_PARAGRAPH:
            continue
        worth = 1 + commas[node] - sum(commas[x] for x in nested) + min(size / 100, 3)
        # loose text makes its container a paragraph of itself
        up, share = (node, 1.0) if node.tag not in ("p", "pre", "blockquote", "td", "dd") else (node.parent, 1.0)
        level = 0
        while up is not None and level < 6:
            points[up] = points.get(up, 0.0) + worth * share
            level += 1
            share = 0.5 if level == 1 else 1 / (3 * level)
            up = up.parent
    articles = [x for x in nodes if x.tag in ("article", "main") or x.attributes.get("role") == "main"]
    for node in articles:
        points[node] = points.get(node, 0.0) * 1.5 + 25 * (chars[node] > 0)
    score = {x: p * (1 - density(x)) for x, p in points.items()}
    if not score:
        return [root]
    best = max(score, key=lambda x: score[x])
    if best.tag in ("p", "pre", "blockquote", "td", "dd", "tr", "tbody", "li", "ul", "ol", "span", "b", "i", "em", "strong", "font") and best.parent:
        while best.parent and best.tag not in ("div", "section", "article", "main", "body", "#root", "center"):
            best = best.parent
    while best not in articles and best.parent and best.parent.tag not in ("#root", "html") and chars[best.parent] == chars[best]:
        best = best.parent
    if not best.parent or best.tag in ("body", "html"):
        return [best]
    inside = best
    while inside and inside.tag != "article":
        inside = inside.parent
    if inside is None:
        inside = best
        while inside and inside.tag != "main" and inside.attributes.get("role") != "main":
            inside = inside.parent
    best = inside or best
    if inside and inside.tag == "article":
        kept = _with_siblings(best, articles, score, chars, links)
        return [*(x for x in _titles_before(nodes, inside) if x not in kept), *kept]
    return _with_siblings(best, articles, score, chars, links, bool(inside))


def _titles_before(nodes: Sequence[Node], article: Node) -> list[Node]:
    """Headings of the main element that stand before its article."""
    main = article.parent
    while main and main.tag != "main" and main.attributes.get("role") != "main":
        main = main.parent
    found = []
    for x in nodes[nodes.index(main) :] if main else []:
        if x is article:
            return found
        if x.tag in ("h1", "h2"):
            up = x.parent
            while up is not main and up.tag != "article":
                up = up.parent
            if up is main:
                found.append(x)
    return found


def _with_siblings(best: Node, articles: Sequence[Node], score: dict[Node, float], chars: dict[Node, int], links: dict[Node, int], alone: bool = True) -> list[Node]:
    density = lambda x: links[x] / chars[x] if chars[x] else 0.0
    if alone and not [x for x in articles if x is not best and x.parent is best.parent]:
        return [best]
    least = max(10.0, 0.2 * score.get(best, 0.0))
    kept = []
    for x in best.parent.elements():
        reads = x.tag in ("p", "blockquote", "pre") and (chars[x] > 80 and density(x) < 0.25 or 0 < chars[x] and not links[x])
        title = x.tag in ("h1", "h2", "h3") and not links[x]
        if x is best or score.get(x, 0.0) >= least or reads or title:
            kept.append(x)
    return kept


def _text(node: Node) -> str:
    return "".join(x for y in _in_order(node) for x in y.items if isinstance(x, str))


def _announced(node: Node) -> bool:
    """Whether a heading for references, or a paragraph that ends in a colon, stands right before a node."""
    before = None
    for x in node.parent.elements():
        if x is node:
            break
        before = x
    if before is None:
        return False
    return before.tag in HEADINGS and bool(_REFERENCES.match(_text(before).strip())) or before.tag == "p" and _text(before).rstrip().endswith(":")


def _link_lists(node: Node) -> set[Node]:
    """Lists and groups below node that are short links for the most part; none in articles, and none that the text announces."""
    nodes = _in_order(node)
    chars, links, _ = measure(nodes)
    n_links: dict[Node, int] = {}
    for x in reversed(nodes):
        n_links[x] = (x.tag == "a") + sum(n_links[y] for y in x.elements())
    is_list = lambda x: x.tag in ("ul", "ol", "div", "section", "table", "dl") and n_links[x] > 1 and links[x] > 0.6 * chars[x] and links[x] <= SHORT_LINK * n_links[x]
    return {x for x in nodes if x is not node and is_list(x) and not (x.tag in ("ul", "ol", "dl") and _announced(x))}


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below node."""
    inside = node
    while inside and inside.tag not in ("article", "main") and inside.attributes.get("role") != "main":
        inside = inside.parent
    left_out = set() if inside else _link_lists(node)
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list[tuple[Node | str, bool]] = [(node, False)]
    while todo:
        x, leaving = todo.pop()
        if isinstance(x, str):
            run.append(x)
        elif leaving:
            close()
        elif x.tag == "br":
            run.append(" ")
        elif x not in left_out:
            if x.tag in BLOCK or x is node:
                close()
                todo.append((x, True))
            todo += [(y, False) for y in reversed(x.items)]
    close()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n".join(x for node in main_nodes(root) for x in blocks(node))


def extract(pages: DataFrame, column: str = "html", keep: Sequence[str] | None = None, name: str = "text") -> DataFrame:
    """pages with a column `name`, the main text of each page."""
    keep = list(pages.columns if keep is None else keep)
    name = free_name(pages.select(*(f"`{c}`" for c in keep)), name)
    return with_verdict(pages, lambda x: pa.array([main_text(p) for p in x.to_pylist()], pa.string()), [column], T.StringType(), name, keep=keep, rows=200)
