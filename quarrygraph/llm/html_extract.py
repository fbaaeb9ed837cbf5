"""Main text of web pages by tree scoring.

A page becomes a tree. Every paragraph gives points for its length and commas to the container that holds it, half as many
to the next one, a quarter to the next, and so on up to the root; a container's points are discounted by the share of its
text that lies in links, and <article> and <main> count a little more. The best container, and siblings of it that score
near it or hold prose, are kept; what is menu, header, footer, sidebar, notice, advert, form, comment section, script or
style is left out wherever it stands. Parsing, scoring and choosing take time in proportion to the page.

A class or id tells what an element is if one of its names consists of words that do, such as ``nav`` or ``related-posts``.
Comments, related pages, shares and adverts are left out whatever they hold; a menu, sidebar, banner or the like is not one if
it holds the article, with half of the page's prose at least. A name that only begins or ends so, as ``related-work``, counts
where the element holds no prose. Headings and running text are never left out for a name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sliced

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+)|([^\s=/]+)", re.S)
# fixed values: element names of the HTML standard
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCK = frozenset((
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    *HEADINGS, "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
))
# menus, headers, footers, sidebars, forms, scripts, styles, and what is no text of the page
DROPPED = frozenset((
    "script", "style", "noscript", "textarea", "title", "iframe", "svg", "canvas", "noembed", "noframes", "xmp",
    "head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "input", "menu",
))
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "thead": ("tr", "td", "th"), "tfoot": ("tr", "td", "th", "tbody"),
}
SCOPE = frozenset(("table", "ul", "ol", "dl", "body", "html", "article", "section", "div", "td", "th", "blockquote", "main", "aside", "nav", "header", "footer", "form"))
#: End tags that do not reach out of the container they stand in.
LOCAL = frozenset(("p", "li", "b", "i", "em", "strong", "span", "a"))
#: Elements that hold running text and are no container that could be chosen.
TEXTS = frozenset(("p", *HEADINGS, "li", "td", "th", "tr", "pre"))
#: Elements whose points go to their parent; the text of other blocks is their own.
GIVES = frozenset(("p", "pre", "blockquote", "li", "td", "h1", "h2", "h3"))
#: Elements that are never left out for their name; and those that are only for names that say so whatever they hold.
KEPT = frozenset(("html", "body", "p", *HEADINGS, "a", "b", "i", "em", "strong"))
HOLDERS = frozenset(("article", "main", "h1"))
CONTAINERS = frozenset(("article", "main"))
# words of class names and ids: what is never the article, what may be a wrapper of it, and what says nothing beside them
NEVER = (
    r"ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*"
    r"|comments?|commentlist|disqus|replies|respond"
)
WRAPPER = (
    r"banner|nav\w*|menu\w*|sidebar|widget\w*|footer|header|masthead|topbar|breadcrumb\w*|cookies?|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal"
    r"|pagination|pager|toolbar|skip|login|search"
)
BESIDE = (
    r"\d+|js|area|bar|block|body|bottom|box|button|buttons|container|content|depth|feed|fixed|form|global|grid|group|icons?|inner|items?|left|links?|list|main|meta|outer|page|panel|posts?"
    r"|primary|right|row|secondary|section|side|site|slot|thread|title|top|unit|wrap|wrapper"
)
WORDS = re.compile(r"[_\W]+")
IS_NEVER, IS_WRAPPER, IS_BESIDE = (re.compile(x, re.I) for x in (NEVER, WRAPPER, BESIDE))
STAYS, VAGUE, OUTSIDE, OUT = range(4)
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "toolbar", "alert", "dialog"))
GAPS = re.compile(r"\s+")
#: What <article> and <main> count more than other containers of the same points.
BONUS = 1.25
#: What is left of a paragraph's points one container further up.
SHARE = 0.5
#: Characters outside links that are prose, and the share of an element's characters that they must be.
PROSE, PROSE_SHARE = 60, 0.7


class Node:
    """name: what class, id or role say. chars, linked: characters and those in links, of all kept text within. own, commas:
    characters and commas of the text that is not in a block further in. score: what it got as a container. full, prose:
    characters within, and those outside links, before anything but what is OUT is left out."""

    __slots__ = ("tag", "name", "drop", "parent", "kids", "score", "chars", "linked", "text", "own", "commas", "full", "prose", "holds")

    def __init__(self, tag: str, parent: Node | None, name: int = STAYS) -> None:
        self.tag, self.parent, self.name, self.drop = tag, parent, name, tag in DROPPED
        self.kids: list = []
        self.score, self.chars, self.linked, self.text, self.own, self.commas, self.full, self.prose, self.holds = 0.0, 0, 0, 0, 0, 0, 0, 0, False


def attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(text)}


def told(name: str) -> int:
    """What one class or id says of its element."""
    words = [w for w in WORDS.split(name) if w]
    never, wrapper = [bool(IS_NEVER.fullmatch(w)) for w in words], [bool(IS_WRAPPER.fullmatch(w)) for w in words]
    if not any(never) and not any(wrapper) and name.lower() != "side-bar":
        return STAYS
    if all(a or b or IS_BESIDE.fullmatch(w) for a, b, w in zip(never, wrapper, words, strict=True)):
        return OUT if any(never) else OUTSIDE
    return VAGUE


def unwanted(tag: str, raw: str) -> int:
    """What an element's tag, role, classes and id say: it stays, stays with prose, stays as a wrapper of the article, or goes."""
    if tag in DROPPED:
        return OUT
    if not raw.strip() or tag in KEPT:
        return STAYS
    a = attributes(raw)
    names = max(map(told, [*a.get("class", "").split(), *a.get("id", "").split()]), default=STAYS)
    if tag in CONTAINERS:
        return OUT if names == OUT else STAYS
    return max(names, OUTSIDE if a.get("role", "").lower() in ROLES else STAYS)


class Open:
    """The open elements, with the places of each tag among them, so that no end tag has to look through all of them."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places, self.scopes = [root], {root.tag: [0]}, [0]

    @property
    def here(self) -> Node:
        return self.stack[-1]

    def last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else -1

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Closes the element at this place and all within; never the root."""
        while len(self.stack) > max(at, 1):
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def end(self, tag: str) -> None:
        at = self.last(tag)
        if at > 0 and not (tag in LOCAL and self.scopes[-1] > at):
            self.cut(at)

    def begin(self, tag: str) -> None:
        """Closes what a start tag ends by itself."""
        if tag in CLOSES_P and (p := self.last("p")) > self.scopes[-1]:
            self.cut(p)
        if ends := CLOSED_BY.get(tag):
            # a cell is a scope itself: only scopes that the tag does not end stop it
            while (at := max(map(self.last, ends))) > max((self.last(t) for t in SCOPE if t not in ends), default=-1) and at > 0:
                self.cut(at)


def parse(page: str) -> Node:
    """A tolerant tree: unclosed paragraphs, items and cells end where HTML says; stray end tags are ignored."""
    root = Node("html", None)
    at, open_ = 0, Open(root)
    while m := TOKEN.search(page, at):
        if m.start() > at:
            open_.here.kids.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            open_.end(tag)
            continue
        if tag == "html":
            continue
        if tag == "body":
            open_.cut(1)
        else:
            open_.begin(tag)
        node = Node(tag, open_.here, unwanted(tag, m[3]))
        open_.here.kids.append(node)
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif tag not in VOID:
            open_.push(node)
    if at < len(page):
        open_.here.kids.append(page[at:])
    return root


def elements(root: Node) -> list[Node]:
    """All elements that may be kept, each after its parent."""
    out, at = [root], 0
    while at < len(out):
        out += [k for k in out[at].kids if isinstance(k, Node) and k.tag not in DROPPED]
        at += 1
    return out


def settle(order: list[Node]) -> None:
    """What is left out, from the names and from what the elements hold."""
    for node in reversed(order):
        text = GAPS.sub(" ", "".join(html.unescape(k) for k in node.kids if isinstance(k, str))).strip()
        node.text, node.commas = len(text), text.count(",")
        node.full += node.text
        node.prose = 0 if node.tag == "a" else node.prose + node.text
        if node.parent is not None and node.name != OUT:
            node.parent.full += node.full
            node.parent.prose += node.prose
            node.parent.holds |= node.holds or node.tag in HOLDERS
    half = order[0].prose / 2
    for node in order:
        around = node.holds and node.prose >= half
        bare = node.prose < PROSE or node.prose < PROSE_SHARE * node.full
        gone = node.name == OUT or node.name == OUTSIDE and not around or node.name == VAGUE and bare and not around
        node.drop = gone or node.parent is not None and node.parent.drop


def measure(order: list[Node]) -> None:
    """Characters, links and scores of the elements, from the innermost out."""
    for node in reversed(order):
        if node.drop:
            node.commas = 0
            continue
        node.chars += node.text
        node.own += node.text
        if node.tag == "a":
            node.linked = node.chars
        block = node.tag in BLOCK
        given = 1 + node.commas + min(node.own / 100, 30) if block and node.own else 0.0
        if node.tag not in GIVES:
            node.score += given
            given = 0.0
        up = node.parent
        if up is None:
            continue
        up.chars += node.chars
        up.linked += node.linked
        if not block:
            up.own += node.own
            up.commas += node.commas
        # what came from within is halved at each container on its way up
        up.score += given + node.score * SHARE


def flat(node: Node) -> str:
    out, stack = [], [node]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif not k.drop:
            stack.extend(reversed(k.kids))
    return "".join(out)


def worth(node: Node) -> float:
    return node.score * (1 - node.linked / node.chars) * (BONUS if node.tag in ("article", "main") else 1) if node.chars else 0.0


def chosen(root: Node, order: list[Node]) -> list[Node]:
    """The best container (the outermost, then the first of equal ones), with those siblings that belong to it, in page order."""
    able = [n for n in order if not n.drop and n.tag in BLOCK and n.tag not in TEXTS and n is not root]
    best = max(able, key=worth, default=root)
    if best is root or worth(best) <= 0:
        return [root]
    out = []
    for k in best.parent.kids:
        if k is best:
            out.append(k)
        elif isinstance(k, Node) and not k.drop and k.chars and k.tag in BLOCK:
            prose = k.tag == "p" and k.linked < 0.25 * k.chars and (k.chars > 80 or re.search(r"[.!?]\s*$", flat(k)))
            if worth(k) >= 0.2 * worth(best) or k.tag in HEADINGS or prose:
                out.append(k)
    return out


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of blocks in page order: references decoded, white space as one space, empty ones left out."""
    out: list[str] = []
    have: list[str] = []

    def end() -> None:
        if have:
            text = GAPS.sub(" ", "".join(have)).strip()
            if text:
                out.append(text)
            have.clear()

    stack: list = list(reversed(nodes))
    while stack:
        k = stack.pop()
        if k is None:
            end()
        elif isinstance(k, str):
            have.append(html.unescape(k))  # a reference does not go on behind a tag
        elif k.drop:
            if k.tag in BLOCK:
                end()
        elif k.tag == "br":
            have.append(" ")
        elif k.tag in BLOCK:
            end()
            stack.append(None)
            stack.extend(reversed(k.kids))
        else:
            stack.extend(reversed(k.kids))
    end()
    return out


def main_text(page: str | None) -> str:
    """The page's article; empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    order = elements(root)
    settle(order)
    measure(order)
    return "\n".join(blocks(chosen(root, order)))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars (code points). Null or empty html: empty text, 0.

    Page by page without a shuffle, in time proportional to the page however deep it is. Null ids and urls stay null,
    repeated rows come out repeated, an empty table empty; other columns are left out.
    """

    def run(batched: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batched, 2):
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"]).mapInArrow(run, "page_id long, url string, text string, n_chars long")
