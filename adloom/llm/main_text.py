"""The main text of web pages by tree scoring.

Paragraphs pass points for length and commas to their ancestors, all of them to the parent,
half to the one above, less further up. A container's points are discounted by the part of its
text that is links. The best container, or the whole article or main element that it lies in, and
its siblings with few links are kept; what is never main text (scripts, menus, forms, adverts, comments of readers) is cut first.
"""

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML and what they mean for text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg"}
CUT = {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "object", "canvas", "menu"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "fieldset",
          "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main",
          "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr",
          "ul"}
SCORED = {"p", "pre", "blockquote", "td", "dd"}
CONTAINERS = {"article": 10.0, "main": 10.0, "section": 2.0, "div": 2.0, "blockquote": 1.0, "td": 1.0, "body": 0.0}
#: Words that mark what isn't main text, if a class or id holds no others but those of PLAIN_WORDS.
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs",
               "comment", "comments", "consent", "cookie", "cookies", "disqus", "dialog", "disclaimer", "footer", "gdpr",
               "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay",
               "pagination", "pager", "popup", "promo", "promoted", "promotion", "related", "replies", "reply", "respond",
               "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription",
               "toolbar", "topbar", "widget"}
#: Words that say where or in what form something stands, not what it is.
PLAIN_WORDS = {"area", "article", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content",
               "fixed", "form", "global", "google", "group", "icon", "icons", "inline", "inner", "item", "items", "left", "link",
               "links", "list", "main", "outer", "page", "panel", "post", "posts", "primary", "right", "secondary", "section",
               "site", "slot", "sticky", "stories", "thread", "top", "unit", "wrap", "wrapper"}
#: Part of an article where they stand in one; headings and paragraphs are never told by a class.
PARTS = {"header"}
TOLD_BY_TAG = {"html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "table", "tbody", "tr", "td", "th"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
#: An element with one of these start tags ends an open paragraph; a list item ends the one before.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"},
          "option": {"option"}}
LINKED = 0.5
#: Siblings of the main text are text themselves up to this part of links.
FEW_LINKS = 0.25
#: Within an article a list or box is a menu only if next to all its text is links and no heading leads to it.
ALL_LINKED = 0.95
WHOLE = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: A tag with attributes whose quotes may hold anything, and one that ends before the next tag.
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_STRICT = re.compile(r"<(/?)([A-Za-z][^\s/><]*)([^<>]*)>")
_OTHER = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?", re.DOTALL)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element. `before` is the sibling in front of it, `first` and `last` are children, all of them other than white
    space; `whole` tells whether it is or lies in an article or main element."""

    __slots__ = ("tag", "parent", "children", "aside", "text", "linked", "commas", "score", "before", "first", "last", "whole",
                 "headed")

    def __init__(self, tag: str, parent=None, aside: bool = False):
        self.tag, self.parent, self.aside, self.children = tag, parent, aside, []
        self.text = self.linked = self.commas = 0
        self.score, self.headed, self.first, self.last = 0.0, False, None, None
        self.before = parent.last if parent else None
        self.whole = tag in WHOLE or bool(parent and parent.whole)

    def add(self, child) -> None:
        self.children.append(child)
        if not isinstance(child, str) or child.strip():
            self.first = child if self.first is None else self.first
            self.last = child


def _marked(token: str, whole: bool) -> bool:
    """Whether a class or id names what isn't main text: by one of its words, and by the others nothing else."""
    words = [w.lower() for w in _WORD.findall(token) if len(w) > 1]
    found = [w for w in words if w in ASIDE_WORDS and not (whole and w in PARTS)]
    return bool(found) and all(w in ASIDE_WORDS or w in PLAIN_WORDS for w in words)


def _is_aside(tag: str, attributes: str, whole: bool) -> bool:
    if tag in CUT or tag in RAW:
        return True
    if not attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        value, name = value.strip("\"'"), name.lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value.lower() in ASIDE_ROLES:
            return True
        if name in ("class", "id") and tag not in TOLD_BY_TAG and any(_marked(t, whole) for t in value.split()):
            return True
    return False


class _Open:
    """The open elements, with the depths of each tag and of blocks, so that an end tag finds its own at once."""

    def __init__(self, root: Node):
        self.nodes, self.depths, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        depth = len(self.nodes)
        self.nodes.append(node)
        self.depths.setdefault(node.tag, []).append(depth)
        if node.tag in BLOCKS:
            self.blocks.append(depth)

    def leave(self, depth: int) -> None:
        """Close the element at `depth` and all within it."""
        while len(self.nodes) > depth:
            tag = self.nodes.pop().tag
            self.depths[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def depth(self, tag: str) -> int:
        """That of the innermost open element of a tag, 0 if there is none."""
        return (self.depths.get(tag) or [0])[-1]

    def end(self, tag: str) -> None:
        """An end tag; one of an inline element doesn't reach over a block, and one without a start is nothing."""
        depth = self.depth(tag)
        if depth and (tag in BLOCKS or depth > (self.blocks or [0])[-1]):
            self.leave(depth)

    def begin(self, tag: str) -> Node:
        """Where an element starts: an open paragraph or item that it ends is left."""
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        depth = max(map(self.depth, ends), default=0)
        if depth and depth >= (self.blocks or [0])[-1]:
            self.leave(depth)
        return self.nodes[-1]


def parse(page: str) -> Node:
    """The tree of a page; text is strings among the children. Unclosed and stray tags are mended.

    The time is linear in the page: no tag is sought behind the last `>`, and from the first tag on whose
    quotes don't end, tags end before the next one.
    """
    root = Node("html")
    open_, tag_at, place, here, end = _Open(root), _LOOSE, 0, 0, len(page)
    last = page.rfind(">")
    while True:
        here = page.find("<", here)
        if here < 0:
            break
        after = page[here + 1 : here + 3]
        m = _OTHER.match(page, here) if after[:1] in ("!", "?") and after else None
        if m is None and here < last and after.isascii() and after.lstrip("/")[:1].isalpha():
            m = tag_at.match(page, here)
            if m is None and tag_at is _LOOSE:
                tag_at = _STRICT
                m = tag_at.match(page, here)
        if m is None:
            here += 1
            continue
        if here > place:
            open_.nodes[-1].add(html.unescape(page[place:here]))
        place = here = m.end()
        if m.re is _OTHER:
            continue
        tag = m[2].lower()
        if m[1]:
            open_.end(tag)
        elif tag in VOID:
            open_.nodes[-1].add(Node(tag, open_.nodes[-1]))
        elif tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, place)
            place = here = close.end() if close else end
        elif tag != "html":
            now = open_.begin(tag)
            outer = tag == "header" and not open_.depth("article")
            child = Node(tag, now, outer or _is_aside(tag, m[3], now.whole))
            now.add(child)
            if not m[3].endswith("/") or tag in BLOCKS:
                open_.push(child)
    if place < end:
        open_.nodes[-1].add(html.unescape(page[place:]))
    return root


def _in_order(root: Node) -> list[Node]:
    """Elements that aren't aside, parents before children."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.aside)
    return found


def _scored(root: Node) -> list[Node]:
    """All elements with their amount of text, links and points."""
    nodes = _in_order(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.text += len(" ".join(c.split()))
                node.commas += c.count(",")
            elif not c.aside:
                node.text += c.text
                node.linked += c.linked
                node.commas += c.commas
        if node.tag == "a":
            node.linked = node.text
        node.score = CONTAINERS.get(node.tag, 0.0)
    for node in nodes:
        before, inner, up = node.before, node.first, node.parent
        node.headed = _heads(inner) or _heads(before) or before is None and up is not None and up.tag not in WHOLE and up.headed
        own = any(isinstance(c, str) and c.strip() for c in node.children)
        if not node.text or not (node.tag in SCORED or own and node.tag in BLOCKS):
            continue
        points = (1 + node.commas + min(node.text / 100, 3.0)) * (1 - node.linked / node.text)
        up, part = node.parent, 1.0
        for depth in range(5):
            if up is None:
                break
            up.score += points * part
            up, part = up.parent, part / 2 if depth == 0 else part * (depth + 1) / (depth + 2)
    return nodes


def _kept(root: Node) -> list[Node]:
    nodes = _scored(root)
    worth = lambda n: n.score * (1 - n.linked / n.text) if n.text else 0.0
    may = [n for n in nodes if n.tag in CONTAINERS and n.text]
    if not may:
        return [root]
    best = max(may, key=worth)  # of equals the outer one, which comes first
    up = best
    while up is not None and (up.tag not in WHOLE or up.linked > LINKED * up.text):
        up = up.parent
    best = up or best  # the whole article, not its longest section
    if best.parent is None:
        return [best]
    kept = []
    for c in best.parent.children:
        if not isinstance(c, Node) or c.aside:
            continue
        link = c.linked / c.text if c.text else 1.0
        if c is best or c.tag in BLOCKS and c.text and link < FEW_LINKS:
            kept.append(c)
        elif c.tag in ("h1", "h2") and c.text and link < LINKED:
            kept.append(c)
    return kept


def _is_menu(node: Node) -> bool:
    """A list or box within the main text that is links for the most part; within an article, for nothing else."""
    if node.tag not in ("ul", "ol", "div", "table", "section") or not node.text or node.linked <= LINKED * node.text:
        return False
    if not node.whole:
        return True
    return node.linked > ALL_LINKED * node.text and not node.headed


def _heads(item) -> bool:
    return isinstance(item, Node) and item.tag in HEADINGS


def main_text(page: str | None) -> str:
    """The main text of a page; blocks in page order, joined by one space."""
    root = parse(page or "")
    parts: list[str] = []
    todo: list = list(reversed(_kept(root)))
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            parts.append(item)
        elif not item.aside:
            gap = item.tag in BLOCKS or item.tag == "br"
            if gap:
                parts.append(" ")
            if not _is_menu(item):
                if gap:
                    todo.append(" ")
                todo.extend(reversed(item.children))
    return " ".join("".join(parts).split())


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars per row of `pages` (page_id, url, html; more are ignored).

    Null, empty and markup-only pages give an empty text; without a scored container all text
    that isn't aside counts. Broken markup is read as browsers do, roughly, and in time linear in the page.
    Classes and ids tell what isn't main text only where all their words agree, and never of headings and
    paragraphs. Repeated rows get equal results and an empty table an empty one.
    """

    @F.pandas_udf("string")
    def text_of(pages: pd.Series) -> pd.Series:
        return pages.map(main_text, na_action=None)

    rows = pages.select("page_id", "url", text_of("html").alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
