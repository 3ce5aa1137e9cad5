"""Main text of web pages by tree scoring.

A page is read into a tree of block elements.  Every paragraph gives points, for its
length and its commas, to its ancestors, discounted by the share of its text that lies
in links.  The container with the most points, its enclosing article, and siblings that
look like it are kept; menus, forms, notices and other page furniture are left out.

Flags go down the tree and sums go up it once, and open elements are found by name, so a
page takes time in proportion to its length, however deep it is nested.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from emberline.llm.arrow import widened

# Element names of the HTML standard, by role.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "object", "canvas", "noembed", "noframes", "xmp", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
FURNITURE = {"nav", "aside", "footer", "menu", "button", "dialog", "head"}
#: elements that may hold a whole page as well: they count as furniture unless they do
FORMS = {"form", "fieldset"}
LISTS = {"ul", "ol", "dl", "table"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: elements that are text themselves and are not judged by their names
PARAGRAPHS = {"p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "figcaption", "html", "body", "article", "main"} | HEADINGS
CLOSES_P = BLOCK - {"button", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "head", "body", "html", "summary", "figcaption"}
#: words in class, id or role that mark page furniture
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo",
    "cookie", "cookies", "copyright", "discussion", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "navigational",
    "newsletter", "notice", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "respond", "search", "share", "sharing",
    "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget", "widgets", "topbar", "alert",
}
#: those of them that mark what readers say, which may be longer than the article
READERS = {"comment", "comments", "discussion", "disqus", "replies", "respond"}
#: words that may stand beside one of NAMES in such a mark; with any other word it is no mark
BESIDE = {
    "and", "area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "by", "container", "desktop", "fixed", "form", "global", "google", "group", "header", "holder", "icons", "inner",
    "item", "items", "left", "link", "links", "list", "local", "main", "media", "message", "mobile", "outer", "page", "panel", "post", "posts", "primary", "reader", "right", "row", "secondary", "section",
    "site", "skip", "slot", "small", "sticky", "stories", "thread", "top", "unit", "us", "user", "wrap", "wrapper", "zone",
}

_TAG = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^<>"']|"[^"]*"|'[^']*'|["'])*+)>|[!?][^>]*+>)""", re.S)
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


class Node:
    """A block element; marked: it looks like furniture, which its content can refute."""

    __slots__ = ("children", "chars", "deep", "inside", "junk", "kept", "linked", "marked", "name", "parent", "points", "worth")

    def __init__(self, name: str, parent: Node | None, junk: bool, marked: bool = False):
        self.name, self.parent, self.junk, self.marked = name, parent, junk, marked
        self.inside = parent is not None and (parent.inside or parent.name == "article")
        self.points, self.worth, self.deep, self.linked, self.chars, self.children, self.kept = 0.0, 0.0, 0.0, 0, 0, [], False


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    linked: int


def _named(attributes: str, inside: bool) -> set[str]:
    """The words of class, id or role that mark furniture; a header or a discussion within an article is part of it."""
    found, every = set(), set()
    for m in _MARK.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            words = {w.lower() for w in _SPLIT.split(token) if w}
            every |= words
            core = words & NAMES or (not inside and words & {"header"}) or (words <= {"skip", "link", "links"} and words & {"skip"})
            if core and words <= NAMES | BESIDE:
                found |= words
    if inside and every == {"discussion"}:
        return set()  # a part of the article that has this name
    return found


class _Open:
    """The open elements, from the outermost; where each name is open is known by its name."""

    def __init__(self, root: Node):
        self.path, self.at = [root], {root.name: [0]}

    @property
    def top(self) -> Node:
        return self.path[-1]

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.path))
        self.path.append(node)

    def last(self, names) -> int:
        """Depth of the innermost open element of these names, -1 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def close(self, depth: int) -> None:
        """Close the element at this depth and all within; the root stays."""
        while len(self.path) > max(depth, 1):
            self.at[self.path.pop().name].pop()


#: elements that a new one of the group ends, unless one of the others is open within
ENDS = (({"li"}, {"ul", "ol", "menu"}), ({"dd", "dt"}, {"dl"}), ({"td", "th"}, {"tr", "table"}), ({"tr"}, {"table"}))


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """All elements, parents first, and the runs of text between block boundaries, in page order."""
    root = Node("html", None, False)
    nodes, opened, blocks, run, links, anchor = [root], _Open(root), [], [], 0, 0

    def flush():
        nonlocal links
        if run:
            text = _SPACE.sub(" ", "".join(run)).strip()
            if text:
                blocks.append(Block(opened.top, text, min(links, len(text))))
            run.clear()
        links = 0

    def say(raw: str):
        nonlocal links
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if anchor:
                links += len(text)

    at, end, ended = 0, len(page), set()
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                anchor = max(0, anchor - 1)
            elif name in BLOCK:
                flush()
                depth = opened.last((name,))
                if depth > 0:
                    opened.close(depth)
                    anchor = 0
        elif name in RAW:
            close = None if name in ended else _END[name].search(page, at)
            if close is None:
                ended.add(name)
            at = close.end() if close else end
        elif name == "a":
            anchor += 1
        elif name in ("br", "hr", "wbr", "img"):
            if name != "wbr":
                run.append(" ")
            if name == "hr":
                flush()
        elif name in BLOCK:
            flush()
            anchor = 0
            if name in ("html", "body"):
                if name == "html" or opened.last(("body",)) >= 0:
                    continue
                opened.close(1)
            if name in CLOSES_P:
                depth = len(opened.path) - 1
                while depth > 0 and opened.path[depth].name in HEADINGS:
                    depth -= 1
                if opened.path[depth].name == "p":
                    opened.close(depth)
            for group, stop in ENDS:
                if name in group and (depth := opened.last(group)) > opened.last(stop - group):
                    opened.close(depth)
            if name in HEADINGS and opened.top.name in HEADINGS:
                opened.close(len(opened.path) - 1)
            top, told = opened.top, m[3]
            inside = top.inside or top.name == "article"
            names = _named(told, inside) if told and (name not in PARAGRAPHS or name == "article") else set()
            junk = top.junk or name in FURNITURE or (name == "header" and not inside) or bool(names & READERS) or bool(told and name not in ("html", "body") and _HIDDEN.search(told))
            marked = not junk and name != "article" and (name in FORMS or bool(names))
            node = Node(name, top, junk, marked)
            top.children.append(node)
            nodes.append(node)
            opened.push(node)
    flush()
    return nodes, blocks


def _score(node: Node) -> float:
    return node.points * (1 - node.linked / max(node.chars, 1))


def _refute(nodes: list[Node], blocks: list[Block]) -> None:
    """Furniture by name or form stays so, unless it holds most of what articles say.

    Without an article a form stands for the page if it holds most of the text, and an
    element with a name of furniture if it holds nearly all.
    """
    chars, said = {id(n): 0 for n in nodes}, {id(n): 0 for n in nodes}
    for b in blocks:
        if not b.node.junk and b.node.name not in HEADINGS:
            chars[id(b.node)] += len(b.text) - b.linked
    for n in reversed(nodes):
        if n.parent is not None:
            chars[id(n.parent)] += chars[id(n)]
            said[id(n.parent)] += chars[id(n)] if n.name in ("article", "main") and not n.junk else said[id(n)]
    page, articles = chars[id(nodes[0])], said[id(nodes[0])]
    for n in nodes:
        if n.parent is not None and n.parent.junk:
            n.junk = True
        elif n.marked:
            n.junk = not (2 * said[id(n)] > articles if articles else (2 if n.name in FORMS else 1.1) * chars[id(n)] > page)


def _menus(nodes: list[Node], blocks: list[Block]) -> set[int]:
    """Lists and tables that are nearly all links, with all within them.

    Within an article they are text of it if text of the article comes after them, or if a
    heading stands right before them.
    """
    lists = {id(n) for n in nodes if n.name in LISTS and n.linked > 0.8 * n.chars}
    if not lists:
        return lists
    within, article, headed, before = {}, {}, set(), {}
    for n in nodes:  # the outermost such list, and the innermost article
        up = id(n.parent)
        within[id(n)] = within.get(up) or (id(n) if id(n) in lists else None)
        article[id(n)] = id(n) if n.name == "article" else article.get(up)
        if id(n) in lists and before.get(up) in HEADINGS:
            headed.add(id(n))
        before[up] = n.name
    last = {article[id(b.node)]: at for at, b in enumerate(blocks) if within[id(b.node)] is None}
    text = set()
    for at, b in enumerate(blocks):
        outer, own = within[id(b.node)], article[id(b.node)]
        if outer is not None and own is not None and article[outer] == own and (outer in headed or at < last.get(own, -1)):
            text.add(outer)
    return {id(n) for n in nodes if within[id(n)] is not None and within[id(n)] not in text}


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by line feeds; empty if there are none."""
    nodes, blocks = parse(page or "")
    _refute(nodes, blocks)
    blocks = [b for b in blocks if not b.node.junk]
    if not blocks:
        return ""
    for b in blocks:
        b.node.chars += len(b.text)
        b.node.linked += b.linked
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
    menus = _menus(nodes, blocks)
    blocks = [b for b in blocks if id(b.node) not in menus]
    scored = False
    for b in blocks:
        if b.node.name in HEADINGS:
            continue
        worth = (1 + b.text.count(",") + min(len(b.text) / 100, 3)) * (1 - b.linked / len(b.text))
        holder = b.node if b.node.name in ("div", "section", "article", "main", "body", "html") else b.node.parent or b.node
        holder.worth += worth
        scored = True
    if not scored:
        return "\n".join(b.text for b in blocks)
    for n in reversed(nodes):  # the holder and those above it, the farther the less; from the fifth on a twelfth
        if n.worth:
            above = n
            for share in (1, 2, 6, 9):
                above.points += n.worth / share
                above = above.parent
                if above is None:
                    break
            else:
                above.deep += n.worth / 12
    for n in reversed(nodes):
        n.points += n.deep
        if n.parent is not None:
            n.parent.deep += n.deep
    best = max((n for n in nodes if not n.junk and n.points), key=lambda n: round(_score(n), 9), default=nodes[0])
    whole = next((n for n in _ancestors(best) if n.name in ("article", "main")), None)
    best = whole or best
    best.kept = True
    if best.parent is not None:
        floor = max(3.0, 0.2 * _score(best))
        for other in best.parent.children:
            paragraph = other.name in ("p", "pre", "blockquote") and other.chars > 0 and other.linked < 0.25 * other.chars
            another = whole is not None and other.name == whole.name and other.linked < 0.5 * other.chars
            if not other.junk and (another or _score(other) >= floor or (whole is None and (paragraph or other.name in HEADINGS))):
                other.kept = True
    for n in nodes:
        n.kept = n.kept or (n.parent is not None and n.parent.kept)
    return "\n".join(b.text for b in blocks if b.node.kept)


def _ancestors(node: Node | None):
    while node is not None:
        yield node
        node = node.parent


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with columns text and n_chars (columns of that name are replaced).

    The whole page is read.  A null or empty page, and one without main text, gives the
    empty string and 0.  Each row is on its own, so repeated rows give equal results.
    """
    pages = pages.drop("text", "n_chars")

    def run(batches):
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(b.schema.get_field_index(html_col))]
            b = b.append_column("text", pa.array(texts, pa.string()))
            yield b.append_column("n_chars", pa.array(map(len, texts), pa.int64()))

    return pages.mapInArrow(run, widened(pages, "text string, n_chars long"))
