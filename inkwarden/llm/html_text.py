"""Main text of web pages by tree scoring.

The page is read in one pass into a tree, by the rules of browsers for tags, attributes, comments and raw text,
with their usual repairs (paragraphs, list items and cells close each other, void elements have no end, unclosed
elements end with their parent). Branches that are never article text (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) are cut: by their tag, role or whole class name, or, where a name
only sounds like one, by the share of links in their text. Paragraphs pass points for their length and commas to
their ancestors, less the further away; a container's points are discounted by the share of its text in links. The
container with most points is kept and widened to the article or main part it lies in, or else as far as what is
added isn't made of links; its siblings that look like part of it are kept, too. Blocks are written in page order.

Results: null pages count as empty; a page without blocks has an empty text; repeated rows repeat; broken markup
never raises and takes time in proportion to the page, as no tag looks further than ``CLIMB`` ancestors up and the
tree is at most ``DEEPEST`` levels deep; every block of the kept containers is returned whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Levels of the tree (elements further down become siblings), ancestors a tag looks at, and ancestors that get points.
DEEPEST, CLIMB, GIVEN = 512, 64, 12
#: Share of a branch's text in links from which it is a list of links; length from which bare text counts as a paragraph.
LINKS, BARE = 0.5, 25

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*)?")
_EQUALS = re.compile(r"=\s*\Z")
_BARE_VALUE = re.compile(r"[^\s>]*")
_COMMENT_END = re.compile(r"--!?>")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe xmp noembed noframes noscript".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img "
    "math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace semantics annotation".split()
)
_CUT = frozenset("head nav footer aside form button select option input menu dialog canvas audio video object applet map datalist template svg".split()) | _RAW
_CUT_ROLE = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form".split())
#: What a name may say of a branch that isn't article text.
_WORDS = (
    "ad|ads|advert|adverts|advertisement|advertisements|advertising|adsense|banner|breadcrumb|breadcrumbs|comment|comments|commentlist|disqus|cookie|cookies|consent|gdpr|notice|notices|notification|alert|"
    "footer|header|masthead|menu|menus|modal|nav|navbar|navigation|newsletter|outbrain|pagination|pager|popup|popular|promo|promoted|promotion|related|recommended|recommendations|replies|reply|respond|"
    "share|sharing|sidebar|side|skip|social|sponsor|sponsored|sponsors|subscribe|subscription|taboola|tags|toolbar|topbar|widget|widgets"
)
_SOUNDS = re.compile(rf"(?:^|[-_\s])(?:{_WORDS})(?:$|[-_\s])", re.I)
#: Such words that say it of a part of an article, too, and words for places and boxes that may stand beside them.
_SURE = frozenset(_WORDS.split("|")) - frozenset("alert banner header masthead popular side tags".split())
_BOXES = frozenset(
    "the site page main post article entry user reader global top bottom left right primary secondary sticky google area bar block box buttons container content form inner item items links "
    "list outer overlay panel posts articles stories section signup slot thread unit wrap wrapper".split()
)
_KEEP_NAME = re.compile(r"(?:^|[-_\s])(?:article|body|content|entry|main|post|story|text)(?:$|[-_\s])", re.I)
_ARTICLE_NAME = re.compile(r"(?:^|[-_\s])(?:article|entry|post|story)(?:$|[-_\s])", re.I)
_PIECES = re.compile(r"[-_]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights reserved)", re.I)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_PARAGRAPH = frozenset("p pre blockquote td li dd figure".split()) | _HEADING
#: An element's start closes an open one of these (up to a container).
_CLOSES = {t: frozenset({"p"}) for t in "address article aside blockquote details div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul figure figcaption".split()} | {
    "li": frozenset({"li", "p"}), "dt": frozenset({"dt", "dd", "p"}), "dd": frozenset({"dt", "dd", "p"}), "tr": frozenset({"tr", "td", "th", "p"}),
    "td": frozenset({"td", "th", "p"}), "th": frozenset({"td", "th", "p"}), "option": frozenset({"option"}), "body": frozenset({"head"}),
}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
_SCOPES = frozenset({"html", "body", "article", "section", "main", "div", "td", "th", "table", "li", "aside", "header", "footer", "nav", "form", "blockquote", "button", "dd", "figure"})


class Node:
    __slots__ = ("tag", "parent", "children", "depth", "inside", "cut", "doubt", "favour", "points", "length", "linked", "inline", "commas")

    def __init__(self, tag: str, parent: Node | None, cut: bool = False, doubt: bool = False, favour: float = 0.0):
        self.tag, self.parent, self.cut, self.doubt, self.favour = tag, parent, cut, doubt, favour
        self.depth = parent.depth + 1 if parent is not None else 0
        self.inside = parent is not None and parent.inside  # of an article
        self.children: list[Node | str] = []
        self.points = 0.0
        self.length = self.linked = 0  # characters of the branch, and of them in links
        self.inline = self.commas = 0  # characters and commas of the node and what is inline below it


def _attributes(html: str, pos: int, closed: dict[str, int]) -> tuple[dict[str, str], int, bool]:
    """Attributes from ``pos`` on, the place behind the tag's end, and whether it closes itself.

    A quoted value ends with its quote, wherever that is; a quote that never closes counts as a letter. ``closed``
    has the last place of each quote, so that none is searched for in vain.
    """
    found: dict[str, str] = {}
    while (m := _ATTRIBUTE.match(html, pos)) and m.end() > pos:
        pos, value = m.end(), ""
        if _EQUALS.search(html, m.end(1), pos):
            quote = html[pos : pos + 1]
            if quote in closed and quote and closed[quote] > pos:
                end = html.index(quote, pos + 1)
                value, pos = html[pos + 1 : end], end + 1
            else:
                end = _BARE_VALUE.match(html, pos).end()
                value, pos = html[pos:end], end
        found.setdefault(m.group(1).lower(), value)
    end = html.find(">", pos)
    return found, (end + 1 if end >= 0 else len(html)), end > 0 and html[end - 1] == "/"


def says(name: str) -> bool:
    """Whether a class name says of a branch, and says nothing else, that it is no article text."""
    pieces = [x for x in _PIECES.split(name.lower()) if not x.isdigit()]
    return any(x in _SURE for x in pieces) and all(x in _SURE or x in _BOXES for x in pieces)


def _node(tag: str, found: dict[str, str], parent: Node) -> Node:
    cut, doubt, article, favour = tag in _CUT or parent.cut, False, tag in ("article", "main"), 5.0 if tag in ("article", "main") else 0.0
    if not cut and (tag == "header" or found):
        cut = tag == "header" and not parent.inside  # a heading of the article itself stays
        kept = tag in ("html", "body", "article", "main")
        classes = [*found.get("class", "").split(), found.get("id", "").strip()]
        if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in _CUT_ROLE or _HIDDEN.search(found.get("style", "")):
            cut = cut or not kept
        elif any(map(says, classes)) and (not kept or (tag == "article" and parent.inside)):
            cut = cut or (tag != "header" and tag not in _HEADING)
        elif not kept and _SOUNDS.search(" ".join(classes)):
            if parent.inside or tag in _PARAGRAPH:
                doubt = True  # decided by its links
            else:
                cut = True
        elif _KEEP_NAME.search(" ".join(classes)):
            favour += 3.0
            article = article or (tag not in ("html", "body") and bool(_ARTICLE_NAME.search(" ".join(classes))))
    node = Node(tag, parent, cut, doubt, favour)
    node.inside = node.inside or article
    return node


def parse(html: str) -> Node:
    root = at = Node("#root", None)
    pos, n, raw_end = 0, len(html), {}
    closed = {q: html.rfind(q) for q in "\"'"}
    open_: dict[str, int] = {}

    def leave(node: Node) -> None:
        """Closes everything up to ``node``, which stays open no longer."""
        nonlocal at
        while True:
            open_[at.tag] -= 1
            done, at = at is node, at.parent
            if done:
                return

    while pos < n:
        start = html.find("<", pos)
        if start < 0:
            at.children.append(html[pos:])
            break
        following = html[start + 1 : start + 2]
        ends = following == "/"
        m = _NAME.match(html, start + 1 + ends)
        if not m and not (ends or following in ("!", "?")):
            at.children.append(html[pos : start + 1])  # a sign like any other
            pos = start + 1
            continue
        if start > pos:
            at.children.append(html[pos:start])
        if not m:
            if html.startswith("<!--", start):
                if html.startswith((">", "->"), start + 4):
                    pos = html.index(">", start) + 1
                else:
                    end = _COMMENT_END.search(html, start + 4)
                    pos = end.end() if end else n
            else:
                end = html.find(">", start)
                pos = end + 1 if end >= 0 else n
            continue
        tag = m.group().lower()
        found, pos, itself = _attributes(html, m.end(), closed)
        if ends:
            if open_.get(tag):
                x = at
                for _ in range(CLIMB if tag in _INLINE else DEEPEST):
                    if x is root or x.tag == tag or (tag in _INLINE and x.tag not in _INLINE):
                        break
                    x = x.parent
                if x is not root and x.tag == tag:
                    leave(x)
            continue
        if (closes := _CLOSES.get(tag)) and any(open_.get(c) for c in closes):
            x, stop, last = at, _SCOPE.get(tag, _SCOPES - closes), None
            for _ in range(CLIMB):
                if x is root or x.tag in stop:
                    break
                if x.tag in closes:
                    last = x
                x = x.parent
            if last is not None:
                leave(last)
        parent = at
        if at.depth >= DEEPEST:  # no deeper: a sibling of the element it stands in
            parent = at.parent
        node = _node(tag, found, parent)
        parent.children.append(node)
        if tag in _RAW:
            if tag not in raw_end:
                raw_end[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)
            end = raw_end[tag].search(html, pos) if raw_end[tag] else None
            if end is None:
                raw_end[tag] = None
            pos = end.end() if end else n
        elif tag not in _VOID and not (itself and tag in ("svg", "math", "path", "mspace")):
            if at.depth >= DEEPEST:
                open_[at.tag] -= 1
            at = node
            open_[tag] = open_.get(tag, 0) + 1
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes that aren't cut, in page order."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [c for c in reversed(n.children) if isinstance(c, Node) and not c.cut]
    return out


def _measure(nodes: list[Node]) -> None:
    """Lengths, links and commas, from the leaves up; branches in doubt that are made of links are cut."""
    for n in reversed(nodes):
        for c in n.children:
            if isinstance(c, str):
                if c := c.strip():
                    n.inline += len(c)
                    n.length += len(c)
                    n.commas += c.count(",") + c.count("，") + c.count("、")
            elif not c.cut:
                n.linked += c.linked
                n.length += c.length
                if c.tag in _INLINE:
                    n.inline += c.inline
                    n.commas += c.commas
        if n.tag == "a":
            n.linked = n.length
        n.cut = n.doubt and density(n) >= LINKS


def density(n: Node) -> float:
    """Share of a branch's text in links."""
    return min(n.linked / n.length, 1.0) if n.length else 0.0


def worth(n: Node) -> float:
    """Points that a block passes on: for text of its own, its length and commas, less its links."""
    if n.tag in _INLINE or not n.inline or (n.tag not in _PARAGRAPH and n.inline < BARE):
        return 0.0
    return (1 + n.commas + min(n.inline / 100, 3)) * (1 - density(n))


def _score(nodes: list[Node]) -> None:
    """Passes each block's worth to its ancestors: whole, a half, then a third of each further one's share."""
    for n in nodes:
        points = worth(n)
        p, share = n.parent if n.tag in _PARAGRAPH else n, 1.0
        for k in range(1, GIVEN + 1):
            if p is None or not points:
                break
            p.points += points * share
            share = 0.5 if k == 1 else 0.5 / (1.5 * k)
            p = p.parent


def score(n: Node) -> float:
    return n.points * (1 - density(n)) + n.favour * bool(n.length)


def _blocks(top: Node) -> list[str]:
    """Blocks of a branch: text runs between block elements, white space folded."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            if text := " ".join(unescape("".join(run)).split()):
                out.append(text)
            run.clear()

    stack: list = [top]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            run.append(n)
        elif n is None:
            flush()
        elif not n.cut:
            if n.tag in _INLINE:
                if n.tag in ("br", "img"):
                    run.append(" ")
                stack += reversed(n.children)
            else:
                flush()
                stack.append(None)
                stack += reversed(n.children)
    flush()
    return out


def _part(n: Node) -> bool:
    """Whether a sibling of the article's branch is article text, too: not links, not a line of rights."""
    if n.cut or not n.length or density(n) >= LINKS:
        return False
    return not _RIGHTS.match("".join(_blocks(n)[:1]))


def _chosen(nodes: list[Node]) -> list[Node | str]:
    """The branches that hold the main text, in page order."""
    root = nodes[0]
    rated = [n for n in nodes if n.tag not in _INLINE and n.tag not in _PARAGRAPH and not n.cut]
    best = max(rated, key=score, default=root)
    if score(best) <= 0:
        return [root]
    top, n = None, best
    while n is not None:
        if n.tag == "article" or (n.tag == "main" and top is None):
            top = n
        n = n.parent
    if top is None:
        top = best
        while top.parent is not None and top.parent.tag not in ("#root", "html", "body") and all(_part(c) for c in top.parent.children if isinstance(c, Node) and c is not top and not c.cut and c.length):
            top = top.parent
    if top.parent is None:
        return [top]
    least = max(10.0, 0.2 * score(best))
    joined = top.tag in ("article", "main")

    def kept(c: Node | str) -> bool:
        if c is top:
            return True
        if isinstance(c, str) or not _part(c):
            return False
        if joined:  # beside an article only what carries as much, and headings
            return c.tag in ("h1", "h2") or score(c) >= least or (c.tag == "p" and c.length > 80)
        return True

    return [c for c in top.parent.children if kept(c)]


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    nodes = _walk(parse(html))
    _measure(nodes)
    _score([n for n in nodes if not n.cut])
    return "\n\n".join(block for n in _chosen(nodes) for block in _blocks(n))


def extract(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``id_col``, ``url_col``, ``text``, ``n_chars`` of every page, in one narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["key", "url", "text", "n_chars"]
            )

    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "key long, url string, text string, n_chars long").withColumnsRenamed({"key": id_col, "url": url_col})
