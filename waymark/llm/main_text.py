"""Main text of HTML pages by composite text density.

Page furniture goes first: elements and class names that say what they are. For
every remaining DOM node: its characters per tag, adjusted by how much of the text and
how many of the tags are links. A node's density sum adds its block children's
densities; the node with the largest sum is the core of the content and stays whole. The
lowest density on the path from it to the body is the threshold for what hangs off
that path: blocks as dense stay, lists of links go.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKUP = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORDS = re.compile(r"[a-z0-9]+")

#: Names of HTML elements and of usual page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe noframes noembed xmp textarea title template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "head script style noscript template nav aside header form footer iframe noframes noembed xmp svg math canvas audio video object embed "
    "button select option datalist textarea input dialog menu map".split()
)
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notices alert "
    "popup modal overlay newsletter subscribe subscription signup signin login sidebar widget widgets menu nav navbar navigation breadcrumb "
    "breadcrumbs header footer masthead topbar toolbar recommended recommendations pager pagination copyright disclaimer".split()
)
#: Words that mark furniture only where no word for content stands beside them.
WEAK = frozenset("promotion banner notice side related share sharing social search legal skip".split())
CONTENT = frozenset("article content main post entry story body text".split())
LAYOUT = frozenset("has with no without wrap wrapper container layout grid row page site".split())
COMMENTS = ("comment", "disqus", "respond", "reply", "replies")
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_SCOPE = frozenset("html body article section main div table td th ul ol dl li blockquote aside nav header footer form fieldset figure details".split())


class _Node:
    __slots__ = ("chars", "density", "dropped", "link_chars", "link_tags", "marked", "parent", "parts", "tag", "tags", "total")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool = False, marked: bool = False):
        self.tag, self.parent, self.dropped, self.marked = tag, parent, dropped, marked
        self.parts: list[_Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_dropped(tag: str, attributes: dict[str, str]) -> bool:
    """Elements that are never content, hidden ones, and reader comments whatever else their names say."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    words = _WORDS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
    return any(w.startswith(COMMENTS) for w in words)


def _is_furniture(tag: str, attributes: dict[str, str]) -> bool:
    """Class names and ids, each by itself, that name a part of the page's frame."""
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = set(_WORDS.findall(name))
        if not words & LAYOUT and (words & FURNITURE or words & WEAK and not words & CONTENT):
            return True
    return False


def parse(page: str) -> _Node:
    """A tree of elements and texts; scripts, comments and declarations are left out."""
    root = _Node("html", None)
    here, at, end = root, 0, len(page)
    opened: Counter = Counter()

    def up_to(node: _Node) -> _Node:
        """Close everything below ``node``."""
        inner = here
        while inner is not node:
            opened[inner.tag] -= 1
            inner = inner.parent
        return node

    while at < end:
        match = _MARKUP.search(page, at)
        if match is None:
            here.parts.append(entities.unescape(page[at:]))
            break
        if match.start() > at:
            here.parts.append(entities.unescape(page[at : match.start()]))
        at = match.end()
        if match[1] or match[4]:
            close = page.find("-->" if match[1] else ">", at)
            at = end if close < 0 else close + (3 if match[1] else 1)
            continue
        tag, attributes, closed = match[3].lower(), {}, False
        while at < end and page[at] != ">":
            found = _ATTRIBUTE.match(page, at)
            if found is None or found.end() == at:
                closed = page[at] == "/"
                at += 1
                continue
            attributes.setdefault(found[1].lower(), found[2] or found[3] or found[4] or "")
            at, closed = found.end(), False
        at += 1
        if match[2]:
            # what follows the end of the body belongs to it
            node = here if opened[tag] > 0 and tag not in ("html", "body") else None
            while node is not None and node.tag != tag:
                node = None if tag in INLINE and node.tag in _SCOPE else node.parent
            if node is not None and node.parent is not None:
                here = up_to(node.parent)
            continue
        if tag in ("html", "body") and here.parent is None and tag == "html":
            continue
        if closed and tag in ("svg", "math"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if tag not in INLINE and tag != "br":
            here = up_to(_after_paragraph(here))
        if tag in _CLOSES:
            ends, stops = _CLOSES[tag]
            node, closing = here, None
            while node.parent is not None and node.tag not in stops and any(opened[t] > 0 for t in ends):
                if node.tag in ends:
                    closing = node.parent
                    if tag != "tr":
                        break
                node = node.parent
            if closing is not None:
                here = up_to(closing)
        dropped = _is_dropped(tag, attributes)
        node = _Node(tag, here, dropped, not dropped and _is_furniture(tag, attributes))
        here.parts.append(node)
        if tag not in VOID:
            here = node
            opened[tag] += 1
    return root


def _after_paragraph(here: _Node) -> _Node:
    node = here
    while node.parent is not None and node.tag not in _SCOPE:
        if node.tag == "p" or re.fullmatch("h[1-6]", node.tag):
            return node.parent
        node = node.parent
    return here


def _kept(top: _Node) -> list[_Node]:
    """Every node that isn't dropped, children before parents."""
    order, stack = [], [top]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in node.parts if isinstance(p, _Node) and not p.dropped]
    order.reverse()
    return order


def _measure(top: _Node) -> list[_Node]:
    """Counts of every kept node, children before parents."""
    order = _kept(top)
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for part in node.parts:
            if isinstance(part, str):
                node.chars += len("".join(part.split()))
            elif not part.dropped:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags + (part.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    return order


def _drop_marked(top: _Node) -> None:
    """Drop what class names mark as furniture, unless it is a wrapper: more than half of the page's text, with an article or its title."""
    order = _measure(top)
    titled = set()
    for node in order:
        if node.tag in ("article", "main", "h1") or node in titled:
            titled |= {node, node.parent}
        if node.marked and not (node in titled and 2 * (node.chars - node.link_chars) > top.chars - top.link_chars):
            node.dropped = True


def densities(body: _Node) -> list[_Node]:
    """Kept nodes below ``body``, children before parents, with densities and density sums."""
    order = _measure(body)
    ratio = body.link_chars / max(1, body.chars)
    for node in order:
        if not node.chars:
            continue
        tags, plain = max(1, node.tags), max(1, node.chars - node.link_chars)
        links, link_tags = max(1, node.link_chars), max(1, node.link_tags)
        base = math.log(node.chars / plain * node.link_chars + ratio * node.chars + math.e)
        node.density = node.chars / tags * math.log(max(1.0, node.chars / links * tags / link_tags)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else 0.0
        if not node.density and node.chars > node.link_chars:
            node.density = (node.chars - node.link_chars) / tags
    for node in order:
        node.total = sum(p.density for p in node.parts if isinstance(p, _Node) and not p.dropped and p.tag not in INLINE)
    return order


def _render(node: _Node, blocks: list[str], open_text: list[str]) -> None:
    """Blocks of a subtree in page order; an explicit stack, for trees of any depth."""

    def flush() -> None:
        text = " ".join("".join(open_text).split())
        if text:
            blocks.append(text)
        open_text.clear()

    stack: list[tuple[_Node, int]] = [(node, 0)]
    flush()
    while stack:
        here, i = stack.pop()
        if i == len(here.parts):
            if here.tag not in INLINE:
                flush()
            continue
        stack.append((here, i + 1))
        part = here.parts[i]
        if isinstance(part, str):
            open_text.append(part)
        elif part.tag == "br":
            open_text.append(" ")
        elif not part.dropped:
            if part.tag not in INLINE:
                flush()
            stack.append((part, 0))


def main_text(page: str | None) -> str:
    """The page's main text: its blocks, white space collapsed, joined by one space.

    Null, empty and text-free pages give ''. A page without markup is its own text.
    """
    if not page:
        return ""
    root = parse(page)
    body = next((p for p in root.parts if isinstance(p, _Node) and p.tag == "body"), root)
    _drop_marked(body)
    order = densities(body)
    core = max((n for n in order if n.chars), key=lambda n: (n.total, n.chars), default=body)
    while core.tag in INLINE and core.parent is not None and core is not body:
        core = core.parent
    path = [core]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    blocks: list[str] = []
    open_text: list[str] = []
    _render(_selected(path, threshold), blocks, open_text)
    if rest := " ".join("".join(open_text).split()):
        blocks.append(rest)
    return " ".join(blocks)


def _selected(path: list[_Node], threshold: float) -> _Node:
    """A tree of what stays: the core (``path[0]``), and on its path up to the body what belongs to it."""
    below = path[0]
    last = max((i for i, n in enumerate(path) if n.tag in ("article", "main")), default=0)
    for i, node in enumerate(path[1:], 1):
        inside = i <= last
        copy = _Node(node.tag, None)
        for part in node.parts:
            if part is path[i - 1]:
                copy.parts.append(below)
            elif isinstance(part, str):
                if inside or len("".join(part.split())) >= threshold:
                    copy.parts.append(part)
            elif not part.dropped and _belongs(part, inside, threshold):
                copy.parts.append(part)
        below = copy
    return below


def _belongs(node: _Node, inside: bool, threshold: float) -> bool:
    """Whether a block beside the path is content: no list of links; and inside an article element, one itself, or dense enough."""
    if 2 * node.link_chars > node.chars:
        return False
    return inside or node.tag in ("article", "main", "br") or node.density >= threshold


def extract_main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``html_col``, with the main text in ``out`` and its code points in ``n_chars``.

    Every row is kept, repeated ones and null ids too; null html counts as empty. An existing
    column named ``out`` or ``n_chars`` is replaced, other columns stay. A page is parsed
    whole, in time linear in its length and depth, with a tree of some hundred bytes per element. Of equal
    density sums the node with more text is the core. An empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def texts(column):
        return column.map(main_text)

    kept = [c for c in pages.columns if c not in (html_col, out, "n_chars")]
    return (
        pages.select(*kept, texts(F.coalesce(F.col(html_col), F.lit(""))).alias(out))
        .withColumn("n_chars", F.char_length(out).cast("long"))
    )
