"""Main text of web pages by tree scoring.

Text blocks give points (one, one per comma, up to three for length) to their container and half as many to the next
ancestor. A container's points are discounted by its link density, and once more if it lies in an element whose class, id or role
says it is no article, or in a form. Around the best one the article is kept, with sibling articles that
score well too; without an article, the main element (or role=main), else the lowest ancestor of all good containers: those with a
fifth of the best one's points or blocks a third as long as its own. Of it all blocks are kept but those of link-heavy containers.

Menus, headers, footers, sidebars, dialogs, scripts and styles are left out by element. Notices, adverts, comments and the like are left
out by class, id or role only where a whole name says so (`sidebar`, `cookie-notice`, but not `has-sidebar` or `news-alert`), and, as
forms are, only where they do not hold the best container: an element of such a name around the article is no reason to drop it. A
page of nothing but a short notice or form has no text.

Null, empty or text-free html gives the empty string; unclosed and cut-off tags are read as browsers read them; repeated
rows and null ids give a row each.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*+(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
ROLE_MAIN = re.compile(r"\brole\s*=\s*[\"']?main\b", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements without content of the article.
DROPPED = frozenset("script style noscript template nav header footer aside button select option textarea input iframe svg canvas object embed video audio map head title menu dialog".split())
#: Their content is text up to their end tag.
RAW = frozenset("script style noscript template textarea title iframe svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img wbr br".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption caption summary".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of names (classes, ids, roles) of what is not the article, and words that say nothing beside them.
UNWANTED = re.compile(
    r"ads?|advert\w*|adsense|banners?|sponsor\w*|promos?|promoted|sidebar|comments?|commentlist|respond|disqus\w*|replies|cookies?\w*|consent|gdpr|notices?|alerts?|newsletter|subscribe|subscription|social|share|sharing"
    r"|related|recommend\w*|breadcrumbs?|menu|nav|navbar|navigation|footer|header|masthead|popup|modal|overlay|widgets?|pagination|pager|login|signup|toolbar|search|complementary|contentinfo"
)
NEUTRAL = frozenset("area bar block body bottom bottombar box btn button buttons col container content contents div el element fixed form group holder id inner item items js left link links list main module nav outer page panel primary right secondary section side site sticky text threads top topbar ui unit wrap wrapper zone".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W\d_a-zA-Z]+")


@lru_cache(maxsize=1 << 14)
def named_unwanted(names: str) -> frozenset[str]:
    """The unwanted words of those names that hold no word but unwanted and neutral ones."""
    out: set[str] = set()
    for name in names.split():
        found = [w.lower() for w in WORD.findall(name)]
        if name.lower() in ("side-bar", "side_bar", "sidebar"):
            found = ["sidebar"]
        bad = {w for w in found if UNWANTED.fullmatch(w)}
        if bad and all(w in bad or w in NEUTRAL or w.isdigit() for w in found):
            out |= bad
    return frozenset(out)


class Node:
    __slots__ = ("blocks", "chars", "dropped", "links", "main", "marked", "own", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, marked: bool = False):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        #: The nearest element, this one or around it, that is left out unless it holds the best container.
        self.marked: Node | None = self if marked else parent.marked if parent else None
        self.main = tag == "main"
        self.points = self.own = 0.0
        self.size = self.links = self.blocks = self.chars = 0


def blocks_of(page: str) -> list[tuple[Node, str, int]]:
    """(element, text, characters in links) of the page's kept text blocks, in page order."""
    root = node = Node("#root", None, False)
    out: list[tuple[Node, str, int]] = []
    buffer: list[str] = []
    in_link, link_size, at = 0, 0, 0

    def end_block() -> None:
        nonlocal link_size
        if buffer:
            text = "".join(buffer)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                out.append((node, text, min(link_size, len(text))))
            buffer.clear()
        link_size = 0

    while True:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not node.dropped:
            buffer.append(text)
            if in_link:
                link_size += len(text)
        if not m:
            break
        at = m.end()
        closing, opening = m[1], m[2]
        if opening:
            tag = opening.lower()
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
                if tag not in ("svg", "noscript", "template"):
                    end_block()
            elif tag in INLINE:
                if tag == "a":
                    in_link = 1
                elif tag == "br":
                    buffer.append(" ")
            elif tag not in VOID:
                end_block()
                while node.tag in CLOSED_BY_BLOCK or node.tag in SIBLINGS.get(tag, ()):
                    node = node.parent
                names = " ".join("".join(x) for x in NAMES.findall(m[3]))
                said = named_unwanted(names) if names and tag not in ("html", "body", "article", "main") else frozenset()
                if "header" in said and within(node, "article"):
                    said -= {"header"}  # an article's own header
                unwanted = tag in DROPPED and not (tag == "header" and within(node, "article"))
                node = Node(tag, node, node.dropped or unwanted, bool(said) or tag == "form")
                if ROLE_MAIN.search(m[3]):
                    node.main = True
            else:
                end_block()
        elif closing:
            tag = closing.lower()
            if tag == "a":
                in_link = 0
            elif tag not in INLINE:
                end_block()
                if within(node, tag):
                    while node.tag != tag:
                        node = node.parent
                    node = node.parent
    end_block()
    assert root is not None
    return out


def within(node: Node | None, tag: str) -> Node | None:
    """The nearest element of this tag, node itself or around it."""
    while node is not None and node.tag != tag:
        node = node.parent
    return node


def main_text(page: str | None) -> str:
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    scored: dict[int, Node] = {}
    for node, text, links in blocks:
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        container = node.parent if node.tag in PARAGRAPHS and node.parent else node
        container.own += points
        if node.tag not in HEADINGS:
            container.blocks += 1
            container.chars += len(text) - links
        for share in (1, 2):
            if container is None:
                break
            container.points += points / share
            scored[id(container)] = container
            container = container.parent
        up: Node | None = node
        while up is not None:
            up.size += len(text)
            up.links += links
            up = up.parent
    value = lambda n: n.points * (1 - n.links / max(n.size, 1)) * (DISCOUNT if n.marked else 1)
    best = next((n for n in sorted(scored.values(), key=value, reverse=True) if not n.marked or is_text(n, blocks)), None)  # the first of equals
    if best is None:
        return ""
    around_best = {id(n) for n in upwards(best)}
    blocks = [b for b in blocks if all(id(n) in around_best for n in marks(b[0]))]
    article = within(best, "article")
    if article:
        kept = {id(article)} | {id(n) for n in scored.values() if n.tag == "article" and n.parent is article.parent and value(n) >= value(best) / 5}
        return " ".join(t for node, t, _ in blocks if any(id(n) in kept for n in upwards(node)))
    present = {id(n) for b in blocks for n in upwards(b[0])}
    return around(best, {k: n for k, n in scored.items() if k in present}, blocks, value)


#: What is left of a container's points inside a form or an element of an unwanted name.
DISCOUNT = 0.25


def marks(node: Node | None) -> Iterator[Node]:
    """The marked elements around a node, inmost first."""
    node = node.marked if node else None
    while node is not None:
        yield node
        node = node.parent.marked if node.parent else None


def is_text(best: Node, blocks: list[tuple[Node, str, int]]) -> bool:
    """Whether a container inside a form or an unwanted name is a page's text after all: an article or main element is around it, or it
    holds two blocks or more of 60 characters, of 200 together."""
    if any(n.tag == "article" or n.main for n in upwards(best)):
        return True
    own = [text for node, text, links in blocks if len(text) - links >= 60 and any(n is best for n in upwards(node))]
    return len(own) >= 2 and sum(map(len, own)) >= 200


def upwards(node: Node | None) -> Iterator[Node]:
    """The element and those around it."""
    while node is not None:
        yield node
        node = node.parent


def around(best: Node, scored: dict[int, Node], blocks: list[tuple[Node, str, int]], value: Callable[[Node], float]) -> str:
    """Text of a page without an article around its best container."""
    light = lambda n: n.links * 2 < n.size
    in_main = [n for n in scored.values() if value(n) * 5 >= value(best) and any(x.main for x in upwards(n))]
    if in_main:
        best = max(in_main, key=value)
        top = next(n for n in upwards(best) if n.main)
    else:
        path = list(upwards(best))
        place = {id(n): i for i, n in enumerate(path)}
        lengths = [len(t) - links for node, t, links in blocks if node.tag not in HEADINGS and any(n is best for n in upwards(node))]
        usual = sum(lengths) / max(len(lengths), 1)
        good = [n for n in scored.values() if light(n) and n.blocks and (n.own * (1 - n.links / max(n.size, 1)) * 5 >= value(best) or 3 * n.chars >= usual * n.blocks)]
        top = path[max((next(place[id(x)] for x in upwards(n) if id(x) in place) for n in good), default=0)]
    out, begun = [], False
    for node, text, links in blocks:
        container = node.parent if node.tag in PARAGRAPHS and node.parent else node
        if any(n is top for n in upwards(node)):
            begun = True
            keep = light(container) or any(n is best for n in upwards(node))
        else:
            beside = top.parent is not None and node.parent is top.parent
            keep = beside and (node.tag == "h1" or node.tag in HEADINGS and not begun or node.tag == "p" and len(text) > 80 and links * 4 < len(text))
        if keep:
            out.append(text)
    return " ".join(out)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
