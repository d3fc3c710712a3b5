"""Keep only the main body of a page, by tree scoring.

Every block of text passes points for length and commas to its container and,
weakened, to the containers above, discounted by link density; the headline adds
points of its own. The best container is kept together with siblings that score
alike. Within it, furniture goes: notices with buttons, by-lines, share lines,
lists of bare links with their headings, reader comments, and anything whose
class, id or tag says navigation, sidebar or footer.

Works on any block tree of pages.parse; no class names are needed, they only help.
"""

from __future__ import annotations

import re
from itertools import pairwise

from .pages import Block, Page

CHARS_PER_POINT = 25
COMMA = re.compile("[,،、，؛;；]")
HEADLINE_POINTS = 40.0
SIBLING_SHARE = 0.35
LINK_DENSITY = 0.5
_CHROME_TAGS = frozenset(("nav", "header", "footer", "aside"))
_CHROME = re.compile(
    r"(?:^|[ _-])(?:nav|topnav|navbar|menu|sidebar|side|rail|widget|breadcrumbs?|crumbs?|footer|foot|ft|colophon|cookie|cookies|consent|cc|notice|banner|comments?|respond|share|sharing|social|related|promo|newsletter|copyright|hdr|mn|col2|advert|ads?)(?:$|[ _-])"
)
_WORD = re.compile(r"\w")
_ARROW = re.compile("[>›»→]")
_SENTENCE_END = re.compile("[.!?。！？؟…]")
_DATE = re.compile(r"\b\d{1,4}[./-]\d{1,2}[./-]\d{1,4}\b")
_CONTAINERS = ("div", "section", "article", "main", "td", "body")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _link_density(b: Block) -> float:
    return min(1.0, b.link_chars / max(1, len(b.text)))


def bare_links(b: Block) -> bool:
    """Only links, with nothing but signs beside them and no sentence in them."""
    return b.links > 0 and not _WORD.search(b.outside) and not _SENTENCE_END.search(b.text[-2:])


def breadcrumb(b: Block) -> bool:
    """A few bare links with an arrow between them."""
    return 0 < b.links <= 8 and bool(_ARROW.search(b.outside)) and not _WORD.search(b.outside.rstrip().rpartition(">")[2] if b.links == 1 else b.outside)


def share_line(b: Block) -> bool:
    """A short label that ends in a colon, then only links."""
    if not b.links or len(b.outside) > 80:
        return False
    said = b.outside.strip().rstrip(" |,·/-")
    return said.endswith((":", "：")) and b.text.startswith(said[:-1].strip())


def by_line(b: Block) -> bool:
    """A short line in small print: a name, a date."""
    return b.small and len(b.text) < 80 and (bool(_DATE.search(b.text)) or not _SENTENCE_END.search(b.text))


def score(page: Page) -> None:
    """Fill in Node.score."""
    nodes = page.nodes
    for b in page.blocks:
        tag = nodes[b.node].tag
        if tag in _HEADINGS:
            points = HEADLINE_POINTS if tag == "h1" else 1.0
        elif b.button:
            points = 0.0
        else:
            points = (1 + len(b.text) / CHARS_PER_POINT + len(COMMA.findall(b.text))) * (1 - _link_density(b))
        level = 1.0
        # an element that holds nothing but this text is a paragraph, not a container
        up = nodes[b.node].parent if nodes[b.node].leaf or tag not in _CONTAINERS else b.node
        while up >= 0 and level > 0.05:
            nodes[up].score += points * level
            if nodes[up].tag not in ("ul", "ol", "table", "tr", "li", "blockquote"):
                level *= 0.5
            up = nodes[up].parent
    for n in nodes:
        if n.tag in _CHROME_TAGS:
            n.score *= 0.1


def best_container(page: Page) -> int:
    usable = [i for i, n in enumerate(page.nodes) if n.tag in _CONTAINERS and (not n.leaf or i == 0)]
    return max(usable, key=lambda i: (page.nodes[i].score, -i)) if usable else 0


def chrome_nodes(page: Page, best: int) -> list[bool]:
    """Whether a node is, or lies in, site furniture; the best container and what holds it are not."""
    above = set(page.ancestors(best))
    out = []
    for i, n in enumerate(page.nodes):
        inherited = n.parent >= 0 and out[n.parent]
        own = i not in above and (n.tag in _CHROME_TAGS or bool(n.names and _CHROME.search(n.names)))
        out.append(inherited or own)
    return out


def region(page: Page) -> list[Block]:
    """Blocks of the best container and its siblings, site furniture by its place or name left out, in page order."""
    if page.kept is None:
        page.kept = _region(page) if page.blocks else []
    return page.kept


def _region(page: Page) -> list[Block]:
    nodes = page.nodes
    score(page)
    best = best_container(page)
    chrome = chrome_nodes(page, best)
    keep = {best}
    parent = nodes[best].parent
    if parent >= 0:
        headed = _headlines(page)
        for i, n in enumerate(nodes):
            if n.parent == parent and i != best and not chrome[i] and n.score >= SIBLING_SHARE * nodes[best].score and n.tag == nodes[best].tag and i in headed:
                keep.add(i)
    inside = [False] * len(nodes)
    for i, n in enumerate(nodes):
        inside[i] = i in keep or (n.parent >= 0 and inside[n.parent])
    return [b for b in page.blocks if inside[b.node] and not chrome[b.node] and not (b.button or by_line(b) or share_line(b) or breadcrumb(b))]


def main_blocks(page: Page) -> list[Block]:
    """Blocks of the main body, in page order."""
    return drop_lists(page, region(page))


def _headlines(page: Page) -> set[int]:
    """The nodes above a block of an h1."""
    out: set[int] = set()
    for b in page.blocks:
        if page.nodes[b.node].tag == "h1":
            for i in page.ancestors(b.node):
                if i in out:
                    break
                out.add(i)
    return out


def drop_lists(page: Page, blocks: list[Block]) -> list[Block]:
    """Lists whose every entry is a bare link go, and with them the headings that stand right before."""
    nodes = page.nodes
    lists: dict[int, list[Block]] = {}
    for b in blocks:
        if nodes[b.node].tag == "li" and nodes[b.node].parent >= 0:
            lists.setdefault(nodes[b.node].parent, []).append(b)
    gone = {b.order for own in lists.values() if all(bare_links(b) for b in own) for b in own}
    if gone:
        for b, after in pairwise(blocks):
            if nodes[b.node].tag in ("h2", "h3", "h4", "h5", "h6") and after.order in gone:
                gone.add(b.order)
    return [b for b in blocks if b.order not in gone]
