"""Keyword-stuffed and link-list pages, by block-wise compression.

The main region of a page is cut into blocks: stretches that hold no sentences
(the short ones together), and the text that looks like sentences. Each is
compressed, and its ratio is divided by the ratio that ordinary text of that
length and language has: 1 is ordinary. A block far below it is redundant; it
is confirmed by its low density of sentence punctuation. Keywords with full stops
strewn in have no low density, but no prose comes near them: EXTREME redundancy
needs no confirmation. A page is spam when more than half of the words of its
main region are in such blocks.

What is ordinary: ORDINARY by length, times a factor by language, the median over
all labelled texts of the table, as the language filters are fitted on all. The
language of a page is looked up for the report of its ratios, and for the verdict
only where some language could make more than half of its words redundant.

Defined results
* null or empty body, or a body that is no html: no row. A page without words: share 0.
* null headers: decoded by the page's own declaration. Very long pages: read whole.
* a block under LEAST words: compression tells nothing; it counts among the words of the page.
* no labelled texts to fit on: every language is taken as ordinary.
* repeated rows give a row each; an empty table none. Further columns: ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import langid
from .mainbody import bare_links, region
from .pages import Block, Page

SHARE = 0.5
#: (bytes, zlib ratio of ordinary text of that length), the median of the languages; between and beyond them by the logarithms of both.
ORDINARY = (
    (71, 0.93), (101, 0.81), (144, 0.77), (204, 0.70), (290, 0.64), (411, 0.59), (584, 0.54), (828, 0.49), (1175, 0.44), (1668, 0.39), (2367, 0.345), (3359, 0.31), (4766, 0.285), (6764, 0.26), (9598, 0.225),
)
#: A block below LIMIT times the ordinary ratio is redundant: lists of names, numbers or headings cost more than prose does. Below EXTREME times it no punctuation speaks for it.
LIMIT, EXTREME = 1.0, 0.66
#: Words that a block has at least for compression to tell anything.
LEAST = 12
#: Bytes of zlib's own.
FRAME = 8
#: Decimals of the ratios whose median is a language's factor.
DIGITS = 6
#: Sentence ends per word that still count as none.
PUNCTUATION = 1 / 40
#: A stretch of this many words without a sentence end is no sentence.
LONG = 45

_END = re.compile(r"[.!?؟…](?=[\s”»“\"」』)’]|$)|[。！？]")
_SPLIT = re.compile(r"(?<=[.!?؟…])[”»“\"」』)’]*\s+|(?<=[。！？])[”»“\"」』)’]*\s*")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿]")


def count_words(text: str) -> float:
    """Words; in scripts without spaces two characters count as one."""
    if text.isascii():
        return len(text.split())
    wide = len(_UNSPACED.findall(text))
    return wide / 2 + (len(_UNSPACED.sub(" ", text).split()) if wide else len(text.split()))


def own_region(page: Page) -> list[Block]:
    """The main region without lists of related links: bare links under a heading of their own, other than the headline."""
    nodes = page.nodes
    out: list[Block] = []
    dropping = -1
    blocks = region(page)
    for k, b in enumerate(blocks):
        tag = nodes[b.node].tag
        if tag in ("h2", "h3", "h4", "h5", "h6") and k + 1 < len(blocks):
            after = blocks[k + 1]
            if nodes[after.node].tag == "li":
                own = [x for x in blocks[k + 1 :] if nodes[x.node].tag == "li" and nodes[x.node].parent == nodes[after.node].parent]
                if all(bare_links(x) for x in own):
                    dropping = nodes[after.node].parent
                    continue
        if tag == "li" and nodes[b.node].parent == dropping:
            continue
        out.append(b)
    return out


def stretches(texts: list[str]) -> tuple[list[str], list[str]]:
    """Maximal runs of text without sentences, and the sentences."""
    runs: list[list[str]] = [[]]
    said: list[str] = []
    for text in texts:
        for piece in _SPLIT.split(text):
            if not piece:
                continue
            if _END.search(piece[-3:]) and count_words(piece) < LONG:
                said.append(piece)
                if runs[-1]:
                    runs.append([])
            else:
                runs[-1].append(piece)
    return ["\n".join(r) for r in runs if r], said


_AT, _RATIO = np.log([n for n, _ in ORDINARY]), np.log([r for _, r in ORDINARY])
_SLOPE = float((_RATIO[-1] - _RATIO[-2]) / (_AT[-1] - _AT[-2]))


def ordinary(size: int) -> float:
    x = np.log(max(1, size))
    return min(1.0, float(np.exp(np.interp(x, _AT, _RATIO) + max(0.0, x - _AT[-1]) * _SLOPE)))


def redundancy(text: str, factor: float = 1.0) -> float:
    """Compression ratio by the ratio of ordinary text of this length, and of the language whose factor is given: 1 is ordinary, low is redundant."""
    data = text.encode("utf-8", "replace")
    if not data:
        return 1.0
    return max(0, len(zlib.compress(data, 6)) - FRAME) / len(data) / ordinary(len(data)) / factor


@dataclass
class Model:
    """Language filters and, by language, the ratio of its ordinary text to ORDINARY."""

    filters: langid.Filters
    factors: dict[str, float]

    @property
    def highest(self) -> float:
        return max(self.factors.values(), default=1.0)

    def language(self, text: str) -> str | None:
        if not self.filters.languages:
            return None
        counts, n = self.filters.counts([text.replace("\n", " ")])
        best = int(counts[0].argmax())
        return self.filters.languages[best] if counts[0, best] > 0 else None

    def factor(self, text: str) -> float:
        return self.factors.get(self.language(text) or "", 1.0)


NO_MODEL = Model(langid.fit([]), {})


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (label, text). A language's factor is the median over its texts, so wrong labels don't tell."""
    filters = langid.fit(rows)
    by: dict[str, list[float]] = {}
    for label, text in rows:
        x = langid.primary(label)
        if x in filters.languages and text:
            by.setdefault(x, []).append(round(redundancy(text), DIGITS))
    return Model(filters, {x: float(np.median(own)) for x, own in by.items()})


def fit_on(documents: DataFrame, label_col: str = "lang", text_col: str = "text") -> Model:
    """The same from all rows of a table."""
    rows, sizes = langid.labelled(documents, label_col, text_col)
    if not sizes:
        return fit([])
    filters = langid.fit_labelled(rows, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([round(redundancy(x), DIGITS) for x in b.column(1).to_pylist()], pa.float64())], ["_place", "_ratio"])

    # a median of all: of as many different ratios as DIGITS leaves, each with its number of texts
    ratios = spread(rows).mapInArrow(run, "_place int, _ratio double").groupBy("_place", "_ratio").agg(F.count("*").alias("_n"))
    medians = {r[0]: r[1] for r in ratios.groupBy("_place").agg(F.percentile("_ratio", 0.5, F.col("_n"))).collect()}
    return Model(filters, {x: medians[i] for i, x in enumerate(sorted(sizes)) if x in filters.languages})


@dataclass(slots=True)
class Judged:
    """A block of the main region: what it is, its words, redundancy and sentence ends a word, and whether it is spam."""

    kind: str
    words: float
    redundancy: float
    density: float
    spam: bool


def judge(texts: list[str], model: Model = NO_MODEL, verdict_only: bool = False) -> list[Judged]:
    """verdict_only: the language is not looked up where no language could bring the redundant words over the half; ratios are then by length alone."""
    runs, said = stretches(texts)
    small = [r for r in runs if count_words(r) < LEAST]
    once = "\n".join(dict.fromkeys(said))  # a sentence said again and again is no keyword
    blocks = [("stretch", r, r) for r in runs if count_words(r) >= LEAST]
    blocks += [("short", x, x) for x in ["\n".join(small)] if small] + [("sentences", "\n".join(said), once)] * bool(said)
    found = []
    for kind, text, own in blocks:
        density = len(_END.findall(own)) / max(1.0, count_words(own))
        limit = LIMIT if kind != "sentences" and density <= PUNCTUATION else EXTREME
        found.append((kind, count_words(text), redundancy(own), density, limit))
    possible = sum(n for _, n, r, _, limit in found if n >= LEAST and r < limit * model.highest)
    asked = not verdict_only or possible > SHARE * sum(n for _, n, *_ in found)
    factor = model.factor("\n".join(texts)) if asked else 1.0
    return [Judged(kind, n, r / factor, density, n >= LEAST and r / factor < limit) for kind, n, r, density, limit in found]


def is_spam(page: Page, model: Model = NO_MODEL) -> bool:
    """Whether more than half of the words of the main region are in redundant blocks."""
    blocks = judge([b.text for b in own_region(page)], model, verdict_only=True)
    return sum(b.words for b in blocks if b.spam) > SHARE * sum(b.words for b in blocks)


def spam_share(texts: list[str], model: Model = NO_MODEL) -> tuple[float, float]:
    """(share of words in redundant blocks, lowest normalised ratio)."""
    blocks = judge(texts, model)
    words = sum(b.words for b in blocks)
    return (sum(b.words for b in blocks if b.spam) / words if words else 0.0), min((b.redundancy for b in blocks if b.words >= LEAST), default=1.0)


def page_spam(page: Page, model: Model = NO_MODEL) -> tuple[float, float]:
    return spam_share([b.text for b in own_region(page)], model)
