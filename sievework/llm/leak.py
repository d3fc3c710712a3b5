"""Evaluation texts leaking into training text, by winnowing.

Words (letters, digits and marks, lower case, markup taken out) are hashed, and
so is every run of GRAM of them. A document keeps the smallest run hash of each
window of WINDOW runs, so that any span of GRAM + WINDOW - 1 words that it
shares with an item leaves a common fingerprint. The fingerprints of the
documents are joined with all runs of the items; every joined pair is extended
word by word from its hits, a few changed, added or missing words being bridged
at a cost, and the words of the item so covered, in their order, are counted
against its length.

No run is left out for being common: what many items say alike (question frames)
weighs less, so that it can't pay for the differences beside it, and a piece
needs a least weight. Items of equal words are one class, looked up once, and a
pair is extended only where the document holds enough of the item's words at all,
in any order, which no leak can lack. A leading sentence that other items begin
with too does not count among an item's words.

The items are few beside the documents: a block of up to BLOCK_WORDS of their
words is broadcast, and each block is set against all documents in one pass,
without a shuffle of texts or fingerprints.

Defined results
* null or empty text, on either side: no words, no rows.
* null ids: such rows are left out. Repeated rows: each doc_id and item_id gives one row.
* items too short for the guarantee (under two spans of GRAM + WINDOW - 1 words): looked up with every run of the
  document; those of fewer than GRAM words with runs of their own length, so as a whole.
* items of equal words: a row each.
* very long texts: read whole; memory follows the longest text.
* an empty table: no rows. Further columns: ignored.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread

GRAM = 3
WINDOW = 3
#: Part of an item's words that makes a leak.
SHARE = 0.5
#: Costs of extension: a bridged difference, and how far a piece may fall below its best.
MISS, DROP = 2.5, 7.5
#: A word whose run stands in n item classes weighs FREE / n, at most 1 and at least LIGHT; a piece weighs HEAVY at least.
FREE, LIGHT, HEAVY = 2, 0.3, 2.0
#: Words of items that are broadcast at once, some 30 bytes each in a worker; more are set against the documents block by block.
BLOCK_WORDS = 2_000_000

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&[a-zA-Z]+;|&#[0-9]+;")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall(text.lower())


def word_hashes(tokens: list[str], memo: dict[str, int]) -> np.ndarray:
    if len(memo) > 500_000:
        memo.clear()
    out = []
    for t in tokens:
        h = memo.get(t)
        if h is None:
            h = memo[t] = xxhash.xxh64_intdigest(t)
        out.append(h)
    return np.array(out, np.uint64)


def gram_hashes(h: np.ndarray, k: int = GRAM) -> np.ndarray:
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for i in range(k):
        g = (g ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        g ^= g >> np.uint64(29)
    return g


def winnow(g: np.ndarray, w: int = WINDOW) -> np.ndarray:
    """Places of the minimum of every window, the right-most of equal ones; all of a text shorter than a window: its minimum."""
    if len(g) == 0:
        return np.empty(0, np.int64)
    if len(g) <= w:
        return np.array([len(g) - 1 - int(np.argmin(g[::-1]))])
    rows = np.lib.stride_tricks.sliding_window_view(g, w)
    return np.unique(np.arange(len(rows)) + (w - 1 - np.argmin(rows[:, ::-1], axis=1)))


def _walk(item: list[int], weight: list[float], doc: list[int], i: int, j: int, step: int, covered: list[int]) -> tuple[int, int]:
    """Extend from (i, j) in one direction; append the item places that match. The (i, j) after the best one."""
    score = best = 0.0
    kept, best_ij, n, m = len(covered), (i, j), len(item), len(doc)
    while 0 <= i < n and 0 <= j < m:
        if item[i] == doc[j]:
            covered.append(i)
            score += weight[i]
            i += step
            j += step
            if score >= best:
                best, kept, best_ij = score, len(covered), (i, j)
            continue
        score -= MISS
        if best - score > DROP:
            break
        for di, dj in ((1, 1), (0, 1), (1, 0), (2, 2), (1, 2), (2, 1), (0, 2), (2, 0), (3, 3)):
            a, b = i + di * step, j + dj * step
            if 0 <= a < n and 0 <= b < m and item[a] == doc[b]:
                a2, b2 = a + step, b + step
                if not (0 <= a2 < n and 0 <= b2 < m) or item[a2] == doc[b2]:
                    i, j = a, b
                    break
        else:
            i += step
            j += step
    del covered[kept:]
    return best_ij


def covered_words(item: list[int], doc: list[int], hits: list[tuple[int, int]], weight: list[float] | None = None) -> int:
    """Words of the item that stand in pieces grown from hits (item place, doc place), in one order over both texts."""
    weight = weight or [1.0] * len(item)
    least = min(HEAVY, sum(weight))
    pieces: list[tuple[int, int, int, int, list[int]]] = []
    open_: list[tuple[int, int, int, int]] = []
    for i, j in sorted(set(hits), key=lambda x: (x[1], x[0])):
        open_ = [x for x in open_ if x[3] > j]
        if any(a <= i < b and c <= j < d for a, b, c, d in open_):
            continue
        left: list[int] = []
        _, jl = _walk(item, weight, doc, i - 1, j - 1, -1, left)
        right: list[int] = []
        _, jr = _walk(item, weight, doc, i, j, 1, right)
        places = left[::-1] + right
        if places:
            open_.append((places[0], places[-1] + 1, jl + 1, jr))
            if sum(weight[x] for x in places) >= least - 1e-9:
                pieces.append((*open_[-1], places))
    # the best chain of pieces that keep their order in both texts; overlaps count once.
    # best[e]: most words of a chain whose last piece ends before item place e, over pieces that ended in the document.
    best = np.zeros(len(item) + 1, np.int64)
    top, ended = 0, []
    for a, b, c, d, places in sorted(pieces, key=lambda x: (x[2], x[0])):
        while ended and ended[0][0] <= c:
            _, e, n = heapq.heappop(ended)
            best[e] = max(best[e], n)
        fresh = len(places) - np.searchsorted(places, np.arange(b + 1))
        n = int((best[: b + 1] + fresh).max())
        top = max(top, n)
        heapq.heappush(ended, (d, b, n))
    return top


def item_words(items: DataFrame) -> DataFrame:
    """_item, _words (space between), _n: shared leading sentences counted over all items, by groups, not on the driver."""
    lead = F.regexp_extract("text", r"^\s*([^\n.!?]*[.!?])\s", 1)
    rows = items.select(F.col("item_id").cast("bigint").alias("_item"), "text").where("_item is not null and text is not null").dropDuplicates(["_item"])
    keyed = rows.withColumn("_lead", F.when(lead != "", F.lower(F.trim(lead))))
    shared = keyed.where("_lead is not null").groupBy("_lead").agg(F.count("*").alias("_c")).where("_c > 1").select("_lead", F.lit(True).alias("_shared"))
    cut = keyed.join(shared, "_lead", "left").withColumn("_body", F.when(F.col("_shared"), F.regexp_replace("text", r"^\s*[^\n.!?]*[.!?]\s", "")).otherwise(F.col("text")))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [words(t) for t in pdf["_body"]]
            yield pd.DataFrame({"_item": pdf["_item"], "_words": [" ".join(t) for t in tokens], "_n": [len(t) for t in tokens]})

    return cut.select("_item", "_body").mapInPandas(split, "_item bigint, _words string, _n int").where("_n > 0")


@dataclass
class Items:
    """A block of item classes: their words, and their runs sorted by hash."""

    classes: np.ndarray
    words: list[np.ndarray]
    weights: list[list[float]]
    prints: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    #: Whether a run is looked up with every run of the document, not with the winnowed ones.
    every: np.ndarray
    #: Run lengths below GRAM that are needed.
    short: list[int]

    @classmethod
    def of(cls, ids: list[int], texts: list[str], often: dict[int, int]) -> Items:
        """often: classes of the runs that several have."""
        memo: dict[str, int] = {}
        words_, weights, prints, owner, place, every, short = [], [], [], [], [], [], set()
        for k, text in enumerate(texts):
            h = word_hashes(text.split(" "), memo)
            words_.append(h)
            n = min(GRAM, len(h))
            if n < GRAM:
                short.add(n)
            g = gram_hashes(h, n)
            weight = np.ones(len(h))
            for x, v in enumerate(g.view(np.int64).tolist()):
                if v in often:
                    weight[x : x + n] = np.minimum(weight[x : x + n], max(LIGHT, min(1.0, FREE / often[v])))
            weights.append(weight.tolist())
            prints.append(g)
            owner.append(np.full(len(g), k, np.int32))
            place.append(np.arange(len(g), dtype=np.int32))
            every.append(np.full(len(g), len(h) < 2 * (GRAM + WINDOW - 1)))
        flat = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        at = (lambda x, kind: np.concatenate(x)[order] if x else np.empty(0, kind))
        return cls(np.array(ids, np.int64), words_, weights, flat[order], at(owner, np.int32), at(place, np.int32), at(every, bool), sorted(short))

    def hits(self, h: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Item number: (item place, document place) of the common runs."""
        out: dict[int, list[tuple[int, int]]] = {}
        g = gram_hashes(h)
        kept = np.zeros(len(g), bool)
        kept[winnow(g)] = True
        looked = [(g, kept)] if not self.every.any() else [(g, kept), *[(gram_hashes(h, k), np.zeros(max(0, len(h) - k + 1), bool)) for k in self.short]]
        for grams, winnowed in looked:
            asked = np.flatnonzero(winnowed) if grams is g and not self.every.any() else np.arange(len(grams))
            low = np.searchsorted(self.prints, grams[asked], "left")
            high = np.searchsorted(self.prints, grams[asked], "right")
            for x in np.flatnonzero(high > low):
                j = int(asked[x])
                for s in range(low[x], high[x]):
                    if winnowed[j] or self.every[s]:
                        out.setdefault(int(self.owner[s]), []).append((int(self.place[s]), j))
        return out


    def possible(self, h: np.ndarray, found: dict[int, list[tuple[int, int]]], least: float) -> list[tuple[int, list[tuple[int, int]]]]:
        """The items with that share of their words in the document, in whatever order: no more can be covered."""
        have = np.unique(h)
        flat = np.concatenate([self.words[k] for k in found])
        at = np.minimum(np.searchsorted(have, flat), len(have) - 1)
        sizes = np.array([len(self.words[k]) for k in found])
        common = np.add.reduceat(have[at] == flat, np.cumsum(sizes) - sizes)
        return [x for x, ok in zip(found.items(), common >= least * sizes) if ok]


def _scan(shared, least: float):
    """doc_id, _class, words_found, words_in_item for the pairs of which at least that share is found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: Items = shared.value
        memo: dict[str, int] = {}
        for pdf in batches:
            out = []
            for n, text in zip(pdf["_doc"], pdf["_text"]):
                h = word_hashes(words(text), memo)
                found = items.hits(h)
                if not found:
                    continue
                doc: list[int] = h.tolist()
                for k, hits in items.possible(h, found, least):
                    item = items.words[k]
                    covered = covered_words(item.tolist(), doc, hits, items.weights[k])
                    if covered and covered >= least * len(item):
                        out.append((n, items.classes[k], covered, len(item)))
            yield pd.DataFrame(out, columns=["doc_id", "_class", "words_found", "words_in_item"])

    return run


def _class_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[str, int] = {}
    for pdf in batches:
        for n, text in zip(pdf["_class"], pdf["_words"]):
            h = word_hashes(text.split(" "), memo)
            yield pd.DataFrame({"_class": np.int64(n), "_print": np.unique(gram_hashes(h, min(GRAM, len(h)))).view(np.int64)})


def leaks(documents: DataFrame, items: DataFrame, least: float = SHARE) -> DataFrame:
    """doc_id, item_id, words_found, words_in_item for every pair of which at least the share `least` of the item is found."""
    spark = documents.sparkSession
    classes = materialise(item_words(items).groupBy("_words").agg(F.min("_item").alias("_class"), F.first("_n").alias("_n"), F.collect_list("_item").alias("_members")), "leak-items")
    runs = classes.select("_class", "_words").mapInPandas(_class_runs, "_class bigint, _print bigint")
    often = runs.groupBy("_print").agg(F.count("*").alias("_c")).where(F.col("_c") > FREE)
    blocks = max(1, -(-(classes.agg(F.sum("_n")).first()[0] or 0) // BLOCK_WORDS))
    texts = spread(documents.select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("text").cast("string").alias("_text")).where("_doc is not null and length(_text) > 0"))
    found = None
    for k in range(blocks):
        mine = F.pmod(F.col("_class"), F.lit(blocks)) == k
        own = classes.where(mine).select("_class", "_words").toPandas()  # BLOCK_WORDS words, about
        common = runs.where(mine).join(often, "_print").select("_print", "_c").distinct().collect() if blocks > 1 else often.collect()
        shared = spark.sparkContext.broadcast(Items.of(own["_class"].tolist(), own["_words"].tolist(), dict(map(tuple, common))))
        part = texts.mapInPandas(_scan(shared, least), "doc_id bigint, _class bigint, words_found int, words_in_item int")
        found = part if found is None else found.unionByName(part)
    members = classes.select("_class", F.explode("_members").alias("item_id"))
    return found.join(members, "_class").groupBy("doc_id", "item_id").agg(F.max("words_found").alias("words_found"), F.max("words_in_item").alias("words_in_item"))


def leaked(pairs: DataFrame, share: float = SHARE) -> DataFrame:
    return pairs.where(F.col("words_found") >= share * F.col("words_in_item")).select("doc_id", "item_id")
