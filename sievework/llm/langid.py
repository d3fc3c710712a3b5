"""Missing or wrong language labels: language and confidence of texts and of their mixed-language segments.

Language-bitmask n-gram filters: a bit-sliced Bloom filter holds, for every
n-gram, the set of languages that use it, one bit each; two hashed places are
and-ed. The popcounts of a sentence per language, corrected for each slice's
rate of false positives, decide its language. A sentence with little evidence
(numbers, code, names) or with a small lead keeps the language around it.

The finished runs of sentences are judged once more by their own evidence: a run
whose confidence, less the error that so few n-grams leave, lies under FLOOR is
no segment; it joins the stronger of its neighbours.

The filters are fitted on all labelled rows, each read whole: by label and n-gram
the documents that have it are counted, in tasks that hold HELD counts at most,
then over all tasks. Only the n-grams that a label uses (USED) come to the driver, so
what it holds follows the length of a text, not the number of rows. Wrong labels
are outvoted, as an n-gram counts for a language only where it is about as
frequent as anywhere.

Defined results
* null or empty text: no segments. Texts without letters, or without n-grams of any language: no segments.
* a text all of whose runs are weak: one segment in the language with the most evidence, whatever its confidence; callers may ask for more.
* rows with a null or unknown label, or without text: not fitted on; a language with fewer than LEAST_DOCS rows, or
  LEAST_SHARE of them, is not modelled, nor is a label that mostly stands on texts of a far more frequent language.
* ties of two languages: the one around it, else the alphabetically first.
* very long texts: read whole. Repeated rows give rows each; an empty table none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import attach, spread

ORDERS = (2, 4)
BITS = 20
#: Languages whose bits share a word of a filter.
WORD = 32
#: Bits of an n-gram's hash that are counted by, above those of a label or of a text's place.
GRAM_BITS, PLACE_BITS = 48, 16
#: Characters whose n-grams are looked up at a time, and counts that a task holds before it passes them on.
PIECE, HELD = 100_000, 2_000_000
#: A label uses an n-gram that at least this share of its documents has: in a large table any n-gram stands somewhere.
USED = 1 / 300
LEAST_DOCS, LEAST_SHARE = 12, 0.004
#: A label is a wrong one for another language when so much of what its texts use is that language's, which has so many times its rows.
ALIAS, ALIAS_ROWS = 0.85, 3
#: An n-gram belongs to a language whose share of documents with it is at least this part of the highest share, and this much.
RELATIVE, ABSOLUTE = 0.2, 0.012
#: Evidence that lets a sentence leave the language around it: n-grams, part of them known, lead over the other language.
MIN_GRAMS, MIN_KNOWN, LEAD = 12, 0.55, 0.2
#: Least confidence of a finished segment beside others, so many standard errors taken off.
FLOOR, ERRORS = 0.5, 1.0
#: Under this confidence nothing is said of a text: it is no prose in any language modelled.
VERDICT = 0.4

_SENTENCE = re.compile("(?<=[.!?؟…])[\"”»“’')\\]]*\\s+|(?<=[。！？])[」』）]*")
_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(0x30000)])
    return _LETTER


def sentences(block: str) -> list[str]:
    return [x for x in (p.strip() for p in _SENTENCE.split(block)) if x]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and the text each belongs to. Runs of other signs count as one space."""
    joined = "\n".join(texts).lower() + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    owner = np.cumsum(code == 10)
    code = np.where(_letters()[np.minimum(code, 0x2FFFF)], code, np.uint32(0))
    keep = (code != 0) | np.concatenate(([True], (code[:-1] != 0) | (owner[1:] != owner[:-1])))
    code, owner = np.concatenate((np.zeros(1, np.uint32), code[keep])).astype(np.uint64), np.concatenate((np.zeros(1, owner.dtype), owner[keep]))
    hashes, owners = [], []
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + code[i : m + i]
        mid = owner[n // 2 : n // 2 + m]
        ok = (code[1 : m + 1] != 0) if n > 2 else (code[:m] != 0) & (code[1 : m + 1] != 0)
        hashes.append(_mix(h[ok]))
        owners.append(np.minimum(mid[ok], len(texts) - 1))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


@dataclass
class Filters:
    languages: list[str]
    tables: list[np.ndarray]  # bit-sliced: one word of language bits per place, a table for every WORD languages
    wrong: np.ndarray  # rate of false positives by language

    def masks(self, h: np.ndarray) -> list[np.ndarray]:
        low = np.uint64((1 << BITS) - 1)
        one, two = h & low, (h >> np.uint64(BITS)) & low
        return [table[one] & table[two] for table in self.tables]

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) corrected counts, n-grams by text."""
        h, owner = grams(texts)
        masks = self.masks(h)
        n = np.bincount(owner, minlength=len(texts)).astype(float)
        out = np.zeros((len(texts), len(self.languages)))
        if len(h):
            # the n-grams of a text follow each other, order by order
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            for k, mask in enumerate(masks):
                own = self.languages[k * WORD : (k + 1) * WORD]
                bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 4), axis=1, count=len(own), bitorder="little")
                np.add.at(out, (owner[starts], slice(k * WORD, k * WORD + len(own))), np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
        return np.maximum(0.0, (out - n[:, None] * self.wrong) / (1 - self.wrong)), n


def primary(label: str | None) -> str:
    """The primary subtag of a label, lower case; empty for none and for und."""
    x = (label or "").strip().lower().replace("_", "-").split("-")[0]
    return "" if x == "und" else x


def pieces(text: str) -> Iterator[str]:
    """A text in parts of about PIECE characters that have its n-grams between them: cut before a word, whose first letter ends the part before."""
    start = 0
    while len(text) - start > PIECE:
        cut = next((i for i in range(start + PIECE, len(text)) if text[i].isalpha() and not text[i - 1].isalpha()), None)
        if cut is None:
            break
        yield text[start : cut + 1]
        start = cut
    yield text[start:]


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each value of an ordered array is met first."""
    return np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]))


def _once(values: np.ndarray) -> np.ndarray:
    """np.unique by sorting, which takes a twentieth of the time of its hashing here."""
    ordered = np.sort(values)
    return ordered[_firsts(ordered)]


def distinct_grams(texts: list[str]) -> np.ndarray:
    """The n-grams of each text, each once: GRAM_BITS of the hash above the text's place, in order."""
    found, group, places, size = [np.empty(0, np.uint64)], [], [], 0

    def look_up() -> None:
        h, owner = grams(group)
        real = owner % 2 == 0  # what lies across two texts belongs to the empty one between them
        found.append(_once((h[real] << np.uint64(PLACE_BITS)) | np.array(places, np.uint64)[owner[real] // 2]))

    for i, text in enumerate(texts):
        for part in pieces(text.replace("\n", " ")):
            group += [part, ""]
            places.append(i)
            size += len(part)
            if size >= PIECE:
                look_up()
                group, places, size = [], [], 0
    if group:
        look_up()
    return _once(np.concatenate(found))


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys once, with the sum of their counts."""
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    starts = np.flatnonzero(_firsts(key))
    return key[starts], np.add.reduceat(n[order], starts) if len(key) else n


def gram_counts(batches: Iterable[tuple[list[int], list[str]]], held: int | None = HELD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-gram above the number of its label, documents) of batches of label numbers and texts. Passed on when there are more than held; None: once, in the end."""
    keys, counts, size = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    place = np.uint64((1 << PLACE_BITS) - 1)
    for labels, texts in batches:
        start = chars = 0
        for k, text in enumerate(texts, 1):
            chars += len(text)
            if k < len(texts) and chars < 20 * PIECE and k - start < 1 << PLACE_BITS:
                continue
            pairs, of = distinct_grams(texts[start:k]), np.array(labels[start:k], np.uint64)
            key, n = np.unique((pairs & ~place) | of[(pairs & place).astype(np.int64)], return_counts=True)
            keys.append(key)
            counts.append(n)
            size += len(key)
            start, chars = k, 0
            if held is not None and size > held:
                key, n = _added(keys, counts)
                if 2 * len(key) > held:
                    yield key, n
                    key, n = key[:0], n[:0]
                keys, counts, size = [key], [n], len(key)
    yield _added(keys, counts)


def build(sizes: dict[str, int], labels: list[str], keys: np.ndarray, counts: np.ndarray) -> Filters:
    """Filters of labels (in the order of their numbers) from the documents that have each n-gram. sizes: documents by label."""
    number, every_gram = keys & np.uint64((1 << PLACE_BITS) - 1), keys >> np.uint64(PLACE_BITS)
    found = []
    for i, x in enumerate(labels):
        share = counts[own := number == i] / sizes[x]
        order = np.argsort(every_gram[own])
        order = order[share[order] >= USED]
        found.append((x, every_gram[own][order], share[order]))
    kept = [
        (x, values, share)
        for x, values, share in found
        if not any(y != x and sizes[y] >= ALIAS_ROWS * sizes[x] and len(values) and np.isin(values, other, assume_unique=True).mean() >= ALIAS for y, other, _ in found)
    ]
    languages, shares = [x for x, _, _ in kept], [(values, share) for _, values, share in kept]
    highest_at = np.concatenate([v for v, _ in shares]) if shares else np.empty(0, np.uint64)
    every, back = np.unique(highest_at, return_inverse=True)
    highest = np.zeros(len(every))
    np.maximum.at(highest, back, np.concatenate([s for _, s in shares]) if shares else np.empty(0))
    tables = [np.zeros(1 << BITS, np.uint32) for _ in range(max(1, -(-len(languages) // WORD)))]
    low = np.uint64((1 << BITS) - 1)
    for i, (values, share) in enumerate(shares):
        top = highest[np.searchsorted(every, values)]
        member = values[(share >= RELATIVE * top) & (share >= ABSOLUTE)]
        for at in (member & low, (member >> np.uint64(BITS)) & low):
            np.bitwise_or.at(tables[i // WORD], at, np.uint32(1 << i % WORD))
    fills = np.array([((tables[i // WORD] >> np.uint32(i % WORD)) & np.uint32(1)).mean() for i in range(len(languages))])
    return Filters(languages, tables, fills**2)


def fit(rows: list[tuple[str, str]]) -> Filters:
    """rows: (label, text), labels with errors among them."""
    rows = [(x, text) for label, text in rows if (x := primary(label)) and text]
    sizes: dict[str, int] = {}
    for x, _ in rows:
        sizes[x] = sizes.get(x, 0) + 1
    labels = sorted(x for x, n in sizes.items() if n >= max(LEAST_DOCS, LEAST_SHARE * len(rows)))
    at = {x: i for i, x in enumerate(labels)}
    rows = [(at[x], text) for x, text in rows if x in at]
    return build(sizes, labels, *next(gram_counts([([i for i, _ in rows], [text for _, text in rows])], None)))


def labelled(documents: DataFrame, label_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, dict[str, int]]:
    """_place, _text of all rows whose label is not rare, and the rows of these labels; a label's place is that among them in order."""
    label = F.split_part(F.regexp_replace(F.lower(F.trim(F.col(label_col).cast("string"))), "_", "-"), F.lit("-"), F.lit(1))
    rows = documents.select(label.alias("_label"), F.col(text_col).cast("string").alias("_text")).where("_label is not null and _label not in ('', 'und') and _text != ''")
    # labels under the least share are dropped before anything comes to the driver: at most 1 / LEAST_SHARE are left
    counted = rows.groupBy("_label").agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_all"))
    sizes = {r[0]: r[1] for r in attach(counted, total).where((F.col("_n") >= LEAST_SHARE * F.col("_all")) & (F.col("_n") >= LEAST_DOCS)).select("_label", "_n").collect()}
    if not sizes:
        return rows.select(F.lit(0).alias("_place"), "_text").limit(0), {}
    place = F.create_map(*[x for i, k in enumerate(sorted(sizes)) for x in (F.lit(k), F.lit(i))])[F.col("_label")]
    return rows.where(F.col("_label").isin(*sizes)).select(place.alias("_place"), "_text"), sizes


def fit_labelled(rows: DataFrame, sizes: dict[str, int]) -> Filters:
    """Filters from what labelled gives."""
    if not sizes:
        return fit([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in gram_counts((b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches):
            for k in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 100_000].view(np.int64)), pa.array(n[k : k + 100_000])], ["_key", "_n"])

    labels = sorted(sizes)
    least = F.array(*[F.lit(0.999 * USED * sizes[x]) for x in labels])[F.col("_key").bitwiseAND((1 << PLACE_BITS) - 1).cast("int")]
    counted = spread(rows).mapInArrow(run, "_key bigint, _n bigint").groupBy("_key").agg(F.sum("_n").alias("_n"))
    found = counted.where(F.col("_n") >= least).toArrow()
    return build(sizes, labels, found["_key"].to_numpy().view(np.uint64), found["_n"].to_numpy())


def fit_on(documents: DataFrame, label_col: str = "lang", text_col: str = "text") -> Filters:
    """Filters from a table of labelled rows."""
    return fit_labelled(*labelled(documents, label_col, text_col))


def _run(filters: Filters, counts: np.ndarray, n: np.ndarray, lang: int, own: list[int]) -> tuple[int, list[int], float, float]:
    """A run of sentences with its confidence, and the same less the error of so few n-grams."""
    mass, total = counts[own].sum(0), max(1.0, n[own].sum())
    rest = np.delete(mass, lang).max() if len(mass) > 1 else 0.0
    confidence = float(np.clip(mass[lang] / total * (0.5 + 0.5 * (mass[lang] - rest) / max(mass[lang], 1.0)), 0.0, 1.0))
    return lang, own, confidence, confidence - ERRORS * (confidence * (1 - confidence) / total) ** 0.5


def _folded(filters: Filters, counts: np.ndarray, n: np.ndarray, runs: list[tuple[int, list[int]]]) -> list[tuple[int, list[int], float, float]]:
    """Runs too weak to be segments join the stronger neighbour, the weakest first."""
    judged = [_run(filters, counts, n, *r) for r in runs]
    while len(judged) > 1:
        k = min(range(len(judged)), key=lambda i: judged[i][3])
        if judged[k][3] >= FLOOR:
            break
        near = [i for i in (k - 1, k + 1) if 0 <= i < len(judged)]
        lang = judged[max(near, key=lambda i: judged[i][3])][0]
        a = b = k
        while a > 0 and judged[a - 1][0] == lang:
            a -= 1
        while b + 1 < len(judged) and judged[b + 1][0] == lang:
            b += 1
        judged[a : b + 1] = [_run(filters, counts, n, lang, [x for r in judged[a : b + 1] for x in r[1]])]
    return judged


def segments(filters: Filters, blocks: list[str]) -> list[tuple[str, float, list[str]]]:
    """(language, confidence, sentences) of the maximal runs of sentences in one language, in order."""
    if not filters.languages:
        return []
    texts = [s.replace("\n", " ") for b in blocks for s in sentences(b)]
    if not texts:
        return []
    counts, n = filters.counts(texts)
    if not counts.sum():
        return []
    page = counts.sum(0)
    main = int(np.argmax(page))
    top = counts.argmax(1)
    rows = np.arange(len(texts))
    known = counts[rows, top] / np.maximum(n, 1)
    sure = (n >= MIN_GRAMS) & (known >= MIN_KNOWN)
    # text before the first sure sentence belongs to what follows it
    second = counts.copy()
    second[rows, top] = -1
    clear = sure & ((counts[rows, top] - second.max(1)) >= LEAD * n)
    first = next((int(top[i]) for i in rows if clear[i]), main)
    now, runs = first, []
    for i in rows:
        t = int(top[i])
        if t != now and sure[i] and counts[i, t] - counts[i, now] >= LEAD * n[i]:
            now = t
        if runs and runs[-1][0] == now:
            runs[-1][1].append(i)
        else:
            runs.append((now, [i]))
    return [(filters.languages[lang], round(confidence, 4), [texts[i] for i in own]) for lang, own, confidence, _ in _folded(filters, counts, n, runs)]
