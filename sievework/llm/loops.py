"""Repetition inside a single document, by compression bands.

Every text is reduced to what repeats (lower case, letters only) and compressed
with zstandard, whole and in fixed chunks. ORDINARY says to what part ordinary
text of some length compresses. A text of which half repeats the other half
costs what that other half costs, so its ratio is half of the ordinary ratio of
half its length: that is the lower limit of the band of its length, below which
a text is repetitive. Far above the ordinary ratio it is incompressible. A
document is repetitive when the whole of it is, or chunks are that hold half of
its bytes. The bands decide; the exact share of repeated words is measured
beside them and decides alone only where compression can't tell, under
MIN_BYTES.

The repeated share: words that stand in passages of RUN or more words (in
scripts without spaces: CHARS characters) which occurred earlier in the text.

ORDINARY was measured on text of this project's kind; ordinary_ratios measures it
on another corpus.

Defined results
* null or empty text: ratio 1, share 0, band "short".
* texts under MIN_BYTES: band "short"; repetitive by the exact share.
* very long texts: read whole, chunk by chunk.
* null ids are kept as they are; repeated rows give a row each; an empty table gives none.
* further columns: ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

RUN, CHARS = 5, 10
SHARE = 0.5
MIN_BYTES = 80
CHUNK = 4096
LEVEL = 3
#: (bytes, zstandard ratio of ordinary text of that length); between and beyond them by the logarithms of both.
ORDINARY = (
    (65, 0.90), (100, 0.78), (140, 0.72), (195, 0.66), (280, 0.60), (400, 0.56), (560, 0.52), (800, 0.47), (1120, 0.43), (1600, 0.38), (2250, 0.34), (3140, 0.30), (4500, 0.27), (6300, 0.24), (10000, 0.21),
)
#: Part of the ordinary ratio of half the length that is the lower limit; part of the ordinary ratio that is the upper one.
LOWER, UPPER = 0.5, 1.6

_WORD = re.compile(r"[^\W\d_]+")
_UNSPACED = re.compile("[぀-ヿ㐀-鿿豈-﫿]")


def units(text: str | None) -> tuple[list[str], int, str]:
    """Words (or characters), the length of a passage, and what joins them."""
    if not text:
        return [], RUN, " "
    found = _WORD.findall(text.lower())
    if _UNSPACED.search(text):
        letters = "".join(found)
        if 2 * len(_UNSPACED.findall(letters)) > len(letters):
            return list(letters), CHARS, ""
    return found, RUN, " "


def repeated_share(tokens: list[str], run: int) -> float:
    """Part of the tokens that are covered by a run of `run` tokens which began earlier too; overlaps count."""
    n = len(tokens) - run + 1
    if n <= 1:
        return 0.0
    seen: set[tuple[str, ...]] = set()
    covered, reach = 0, 0
    for i, gram in enumerate(zip(*(tokens[k:] for k in range(run)))):
        if gram in seen:
            covered += i + run - max(i, reach)
            reach = i + run
        else:
            seen.add(gram)
    return covered / len(tokens)


class Bands:
    """Length-specific limits that follow from a curve of ordinary ratios."""

    def __init__(self, ordinary=ORDINARY):
        self.at, self.ratio = np.log([n for n, _ in ordinary]), np.log([r for _, r in ordinary])
        self.slope = (self.ratio[-1] - self.ratio[-2]) / (self.at[-1] - self.at[-2]) if len(ordinary) > 1 else 0.0

    def ordinary(self, size: float) -> float:
        x = np.log(size)
        past = max(0.0, x - self.at[-1])
        return float(min(1.0, np.exp(np.interp(x, self.at, self.ratio) + past * self.slope)))

    def limits(self, size: int) -> tuple[float, float]:
        return LOWER * self.ordinary(max(1, size / 2)), min(1.0, UPPER * self.ordinary(size))


_EMPTY = len(zstandard.ZstdCompressor(level=LEVEL).compress(b""))


def ratio_of(data: bytes, compressor: zstandard.ZstdCompressor) -> float:
    """Compressed by plain size, the frame's own bytes taken off."""
    return (len(compressor.compress(data)) - _EMPTY) / len(data)


def verdict(data: bytes, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float, float, str]:
    """Ratio of the whole, lowest ratio of a chunk, and what the bands say: repetitive, incompressible, ordinary, or short."""
    if not data:
        return 1.0, 1.0, "short"
    whole = least = ratio_of(data, compressor)
    if len(data) < MIN_BYTES:
        return whole, least, "short"
    low, high = bands.limits(len(data))
    loops = noise = 0
    if len(data) > CHUNK:
        for i in range(0, len(data), CHUNK):
            piece = data[i : i + CHUNK]
            if len(piece) < MIN_BYTES:
                break
            r = ratio_of(piece, compressor)
            least = min(least, r)
            under, over = bands.limits(len(piece))
            loops += len(piece) * (r < under)
            noise += len(piece) * (r > over)
    if whole < low or 2 * loops >= len(data):
        return whole, least, "repetitive"
    return whole, least, "incompressible" if whole > high or 2 * noise >= len(data) else "ordinary"


def measure(text: str | None, bands: Bands, compressor: zstandard.ZstdCompressor, exact: bool) -> tuple[float, float, str, bool, float | None]:
    """Ratios, band, whether the text is repetitive, and its repeated share (without `exact` only where the bands can't tell)."""
    tokens, run, joint = units(text)
    whole, least, band = verdict(joint.join(tokens).encode(), bands, compressor)
    share = repeated_share(tokens, run) if exact or band == "short" else None
    return whole, least, band, share >= SHARE if band == "short" else band == "repetitive", share


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ordinary=ORDINARY, exact: bool = True) -> DataFrame:
    """id, zstd_ratio, least_chunk_ratio, band, repetitive, repeated_share. One pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressor, bands = zstandard.ZstdCompressor(level=LEVEL), Bands(ordinary)
        for pdf in batches:
            rows = [measure(t, bands, compressor, exact) for t in pdf["_text"]]
            out = pd.DataFrame(rows, columns=["zstd_ratio", "least_chunk_ratio", "band", "repetitive", "repeated_share"])
            out.insert(0, id_col, pdf["_id"].to_numpy())
            yield out

    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return spread(rows).mapInPandas(run, f"`{id_col}` {kind}, zstd_ratio double, least_chunk_ratio double, band string, repetitive boolean, repeated_share double")


def ordinary_ratios(df: DataFrame, text_col: str = "text") -> DataFrame:
    """bytes, ratio, texts: the median zstandard ratio of all texts by half octaves of their length, to take for ORDINARY elsewhere."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for pdf in batches:
            out = []
            for t in pdf["_text"]:
                tokens, _, joint = units(t)
                data = joint.join(tokens).encode()
                if len(data) >= MIN_BYTES:
                    out.append((int(2 * np.log2(len(data))), len(data), ratio_of(data, compressor)))
            yield pd.DataFrame(out, columns=["_bin", "_n", "_r"])

    rows = spread(df.select(F.col(text_col).cast("string").alias("_text"))).mapInPandas(run, "_bin int, _n int, _r double")
    return rows.groupBy("_bin").agg(F.percentile_approx("_n", 0.5).alias("bytes"), F.percentile_approx("_r", 0.5).alias("ratio"), F.count("*").alias("texts")).drop("_bin")
