"""Compact binary forms of index data: variable-length numbers, gaps, packed bits, front-coded words, sets of deleted ids.

Parquet encodes the served tables; these forms are for exchange and for sizes.
Everything works on whole arrays, block by block in Arrow batches. A block holds at
most BLOCK_DOCS postings, FRONT terms or CONTAINER ids, so no group grows with the data.

Defined results: empty arrays give empty bytes and come back empty; ids must rise
and frequencies be 1 at least, ValueError else; numbers from 0 to 2^62.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .index import BLOCK_DOCS, numbered_postings
from .ranks import global_row_number

FRONT = 16
CONTAINER = 1 << 16
#: A container with so many of its ids deleted is kept as a bitmap.
DENSE = 0.05


# --- numbers -----------------------------------------------------------------------------------------


def varints(values: np.ndarray) -> bytes:
    """IB-06: seven bits a byte, the low ones first; the high bit says that more follow."""
    v = np.asarray(values, np.uint64)
    if len(v) == 0:
        return b""
    need = np.ones(len(v), np.int64)
    for k in range(1, 10):
        need += v >= (np.uint64(1) << np.uint64(7 * k))
    ends = np.cumsum(need)
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(int(need.max())):
        has = need > k
        at = ends[has] - need[has] + k
        out[at] = ((v[has] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8) | np.where(need[has] > k + 1, 0x80, 0).astype(np.uint8)
    return out.tobytes()


def from_varints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if len(b) == 0:
        return np.empty(0, np.int64)
    last = np.flatnonzero(b < 0x80)
    if len(last) == 0 or last[-1] != len(b) - 1:
        raise ValueError("a number is cut off")
    starts = np.concatenate(([0], last[:-1] + 1))
    place = np.arange(len(b)) - np.repeat(starts, last - starts + 1)
    parts = (b & 0x7F).astype(np.uint64) << (np.uint64(7) * place.astype(np.uint64))
    return np.bitwise_or.reduceat(parts, starts).astype(np.int64)


def gaps(ids: np.ndarray, base: int = 0) -> np.ndarray:
    """IB-07: each id less the one before, the first less the last id of the block before."""
    out = np.diff(np.asarray(ids, np.int64), prepend=base)
    if len(out) and (out[1:] <= 0).any() or len(out) and out[0] < 0:
        raise ValueError("ids must rise")
    return out


def from_gaps(values: np.ndarray, base: int = 0) -> np.ndarray:
    return base + np.cumsum(values)


def bit_width(values: np.ndarray) -> int:
    """IB-08: bits that the largest value takes."""
    return int(max(values, default=0)).bit_length()


def packed_size(count: int, width: int) -> int:
    return -(-count * width // 8)


def pack(values: np.ndarray, width: int) -> bytes:
    """IB-08: width bits a value, the low bit first."""
    if width == 0 or len(values) == 0:
        return b""
    bits = (np.asarray(values, np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, width: int) -> np.ndarray:
    if width == 0 or count == 0:
        return np.zeros(count, np.int64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    return (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1).astype(np.int64)


def float_up(value: float) -> float:
    """IB-09: the smallest 32-bit number that is not below the value: a bound stays a bound."""
    near = np.float32(value)
    return float(near if float(near) >= value else np.nextafter(near, np.float32(math.inf)))


# --- postings ----------------------------------------------------------------------------------------


def encode_block(ids: np.ndarray, freqs: np.ndarray, base: int) -> bytes:
    """Width and packed gaps, then the frequencies less one."""
    if len(freqs) and min(freqs) < 1:
        raise ValueError("a posting has a frequency of 1 at least")
    g = gaps(ids, base)
    width = bit_width(g)
    return bytes([width]) + pack(g, width) + varints(np.asarray(freqs, np.int64) - 1)


def decode_block(data: bytes, count: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    width = data[0]
    size = packed_size(count, width)
    return from_gaps(unpack(data[1 : 1 + size], count, width), base), from_varints(data[1 + size :]) + 1


def encoded_postings(posts: DataFrame, size: int = BLOCK_DOCS) -> DataFrame:
    """IB-10: term, block, count, base (last id of the block before), data."""
    placed = numbered_postings(posts.select("term", "doc_id", "tf")).withColumn("block", F.floor(F.col("place") / size))
    lists = placed.groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("_l"))
    before = lists.select("term", (F.col("block") + 1).alias("block"), F.element_at("_l", -1)["doc_id"].alias("base"))
    rows = lists.join(before, ["term", "block"], "left").select("term", "block", F.coalesce("base", F.lit(0)).alias("base"), F.col("_l.doc_id").alias("_d"), F.col("_l.tf").alias("_f"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            data = [encode_block(np.asarray(d), np.asarray(f), b) for d, f, b in zip(pdf["_d"], pdf["_f"], pdf["base"])]
            yield pdf[["term", "block", "base"]].assign(count=[len(d) for d in pdf["_d"]], data=data)[["term", "block", "count", "base", "data"]]

    return rows.mapInPandas(run, "term string, block bigint, count int, base bigint, data binary")


def decoded_postings(blocks: DataFrame) -> DataFrame:
    """term, doc_id, tf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = [decode_block(bytes(x), n, b) for x, n, b in zip(pdf["data"], pdf["count"], pdf["base"])]
            if parts:
                ids, freqs = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame({"term": np.repeat(pdf["term"].to_numpy(), pdf["count"]), "doc_id": ids, "tf": freqs})

    return blocks.mapInPandas(run, "term string, doc_id bigint, tf bigint")


def advance(posts: DataFrame, blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """IB-11: term, target, doc_id, block, last_doc, max_saturation: the first posting of a term at or after a target, by its block.

    wanted: term, target, the caller's own. Blocks before the target are never read.
    """
    # of the blocks that end at or after the target the first one holds the posting
    ahead = blocks.join(F.broadcast(wanted), "term").where("last_doc >= target").groupBy("term", "target").agg(F.min_by(F.struct("block", "first_doc", "last_doc", "max_saturation"), "block").alias("_b"))
    held = F.broadcast(ahead.select("term", "target", "_b.*"))
    found = posts.select("term", "doc_id").join(held, "term").where("doc_id >= target and doc_id between first_doc and last_doc")
    return found.groupBy("term", "target", "block", "last_doc", "max_saturation").agg(F.min("doc_id").alias("doc_id"))


# --- words -------------------------------------------------------------------------------------------


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def encode_words(words: list[str]) -> bytes:
    """IB-13: of each word what it shares with the one before, and the rest. Words must rise."""
    out, before = bytearray(), ""
    for w in words:
        k = shared_prefix(before, w)
        rest = w[k:].encode()
        out += varints(np.array([k, len(rest)])) + rest
        before = w
    return bytes(out)


def decode_words(data: bytes) -> list[str]:
    out, at, before = [], 0, ""
    while at < len(data):
        head = []
        for _ in range(2):
            end = at
            while data[end] & 0x80:
                end += 1
            head.append(int(from_varints(data[at : end + 1])[0]))
            at = end + 1
        before = before[: head[0]] + data[at : at + head[1]].decode()
        at += head[1]
        out.append(before)
    return out


def front_coded(dictionary: DataFrame, size: int = FRONT) -> DataFrame:
    """IB-13: block, first, last, data, doc_freqs, total_tfs of the sorted dictionary."""
    ranked = global_row_number(dictionary, [F.asc("term")], "n").withColumn("block", F.floor(F.col("n") / size))
    lists = ranked.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("term", "doc_freq", "total_tf"))).alias("_l"))
    rows = lists.select("block", F.element_at("_l", 1)["term"].alias("first"), F.element_at("_l", -1)["term"].alias("last"), F.col("_l.term").alias("_w"), F.col("_l.doc_freq").alias("doc_freqs"), F.col("_l.total_tf").alias("total_tfs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(data=[encode_words(list(w)) for w in pdf["_w"]])[["block", "first", "last", "data", "doc_freqs", "total_tfs"]]

    return rows.mapInPandas(run, "block bigint, first string, last string, data binary, doc_freqs array<bigint>, total_tfs array<bigint>")


def dictionary_rows(blocks: DataFrame) -> DataFrame:
    """IB-13, iterate: term, doc_freq, total_tf."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [decode_words(bytes(x)) for x in pdf["data"]]
            yield pd.DataFrame({"term": sum(words, []), "doc_freq": np.concatenate([*pdf["doc_freqs"], []]).astype(np.int64), "total_tf": np.concatenate([*pdf["total_tfs"], []]).astype(np.int64)})

    return blocks.mapInPandas(run, "term string, doc_freq bigint, total_tf bigint")


def lookup(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """IB-13: term, doc_freq, total_tf of the terms that there are; only blocks that may hold one are decoded. terms: term, the caller's own."""
    own = F.broadcast(terms.select(F.col("term").alias("_t")).distinct())
    near = blocks.join(own, (F.col("_t") >= F.col("first")) & (F.col("_t") <= F.col("last")), "left_semi")
    return dictionary_rows(near).join(own, F.col("term") == F.col("_t"), "left_semi")


# --- deleted ids -------------------------------------------------------------------------------------


def encode_set(places: np.ndarray, size: int = CONTAINER) -> tuple[str, bytes]:
    """IB-15: a rising list of places below size, as gaps, or as a bitmap where many are set."""
    if len(places) >= DENSE * size:
        bits = np.zeros(size, np.uint8)
        bits[places] = 1
        return "dense", np.packbits(bits, bitorder="little").tobytes()
    return "sparse", varints(gaps(places))


def decode_set(kind: str, data: bytes) -> np.ndarray:
    if kind == "dense":
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))
    return from_gaps(from_varints(data))


def encoded_ids(ids: DataFrame, column: str = "doc_id", container: int = CONTAINER) -> DataFrame:
    """IB-15: container, count, kind, data of a set of ids, repeated ones once."""
    placed = ids.where(F.col(column).isNotNull()).select(F.floor(F.col(column) / container).alias("container"), F.pmod(F.col(column), F.lit(container)).cast("int").alias("_p"))
    lists = placed.groupBy("container").agg(F.array_sort(F.collect_set("_p")).alias("_l"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [encode_set(np.asarray(x, np.int64), container) for x in pdf["_l"]]
            yield pd.DataFrame({"container": pdf["container"], "count": [len(x) for x in pdf["_l"]], "kind": [k for k, _ in made], "data": [d for _, d in made]})

    return lists.mapInPandas(run, "container bigint, count int, kind string, data binary")


def decoded_ids(containers: DataFrame, column: str = "doc_id", container: int = CONTAINER) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c, kind, data in zip(pdf["container"], pdf["kind"], pdf["data"]):
                yield pd.DataFrame({column: np.int64(c) * container + decode_set(kind, bytes(data))}, dtype="int64")

    return spread(containers).mapInPandas(run, f"`{column}` bigint")
