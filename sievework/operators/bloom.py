"""A Bloom filter as a table of words: set once by one aggregation, asked by one join.

Bits are put by two halves of the MD5 of a key, so any engine gives the same
places. The filter is a table of bits / WORD rows; keys are spread over it by their
places, so no key and no word gathers.

Defined results: null keys are left out; an empty set says no to all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import attach
from .crawl import bloom_params

WORD = 32


def places(key: Column, bits: int, hashes: int) -> Column:
    """CR-02: the bits of a key, by double hashing."""
    half = lambda start: F.conv(F.substring(F.md5(key), start, 8), 16, 10).cast("bigint")
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(half(1) + i * (half(9).bitwiseOR(F.lit(1))), F.lit(bits)))


def _bit() -> Column:
    """The bit of place _p within its word."""
    return F.expr(f"shiftleft(1L, cast(pmod(_p, {WORD}) as int))")


def words(keys: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """word, mask of the bits that the keys set."""
    placed = keys.where(F.col(key).isNotNull()).select(F.explode(places(F.col(key), bits, hashes)).alias("_p"))
    return placed.groupBy(F.floor(F.col("_p") / WORD).alias("word")).agg(F.bit_or(_bit()).alias("mask"))


def maybe(keys: DataFrame, key: str, filter_: DataFrame, bits: int, hashes: int) -> DataFrame:
    """The distinct keys that the filter may hold: all of their bits are set."""
    one = keys.where(F.col(key).isNotNull()).select(key).distinct()
    asked = one.select(key, F.explode(F.array_distinct(places(F.col(key), bits, hashes))).alias("_p"))
    total = asked.withColumn("word", F.floor(F.col("_p") / WORD)).join(filter_, "word", "left")
    is_set = F.coalesce(F.col("mask").bitwiseAND(_bit()) != 0, F.lit(False))
    return total.groupBy(key).agg(F.min(is_set).alias("_all")).where("_all").select(key)


def seen_stats(offers: DataFrame, seen: DataFrame, key: str = "key", error: float = 0.01) -> DataFrame:
    """CR-05: checked, unique keys, bloom_skipped (new for certain), exact_consulted, already_seen, and false_positives of the filter."""
    known = seen.where(F.col(key).isNotNull()).select(key).distinct()
    bits, hashes = bloom_params(max(1, known.count()), error)
    may = maybe(offers, key, words(known, key, bits, hashes), bits, hashes)
    exact = may.join(known.withColumn("_seen", F.lit(True)), key, "left")
    counts = exact.agg(F.count("*").alias("exact_consulted"), F.count_if("_seen").alias("already_seen"))
    base = offers.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("checked"), F.count("*").alias("unique_keys"))
    rows = attach(base, counts)
    return rows.select("checked", "unique_keys", (F.col("unique_keys") - F.col("exact_consulted")).alias("bloom_skipped"), "exact_consulted", "already_seen", (F.col("exact_consulted") - F.col("already_seen")).alias("false_positives"))


def new_keys(offers: DataFrame, seen: DataFrame, key: str = "key", error: float = 0.01) -> DataFrame:
    """CR-02/04: distinct keys that were not seen: those the filter has not, and of the others those the exact store has not."""
    known = seen.where(F.col(key).isNotNull()).select(key).distinct()
    bits, hashes = bloom_params(max(1, known.count()), error)
    one = offers.where(F.col(key).isNotNull()).select(key).distinct()
    may = maybe(one, key, words(known, key, bits, hashes), bits, hashes)
    return one.join(may, key, "left_anti").unionByName(may.join(known, key, "left_anti"))
