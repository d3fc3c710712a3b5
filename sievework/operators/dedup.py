"""Duplicates: exact by normalised text, near by Jaccard value of word shingles or by SimHash with banding, and the election of one copy.

Texts with the same shingles are collapsed before any pair is made. Pairs of
Jaccard value 0.8 or more are found exactly: both sets of such a pair have one of
their first shingles in common, whatever order all sets are read in (here rare
ones first), and every pair so met is verified. Every document gets the id of its
class. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, spread
from .graph import connected_components

SHINGLE = 5
BANDS = 4
MAX_DISTANCE = 3
HYSTERESIS = 1.15
#: A band value shared by more different texts than this is split by a second band before pairs are made.
WIDE_BAND = 64
#: Pairs have this Jaccard value at least, as a fraction.
NEAR = (4, 5)
#: Shingle frequencies are kept by so many buckets, a table of fixed size; they only set the order.
BUCKETS = 1 << 18
_WORD = re.compile(r"[^\W_]+")


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def text_key(text: Column) -> Column:
    """IB-26."""
    return F.sha2(normalised(text), 256)


def exact_copies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the smallest id with the same normalised text; partial aggregation keeps hot texts small."""
    keyed = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"))
    first = keyed.groupBy("_key").agg(F.min("_id").alias("_first"), F.count("*").alias("copies"))
    return keyed.join(first, "_key").select(F.col("_id").alias(id_col), F.col("_first").alias("copy_of"), "copies")


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """TX-21: distinct runs of n words; one shingle of all words for shorter texts, none without words."""

    def cut(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.array_distinct(F.when(F.size(w) >= n, runs).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))

    return F.transform(F.array(words), cut)[0]  # bound once, not once a shingle


def simhash64(text: str | None) -> int | None:
    """IB-27: signed sum of the 64 leading md5 bits of every 5-word shingle, by its count; a bit is set when its sum is positive. Signed 64-bit view."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return None
    runs = [" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    heads = np.frombuffer(b"".join(hashlib.md5(r.encode()).digest()[:8] for r in runs), np.uint8).reshape(-1, 8)
    ones = np.unpackbits(heads, axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(runs))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def simhashes(docs: DataFrame, id_col: str, text_col: str, keyed: bool = False) -> DataFrame:
    """id, simhash; with the key of the text where keyed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns="_t").assign(simhash=pd.array([simhash64(t) for t in pdf["_t"]], dtype="Int64"))

    kind = dict(docs.dtypes)[id_col]
    key = [text_key(F.col(text_col)).alias("_key")] if keyed else []
    rows = spread(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), *key)).mapInPandas(run, f"_id {kind}, {'_key string, ' if keyed else ''}simhash bigint")
    return rows.withColumnRenamed("_id", id_col)


def near_pairs(hashes: DataFrame, id_col: str, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """IB-28: a, b, distance of different hashes at most max_distance apart (at most 3: one of four bands must agree).

    hashes: id, simhash, one row per distinct hash. A band value with many members is cut finer: within it, three bits
    may differ among the other 48, so one of the remaining bands cut in four parts of 12 bits must agree.
    """
    band = lambda i: F.shiftrightunsigned("simhash", 16 * i).bitwiseAND(0xFFFF)
    keyed = hashes.where("simhash is not null").select(id_col, "simhash", F.posexplode(F.array(*[band(i) for i in range(BANDS)])).alias("band", "value"))
    sizes = keyed.groupBy("band", "value").agg(F.count("*").alias("_n")).where("_n > 1")
    placed = keyed.join(sizes, ["band", "value"])
    # the 48 bits beside the band, in four parts of 12: with three differences one part agrees
    rest = F.concat_ws("", *[F.when(F.col("band") != i, F.lpad(F.conv(band(i).cast("string"), 10, 2), 16, "0")) for i in range(BANDS)])
    finer = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda p: F.concat(p.cast("string"), F.lit(":"), F.substring(rest, p * 12 + 1, F.lit(12))))
    cut = placed.withColumn("_sub", F.when(F.col("_n") > WIDE_BAND, finer).otherwise(F.array(F.lit("")))).withColumn("_sub", F.explode("_sub"))
    left = cut.select("band", "value", "_sub", F.col(id_col).alias("a"), F.col("simhash").alias("_ha"))
    right = cut.select("band", "value", "_sub", F.col(id_col).alias("b"), F.col("simhash").alias("_hb"))
    distance = F.bit_count(F.col("_ha").bitwiseXOR(F.col("_hb")))
    return left.join(right, ["band", "value", "_sub"]).where((F.col("a") < F.col("b")) & (distance <= max_distance)).select("a", "b", distance.cast("int").alias("distance")).distinct()


def simhash_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """IB-28/29 by SimHash alone: id, class_id (its smallest id), links (other texts of its own hash and of the linked hashes)."""
    hashed = materialise(simhashes(docs, id_col, text_col, keyed=True), "simhash")
    texts = hashed.where("simhash is not null").groupBy("simhash", "_key").agg(F.min(id_col).alias(id_col))
    one = materialise(texts.groupBy("simhash").agg(F.min(id_col).alias(id_col), F.count("*").alias("_texts")), "representatives")
    pairs = materialise(near_pairs(one, id_col), "pairs")
    sizes = one.select(F.col(id_col).alias("_o"), F.col("_texts").alias("_t"))
    ends = pairs.select(F.col("a").alias("_r"), F.col("b").alias("_o")).union(pairs.select("b", "a")).join(sizes, "_o").groupBy("_r").agg(F.sum("_t").alias("_others"))
    classes = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("_r"), "component")
    members = hashed.join(one.withColumnRenamed(id_col, "_r"), "simhash", "left").join(classes, "_r", "left").join(ends, "_r", "left")
    links = F.coalesce(F.col("_texts") - 1, F.lit(0)) + F.coalesce("_others", F.lit(0))
    return members.select(id_col, F.coalesce("component", "_r", F.col(id_col)).alias("class_id"), links.alias("links"))


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, _key of its text, _set: hashes of its distinct shingles, _sig of the set; both null for texts without words."""
    words = F.regexp_extract_all(F.lower(text_col), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    hashed = F.array_sort(F.array_distinct(F.transform(shingles(words), lambda x: F.xxhash64(x))))
    rows = spread(docs.select(id_col, text_col)).select(id_col, text_key(F.col(text_col)).alias("_key"), hashed.alias("_set"))
    rows = rows.withColumn("_set", F.when(F.size("_set") > 0, F.col("_set")))
    return rows.withColumn("_sig", F.sha2(F.array_join(F.col("_set").cast("array<string>"), ","), 256))


def similar_sets(sets: DataFrame) -> DataFrame:
    """a, b, common of all pairs of sets with a Jaccard value of NEAR or more. sets: _r, _set, _n, each set once."""
    num, den = NEAR
    bucket = F.col("_x").bitwiseAND(BUCKETS - 1)
    counts = sets.select(F.explode("_set").alias("_x")).groupBy(bucket.cast("int").alias("_b")).agg(F.count("*").alias("_c")).toPandas()
    rank = np.zeros(BUCKETS, np.uint8)
    rank[counts["_b"].to_numpy(np.int64)] = np.minimum(255, 8 * np.log2(counts["_c"].to_numpy(np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            firsts = []
            for x in pdf["_set"]:
                x = np.asarray(x, np.int64)
                firsts.append(x[np.lexsort((x, rank[x & (BUCKETS - 1)]))[: len(x) - -(-num * len(x) // den) + 1]])
            yield pdf[["_r", "_n"]].assign(_first=firsts)

    kind = dict(sets.dtypes)["_r"]
    firsts = sets.select("_r", "_n", "_set").mapInPandas(run, f"_r {kind}, _n int, _first array<bigint>")
    keyed = materialise(firsts.select("_r", "_n", F.posexplode("_first").alias("_at", "_x")), "firsts")
    left, right = (keyed.select("_x", F.col("_r").alias(r), F.col("_n").alias("_n" + r), F.col("_at").alias("_at" + r)) for r in "ab")
    # at the first common shingle of a pair no more than the rest of either set can still be common
    enough = (num + den) * F.least(F.col("_na") - F.col("_ata"), F.col("_nb") - F.col("_atb")) >= num * (F.col("_na") + F.col("_nb"))
    met = left.join(right, "_x").where((F.col("a") < F.col("b")) & enough).select("a", "b").distinct()
    own = lambda r: sets.select(F.col("_r").alias(r), F.col("_set").alias("_s" + r))
    both = met.join(own("a"), "a").join(own("b"), "b").withColumn("common", F.size(F.array_intersect("_sa", "_sb")))
    return both.where((num + den) * F.col("common") >= num * (F.size("_sa") + F.size("_sb"))).select("a", "b", "common")


def near_duplicate_classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """IB-29 by the Jaccard value of 5-word shingles: id, class_id (its smallest id), links (other texts that its own text is as near to as NEAR)."""
    rows = materialise(shingle_sets(docs, id_col, text_col), "shingles")
    known = rows.where("_sig is not null")
    texts = known.groupBy("_sig", "_key").agg(F.min(id_col).alias("_r")).groupBy("_sig").agg(F.min("_r").alias("_r"), F.count("*").alias("_texts"))
    one = materialise(texts, "representatives")
    sets = materialise(known.groupBy("_sig").agg(F.any_value("_set").alias("_set")).join(one, "_sig").select("_r", "_set", F.size("_set").alias("_n")), "sets")
    pairs = materialise(similar_sets(sets), "pairs")
    members = one.select("_r", "_texts")
    ends = pairs.select(F.col("a").alias("_r"), F.col("b").alias("_o")).union(pairs.select("b", "a")).join(members.select(F.col("_r").alias("_o"), "_texts"), "_o").groupBy("_r").agg(F.sum("_texts").alias("_others"))
    classes = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("_r"), "component")
    found = one.join(classes, "_r", "left").join(ends, "_r", "left").select("_sig", F.coalesce("component", "_r").alias("class_id"), (F.col("_texts") - 1 + F.coalesce("_others", F.lit(0))).alias("links"))
    return rows.select(id_col, "_sig").join(found, "_sig", "left").select(id_col, F.coalesce("class_id", F.col(id_col)).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def elect(members: DataFrame, class_col: str, id_col: str, score: str, incumbent: str | None = None) -> DataFrame:
    """One id per class: the highest score, the smaller id of equal ones; an incumbent stays unless beaten by 15 %."""
    best = F.max_by(F.struct(F.col(id_col), F.col(score)), F.struct(F.col(score), -F.col(id_col))).alias("_b")
    if incumbent is None:
        return members.groupBy(class_col).agg(best).select(class_col, F.col(f"_b.{id_col}").alias("elected"))
    held = F.max(F.when(F.col(incumbent), F.struct(F.col(id_col), F.col(score)))).alias("_i")
    both = members.groupBy(class_col).agg(best, held)
    stays = F.col("_i").isNotNull() & (F.col(f"_b.{score}") <= HYSTERESIS * F.col(f"_i.{score}"))
    return both.select(class_col, F.when(stays, F.col(f"_i.{id_col}")).otherwise(F.col(f"_b.{id_col}")).alias("elected"))
