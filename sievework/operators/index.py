"""Inverted index as tables: documents, postings, dictionary, blocks, tombstones, segments.

Defined results: null ids are left out; a repeated record counts once; null or
empty terms give no postings; a null static rank is 0; a null length is the
number of distinct positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach
from .ranks import CHUNK, chunked_row_number, global_row_number

BLOCK_DOCS = 128
#: Documents of a range: ids follow the static rank, so a range is of one rank.
RANGE_DOCS = 32
MERGE_SEGMENTS, MERGE_DEAD = 8, 0.25


def token_count(terms: Column) -> Column:
    """TX-16: distinct positions over all terms."""
    return F.size(F.array_distinct(F.flatten(F.map_values(terms))))


def records(df: DataFrame) -> DataFrame:
    """external_id, terms, static_rank, length: one row per record."""
    rows = df.where("external_id is not null").groupBy("external_id").agg(
        F.min_by("terms", F.xxhash64(F.map_entries("terms"))).alias("terms"), F.coalesce(F.max("static_rank"), F.lit(0.0)).alias("static_rank"), F.max("length").alias("length")
    )
    return rows.withColumn("length", F.coalesce(F.col("length"), F.greatest(token_count(F.col("terms")), F.lit(0)), F.lit(0)).cast("bigint"))


def assign_doc_ids(docs: DataFrame) -> DataFrame:
    """IB-01: doc_id by descending static rank, then external id."""
    return global_row_number(docs, [F.desc("static_rank"), F.asc("external_id")], "doc_id")


def postings(docs: DataFrame, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """IB-02: key, term, tf, positions, and the columns of the document to keep."""
    own = keep or []
    rows = docs.select(key, *own, F.explode("terms").alias("term", "positions"))
    return rows.select(key, "term", F.greatest(F.size("positions"), F.lit(1)).cast("bigint").alias("tf"), F.array_sort("positions").alias("positions"), *own)


def range_of(doc_id: Column) -> Column:
    """The range of document ids that shares bounds."""
    return F.floor(doc_id / RANGE_DOCS).cast("bigint")


def range_bounds(posts: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """IB-05 by ranges that all terms share: term, range, docs, max_saturation. posts: term, range, tf, length, _avg."""
    return posts.groupBy("term", "range").agg(F.count("*").alias("docs"), F.max(saturation(F.col("tf"), F.col("length"), F.col("_avg"), k1, b)).alias("max_saturation"))


def dictionary(posts: DataFrame) -> DataFrame:
    """IB-04."""
    return posts.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("total_tf"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """IB-36: one row."""
    return docs.agg(F.count("*").alias("doc_count"), F.avg("length").alias("avg_length"), F.sum("length").alias("total_length"))


def saturation(tf: Column, length: Column, avg: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """RK-02."""
    mean = F.when(avg > 0, avg).otherwise(F.lit(1.0))
    return F.when(tf <= 0, F.lit(0.0)).otherwise(tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * length / mean)))


def idf(df: Column, n: Column) -> Column:
    """RK-01."""
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5))))


def numbered_postings(posts: DataFrame) -> DataFrame:
    """Postings with their place in the term's list, hot terms numbered in chunks of documents."""
    return chunked_row_number(posts, ["term"], ["doc_id"], F.floor(F.col("doc_id") / CHUNK), "place")


def posting_blocks(posts: DataFrame, docs: DataFrame, size: int = BLOCK_DOCS) -> DataFrame:
    """IB-05: term, block, docs, first_doc, last_doc, max_saturation."""
    stats = docs.agg(F.avg("length").alias("_avg"))
    placed = numbered_postings(posts.select("term", "doc_id", "tf")).withColumn("block", F.floor(F.col("place") / size))
    sized = attach(placed.join(docs.select("doc_id", "length"), "doc_id"), stats)
    return sized.groupBy("term", "block").agg(
        F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.max(saturation(F.col("tf"), F.col("length"), F.col("_avg"))).alias("max_saturation")
    )


def posting_gaps(posts: DataFrame, size: int = BLOCK_DOCS) -> DataFrame:
    """IB-07/08: per block of a term the largest gap to the previous document and the bits that it takes.

    The first gap of a block counts from the last document of the block before.
    """
    placed = numbered_postings(posts.select("term", "doc_id")).withColumn("block", F.floor(F.col("place") / size))
    inner = Window.partitionBy("term", "block").orderBy("doc_id")
    gaps = placed.withColumn("gap", F.col("doc_id") - F.lag("doc_id").over(inner))
    blocks = gaps.groupBy("term", "block").agg(F.count("*").alias("docs"), F.max("gap").alias("_inner"), F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"))
    before = F.coalesce(F.lag("_last").over(Window.partitionBy("term").orderBy("block")), F.lit(0))
    return blocks.withColumn("max_gap", F.greatest(F.coalesce(F.col("_inner"), F.lit(0)), F.col("_first") - before)).select(
        "term", "block", "docs", "max_gap", F.when(F.col("max_gap") == 0, 0).otherwise(F.length(F.bin("max_gap"))).cast("bigint").alias("bit_width")
    )


def live(docs: DataFrame, tombstones: DataFrame, key: str = "external_id") -> DataFrame:
    """IB-14: documents whose last action is no deletion. tombstones: key, action (delete/undelete), at."""
    last = tombstones.groupBy(key).agg(F.max_by("action", "at").alias("_last")).where("_last = 'delete'")
    return docs.join(last, key, "left_anti")


def merge_segments(segments: list[DataFrame], tombstones: DataFrame | None = None) -> DataFrame:
    """IB-17: one segment from several; deleted records dropped, documents ranked anew.

    Each segment: external_id, terms, static_rank, length, analyzer. Mixed analyzers are refused.
    """
    everything = segments[0]
    for s in segments[1:]:
        everything = everything.unionByName(s)
    if "analyzer" in everything.columns:
        kinds = [r[0] for r in everything.select("analyzer").distinct().limit(2).collect()]
        if len(kinds) > 1:
            raise ValueError(f"segments of different analyzers can't be merged: {sorted(map(str, kinds))}")
    if tombstones is not None:
        everything = live(everything, tombstones)
    return assign_doc_ids(everything)


def should_merge(segment_count: int, dead: int, total: int) -> bool:
    """IB-18."""
    return segment_count > MERGE_SEGMENTS or (total > 0 and dead / total > MERGE_DEAD)


def merge_due(segments: Column, dead: Column, total: Column) -> Column:
    """IB-18 by columns."""
    return (segments > MERGE_SEGMENTS) | F.coalesce((total > 0) & (dead / total > MERGE_DEAD), F.lit(False))


def merge_corpus_stats(stats: DataFrame) -> DataFrame:
    """IB-19: doc_count, avg_length over segments."""
    return stats.agg(F.sum("doc_count").alias("doc_count"), (F.sum(F.col("avg_length") * F.col("doc_count")) / F.sum("doc_count")).alias("avg_length"))


def front_coding(terms: DataFrame, size: int = 16) -> DataFrame:
    """IB-13 as a metric: per block of `size` sorted terms the bytes plain and front-coded."""
    ranked = global_row_number(terms.select("term"), [F.asc("term")], "n").withColumn("block", F.floor(F.col("n") / size))
    before = F.lag("term").over(Window.partitionBy("block").orderBy("n"))
    shared = F.coalesce(F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("term"), F.lit(1))), lambda i: F.substring("term", F.lit(1), i) == F.substring(F.col("_before"), F.lit(1), i))), F.lit(0))
    coded = ranked.withColumn("_before", F.coalesce(before, F.lit(""))).withColumn("_shared", F.when(F.length("term") == 0, 0).otherwise(F.least(shared, F.length("_before"))))
    return coded.groupBy("block").agg(F.count("*").alias("terms"), F.sum(F.length("term")).alias("plain_chars"), F.sum(F.length("term") - F.col("_shared")).alias("coded_chars"))


# --- fielded documents -------------------------------------------------------------------------------


def fields_signature(fields: Column) -> Column:
    """Field and term names in their stored order: orders the versions of a repeated record."""
    return F.array_join(F.transform(F.map_entries(fields), lambda f: F.concat(f["key"], F.lit(":"), F.array_join(F.map_keys(f["value"]), ","))), ";")


def fielded_records(df: DataFrame) -> DataFrame:
    """external_id, fields, static_rank, quality, pagerank: one row per record, the version with the smallest signature; null scores are 0."""
    zero = lambda c: F.coalesce(F.max(c), F.lit(0.0)).alias(c)
    return df.where("external_id is not null").groupBy("external_id").agg(F.min_by("fields", fields_signature(F.col("fields"))).alias("fields"), zero("static_rank"), zero("quality"), zero("pagerank"))


def field_postings(docs: DataFrame) -> DataFrame:
    """IB-21: external_id, field, term, tf."""
    fields = docs.select("external_id", F.explode("fields").alias("field", "terms"))
    return fields.select("external_id", "field", F.explode("terms").alias("term", "positions")).select("external_id", "field", "term", F.greatest(F.size("positions"), F.lit(1)).cast("bigint").alias("tf"))


def field_lengths(posts: DataFrame) -> DataFrame:
    """Q4: stored postings by document and field."""
    return posts.groupBy("external_id", "field").agg(F.sum("tf").alias("field_length"))


def field_averages(lengths: DataFrame) -> DataFrame:
    """IB-33: over the documents that have the field."""
    return lengths.groupBy("field").agg(F.avg("field_length").alias("avg_length"), F.count("*").alias("docs"))
