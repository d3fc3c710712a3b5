"""How distinctive is a term of a record: residual inverse document frequency times record frequency.

residual(t) = -log2(df/N) + log2(1 - exp(-cf/N)): the observed inverse document
frequency minus what a Poisson spread of the term's cf occurrences over N
records would give. score = occurrences in the record times residual. Terms
concentrated in few records score high, evenly spread ones about zero.

Defined results
* null id: the record is left out. Null or empty terms: the record has no rows and does not count in N.
* a repeated record (same id): counts once; of several versions the one with the smallest hash is kept.
* null or empty position lists: the term occurs once (it is listed).
* null term names: left out.
* ties of the score: the smaller term comes first.
* an empty table: no rows. Further columns: ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach

#: A term in more than N / COMMON records is common. There are at most COMMON times the mean record size of them, whatever N.
COMMON = 1000


def term_counts(terms: Column) -> Column:
    """map<term, positions> as array<struct<term, tf>>."""
    return F.transform(F.map_entries(terms), lambda e: F.struct(e["key"].alias("term"), F.greatest(F.coalesce(F.size(e["value"]), F.lit(1)), F.lit(1)).cast("bigint").alias("tf")))


def field_counts(fields: Column) -> Column:
    """map<field, map<term, positions>> as array<struct<term, tf>>, one entry per field and term."""
    return F.flatten(F.transform(F.filter(F.map_values(fields), lambda m: m.isNotNull()), term_counts))


def record_terms(df: DataFrame, id_col: str, entries: Column, distinct_terms: bool = False) -> DataFrame:
    """_id, term, tf, _first (true on one row of each record): one row per record and term, repeated records once. distinct_terms: no record has two entries of a term, as those of one map."""
    rows = df.select(F.col(id_col).cast("string").alias("_id"), F.filter(entries, lambda x: x["term"].isNotNull()).alias("_e")).where("_id is not null and size(_e) > 0")
    once = rows.groupBy("_id").agg(F.min_by("_e", F.xxhash64("_e")).alias("_e"))
    long = once.select("_id", F.posexplode("_e").alias("_p", "_x")).select("_id", F.col("_x.term").alias("term"), F.col("_x.tf").alias("tf"), (F.col("_p") == 0).alias("_first"))
    return long if distinct_terms else long.groupBy("_id", "term").agg(F.sum("tf").alias("tf"), F.max("_first").alias("_first"))


def residual_idf(df: Column, cf: Column, n: Column) -> Column:
    return -F.log2(df / n) + F.log2(-F.expm1(-cf / n))


def scored_terms(terms: DataFrame) -> DataFrame:
    """_id, term, tf, df, cf, residual, score for the rows of record_terms."""
    size = terms.agg(F.count_if("_first").cast("double").alias("_n"))
    stats = attach(terms.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), size)
    stats = stats.withColumn("residual", residual_idf(F.col("df"), F.col("cf"), F.col("_n")))
    common = F.col("df") > F.col("_n") / COMMON
    # Common terms would be hot join keys; their table is bounded by COMMON times the mean record size and is broadcast.
    frequent = F.broadcast(stats.where(common).withColumnRenamed("term", "_t").select("_t", "df", "cf", "residual"))
    rare = stats.where(~common).select(F.col("term").alias("_t"), "df", "cf", "residual")
    first = terms.drop("_first").join(frequent, F.col("term") == F.col("_t"), "left").drop("_t")
    known = first.where("df is not null")
    rest = first.where("df is null").drop("df", "cf", "residual").join(rare, F.col("term") == F.col("_t")).drop("_t")
    return known.unionByName(rest).withColumn("score", F.col("tf") * F.col("residual"))


def most_distinctive(scored: DataFrame, k: int = 1) -> DataFrame:
    """The k highest-scored terms of each record, ties by term."""
    if k == 1:
        best = F.min_by(F.struct("term", "tf", "df", "cf", "residual", "score"), F.struct(-F.col("score"), F.col("term")))
        return scored.groupBy("_id").agg(best.alias("_b")).select("_id", "_b.*")
    rank = F.row_number().over(Window.partitionBy("_id").orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)
