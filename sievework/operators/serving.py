"""What stands around a ranking: filters, overlays, layers, staged reranking, clicks, snippets, envelopes; and frontier upkeep by time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import chunked_last, top_k

# Fixed values.
BANDS = 1024
GONE_CONFIRMATIONS = 3
ANCHORS_PER_TARGET = 1000
STAGES = (1000, 200, 50, 10)


def deny(results: DataFrame, denied: DataFrame, key: str, multipliers: DataFrame | None = None, host: str = "host") -> DataFrame:
    """RK-28: denied keys leave; scores of demoted hosts are multiplied (host, multiplier)."""
    kept = results.join(denied.select(key), key, "left_anti")
    if multipliers is None:
        return kept
    return kept.join(multipliers, host, "left").withColumn("score", F.col("score") * F.coalesce("multiplier", F.lit(1.0))).drop("multiplier")


def layered(layers: list[DataFrame], key: str) -> DataFrame:
    """IB-32: rows of several layers, newest first; of a key only the newest layer's rows count."""
    every = None
    for k, layer in enumerate(layers):
        part = layer.withColumn("layer", F.lit(k))
        every = part if every is None else every.unionByName(part)
    newest = every.groupBy(key).agg(F.min("layer").alias("layer"))
    return every.join(newest, [key, "layer"], "left_semi")


def staged_rerank(candidates: DataFrame, scorers: list[Column], sizes: tuple[int, ...] = STAGES, key: str = "doc_id") -> DataFrame:
    """RK-40: each stage scores what the one before has left, and keeps fewer. candidates: query_id, key, features."""
    rows = candidates
    for scorer, size in zip(scorers, sizes):
        rows = top_k(rows.withColumn("score", scorer).drop("rank"), ["query_id"], [F.desc(F.round("score", 9)), F.asc(key)], size, F.col(key))
    return rows


def personalise(results: DataFrame, boosts: DataFrame, key: str = "doc_id") -> DataFrame:
    """RK-42: a user's boosts reorder the results of a shared cache; nothing is added. A boost of null removes."""
    joined = results.join(boosts.select("query_id", key, F.coalesce("boost", F.lit(float("-inf"))).alias("_b")), ["query_id", key], "left").withColumn("score", F.col("score") + F.coalesce("_b", F.lit(0.0))).where("_b is null or _b > double('-infinity')")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)  # one result page
    return joined.drop("_b", "rank").withColumn("rank", F.row_number().over(w))


def click_model(impressions: DataFrame) -> DataFrame:
    """RK-33: item, shown, clicks, relevance: clicks over the examinations that the positions promise. impressions: item, position (from 1), clicked."""
    seen = F.sum(F.lit(1.0) / F.log2(F.col("position") + 1))
    return impressions.groupBy("item").agg(F.count("*").alias("shown"), F.sum(F.col("clicked").cast("bigint")).alias("clicks"), F.least(F.lit(1.0), F.sum(F.col("clicked").cast("double")) / seen).alias("relevance"))


def envelope(results: DataFrame, totals: DataFrame, generation: str, page: int) -> DataFrame:
    """RK-43: one row per query: total_estimate, page, results in order, meta."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "score"))), lambda r: r)
    return results.groupBy("query_id").agg(listed.alias("results")).join(totals, "query_id", "right").select(
        "query_id", F.col("total").alias("total_estimate"), F.lit(page).alias("page"), F.coalesce("results", F.array().cast("array<struct<rank:int,doc_id:bigint,score:double>>")).alias("results"),
        F.struct(F.lit(generation).alias("generation"), F.lit(False).alias("partial")).alias("meta"),
    )


def anchor_shuffle(links: DataFrame, per_target: int = ANCHORS_PER_TARGET) -> DataFrame:
    """IB-24: target, source, anchor: at most so many links a target, by the hash of the source; a hot target is cut shard by shard first."""
    return top_k(links.where("target is not null and source is not null"), ["target"], [F.asc(F.xxhash64("source")), F.asc("source"), F.asc("anchor")], per_target, F.col("source")).drop("rank")


# --- frontier upkeep ---------------------------------------------------------------------------------


def priority_score(authority: Column, depth: Column, changes: Column, age_days: Column, links: Column, demand: Column) -> Column:
    """CR-36: six terms, each from 0 to 1, weighted to 1."""
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0))))
    return (
        0.30 * unit(authority) + 0.15 * F.lit(1.0) / (1 + F.greatest(F.coalesce(depth, F.lit(0)), F.lit(0))) + 0.20 * unit(changes) + 0.10 * unit(age_days / 30) + 0.15 * unit(F.log1p(F.coalesce(links, F.lit(0))) / 10) + 0.10 * unit(demand)
    )


def band(score: Column, bands: int = BANDS) -> Column:
    """0 is the most urgent."""
    return F.greatest(F.lit(0), F.least(F.lit(bands - 1), F.floor((F.lit(1.0) - score) * bands))).cast("int")


def confirmed_gone(runs: DataFrame, status: DataFrame, confirmations: int = GONE_CONFIRMATIONS) -> DataFrame:
    """CR-39: urls to remove: a 410 at once, other gone answers after so many in a row up to the last visit. runs: of crawl.outcome_runs; status: url, status."""
    last = runs.groupBy("url").agg(F.max_by(F.struct("outcome", "length"), F.struct("last_at", "first_at")).alias("_l"))
    repeated = last.where((F.col("_l.outcome") == "gone") & (F.col("_l.length") >= confirmations)).select("url")
    return repeated.union(status.where("status = 410").select("url")).distinct()


def redirect_canonical(hops: DataFrame) -> DataFrame:
    """CR-40: permanent redirects name the target, temporary ones the source."""
    return hops.select("url", F.when(F.col("redirect_permanent"), F.col("redirect_target")).otherwise(F.col("url")).alias("canonical"))


def as_of(requests: DataFrame, facts: DataFrame, key: str, ttl_s: Column) -> DataFrame:
    """CR-25/27: for each request (key, at, id) the newest fact (key, at, value, ok) before it that has not expired; ttl_s may depend on ok.

    One union instead of a range join, ordered hour by hour, so that a hot host or origin is spread over its hours.
    """
    both = requests.select(key, "at", "id", F.lit(None).cast("string").alias("value"), F.lit(None).cast("boolean").alias("ok"), F.lit(1).alias("_kind")).unionByName(
        facts.select(key, "at", F.lit(None).cast("bigint").alias("id"), F.col("value").cast("string").alias("value"), "ok", F.lit(0).alias("_kind"))
    )
    hour = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / 3_600_000_000)
    fact = F.when(F.col("_kind") == 0, F.struct(F.col("at").alias("t"), "value", "ok"))
    rows = chunked_last(both, [key], ["at", "_kind"], hour, fact, "_f").where("_kind = 1").withColumn("ok", F.col("_f.ok"))
    fresh = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("_f.t").cast("timestamp"))) <= ttl_s.cast("bigint") * 1_000_000
    return rows.select(key, "at", "id", F.when(fresh, F.col("_f.value")).alias("value"), F.coalesce(fresh, F.lit(False)).alias("hit"))


def release(leases: DataFrame, releases: DataFrame, now: Column) -> DataFrame:
    """CR-15: leases (url, token, until) that still hold: not released by their own token, not expired."""
    return leases.join(releases.select("url", "token"), ["url", "token"], "left_anti").where(F.col("until") > now)


def discovery_split(tasks: DataFrame, is_known: Column, by: str = "domain") -> DataFrame:
    """CR-38: refreshes and discoveries by host."""
    return tasks.where(F.col(by).isNotNull()).groupBy(by).agg(F.count_if(is_known).alias("refreshes"), F.count_if(~is_known).alias("discoveries"))


def scored_in_batches(rows: DataFrame, scorer: Callable, features: list[str], name: str = "score") -> DataFrame:
    """RK-40 with a model from Python: scorer gets a pandas frame of features and gives numbers, batch by batch."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import DoubleType

    @pandas_udf(DoubleType())
    def run(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(scorer(frame), dtype="float64")

    return rows.withColumn(name, run(F.struct(*features)))
