"""Ranking quality: NDCG with linear gain, its mean over queries, and a grid search over k1 and b."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .index import saturation
from .ranking import term_weights
from .ranks import top_k

GRID_K1 = (0.5, 0.9, 1.2, 1.5, 2.0)
GRID_B = (0.3, 0.5, 0.75, 1.0)


def ndcg(ranked: DataFrame, judgments: DataFrame, k: int = 10, keys: list[str] | None = None) -> DataFrame:
    """RK-16: keys, ndcg. ranked: keys, doc_id, rank; judgments: query_id, doc_id, grade. Queries without an ideal, or without results, get 0."""
    keys = keys or ["query_id"]
    gain = F.sum(F.coalesce(F.col("grade"), F.lit(0.0)) / F.log2(F.col("rank") + 1))
    got = ranked.where(F.col("rank") <= k).join(judgments, ["query_id", "doc_id"], "left").groupBy(*keys).agg(gain.alias("_dcg"))
    ideal = top_k(judgments, ["query_id"], [F.desc("grade"), F.asc("doc_id")], k, F.col("doc_id"), "_r").groupBy("query_id").agg(F.sum(F.col("grade") / F.log2(F.col("_r") + 1)).alias("_ideal"))
    value = F.when(F.coalesce(F.col("_ideal"), F.lit(0.0)) > 0, F.coalesce(F.col("_dcg"), F.lit(0.0)) / F.col("_ideal")).otherwise(F.lit(0.0))
    how = "full" if keys == ["query_id"] else "left"
    return got.join(ideal, "query_id", how).select(*keys, value.alias("ndcg"))


def mean_ndcg(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """RK-17."""
    return values.groupBy(*(by or [])).agg(F.avg("ndcg").alias("mean_ndcg"), F.count("*").alias("queries"))


def grid_search(posts: DataFrame, docs: DataFrame, queries: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
    """RK-18: k1, b, mean_ndcg of every combination, in one job: the grid is a fixed 20 rows."""
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("k1"), F.lit(c).alias("b")) for a in GRID_K1 for c in GRID_B]))
    hits = posts.select("term", "doc_id", "tf").join(F.broadcast(term_weights(posts, queries, docs)), "term").join(docs.select("doc_id", "length"), "doc_id").withColumn("_g", grid).select("*", "_g.k1", "_g.b")
    mean = F.when(F.col("avg_length") > 0, F.col("avg_length")).otherwise(F.lit(1.0))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (F.col("k1") + 1) / (F.col("tf") + F.col("k1") * (1 - F.col("b") + F.col("b") * F.col("length") / mean))
    scores = hits.groupBy("k1", "b", "query_id", "doc_id").agg(F.sum(part).alias("score"))
    ranked = top_k(scores, ["k1", "b", "query_id"], [F.desc(F.round("score", 9)), F.asc("doc_id")], k, F.col("doc_id"))
    return mean_ndcg(ndcg(ranked, judgments, k, ["k1", "b", "query_id"]), ["k1", "b"])


def lever(grid: DataFrame) -> DataFrame:
    """RK-19: what choosing the best instead of the worst setting gains."""
    return grid.agg(F.max("mean_ndcg").alias("best"), F.min("mean_ndcg").alias("worst"), (F.max("mean_ndcg") - F.min("mean_ndcg")).alias("gain"))


def interleave(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """RK-39: balanced interleaving of two lists (query_id, doc_id, rank): query_id, doc_id, place, team."""
    both = a.select("query_id", "doc_id", (F.col("rank") * 2 - 1).alias("_o"), F.lit("a").alias("team")).unionByName(b.select("query_id", "doc_id", (F.col("rank") * 2).alias("_o"), F.lit("b").alias("team")))
    first = both.groupBy("query_id", "doc_id").agg(F.min(F.struct("_o", "team")).alias("_m")).select("query_id", "doc_id", "_m._o", "_m.team")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_o"))).where(F.col("place") <= k).drop("_o")
