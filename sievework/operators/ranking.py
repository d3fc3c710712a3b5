"""Retrieval: BM25 exhaustive and pruned, BM25F, priors, fusion, collapse, proximity.

Scores of a query are sums over its terms as a multiset. Order: score
descending, then doc_id (or external id); rank 1 is best.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach, materialise, spread
from .index import idf, range_bounds, range_of, saturation
from .ranks import top_k

# Weight and length normalisation of each field.
FIELD_SPECS = {"anchors": (10.0, 0.5), "title": (8.0, 0.3), "headings": (3.0, 0.5), "url_text": (2.5, 0.3), "body": (1.0, 0.75), "meta_description": (0.5, 0.5)}
RRF_CONSTANT = 60
COLLAPSE_PER_HOST = 2


def query_table(spark, queries: dict[str, list[str]]) -> DataFrame:
    """query_id, term, qtf. Queries come from callers, so their number is bounded by the call."""
    rows: dict[tuple[str, str], int] = {}
    for q, terms in queries.items():
        for t in terms:
            rows[q, t] = rows.get((q, t), 0) + 1
    return spark.createDataFrame([(q, t, n) for (q, t), n in rows.items()], "query_id string, term string, qtf int")


#: Terms of all queries of a call that go into the scan as a filter; more are joined.
FILTER_TERMS = 5000


def of_terms(table: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of the query terms: the scan of a table sorted by term skips the rest."""
    terms = [r[0] for r in queries.select("term").distinct().limit(FILTER_TERMS + 1).collect()]  # the terms of the call's own queries
    return table.where(F.col("term").isin(terms)) if len(terms) <= FILTER_TERMS else table.join(queries.select("term").distinct(), "term", "left_semi")


def matching(posts: DataFrame, queries: DataFrame) -> DataFrame:
    return of_terms(posts, queries).join(F.broadcast(queries), "term")


def term_weights(posts: DataFrame, queries: DataFrame, docs: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """query_id, term, qtf, idf of the query terms that the dictionary holds."""
    if dictionary is None:
        df = of_terms(posts, queries).groupBy("term").agg(F.count("*").alias("_df"))
    else:
        df = of_terms(dictionary, queries).select("term", F.col("doc_freq").alias("_df"))
    size = docs.agg(F.count("*").alias("_n"), F.avg("length").alias("_avg"))
    return attach(queries.join(df, "term"), size).select("query_id", "term", "qtf", idf(F.col("_df"), F.col("_n")).alias("idf"), F.col("_avg").alias("avg_length"))


def with_lengths(posts: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings of a stored index carry the length of their document; others get it by a join."""
    return posts if "length" in posts.columns else posts.join(docs.select("doc_id", "length"), "doc_id")


def scored(posts: DataFrame, docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, dictionary: DataFrame | None = None) -> DataFrame:
    """RK-04 without the cut: query_id, doc_id, score."""
    weights = term_weights(posts, queries, docs, dictionary)
    hits = with_lengths(of_terms(posts, queries), docs).select("term", "doc_id", "tf", "length").join(F.broadcast(weights), "term")
    part = F.col("qtf") * F.col("idf") * saturation(F.col("tf"), F.col("length"), F.col("avg_length"), k1, b)
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def best(scores: DataFrame, k: int, tie: str = "doc_id") -> DataFrame:
    """RK-30: shard-wise top k, then the top k of all. Scores that agree to nine places tie."""
    return top_k(scores, ["query_id"], [F.desc(F.round("score", 9)), F.asc(tie)], k, F.col(tie))


def bm25_top_k(posts: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10, dictionary: DataFrame | None = None) -> DataFrame:
    return best(scored(posts, docs, queries, dictionary=dictionary), k)


def upper_bound(bounds: DataFrame, weights: DataFrame) -> DataFrame:
    """RK-03: query_id, range, _bound (no document of the range scores higher), _docs (that match one term at least)."""
    parts = bounds.join(F.broadcast(weights), "term").select("query_id", "range", (F.col("qtf") * F.col("idf") * F.col("max_saturation")).alias("_max"), "docs")
    return parts.groupBy("query_id", "range").agg(F.sum("_max").alias("_bound"), F.max("docs").alias("_docs"))


def bm25_pruned_top_k(posts: DataFrame, docs: DataFrame, queries: DataFrame, k: int = 10, bounds: DataFrame | None = None, dictionary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """RK-05/06: the same answer from the postings of fewer ranges of documents, and how much was read.

    The stored bounds of the query terms, a small table, give each range a score that none of its documents exceeds. The
    ranges of the highest bounds that hold k matches are scored and give a threshold; then only ranges whose bound reaches
    it are read. Their numbers go into the scan of the postings, so other row groups are skipped.
    """
    if bounds is None:
        known = attach(with_lengths(posts, docs), docs.agg(F.avg("length").alias("_avg"))).withColumn("range", range_of(F.col("doc_id")))
        bounds = range_bounds(known)
    posts = posts if "range" in posts.columns else posts.withColumn("range", range_of(F.col("doc_id")))
    weights = _held(term_weights(posts, queries, docs, dictionary))
    limits = materialise(upper_bound(of_terms(bounds, queries), weights), "bounds")
    ahead = F.coalesce(F.sum("_docs").over(Window.partitionBy("query_id").orderBy(F.desc("_bound"), "range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # k ranges hold k matches at least, so no more than k of each query are looked at
    heads = top_k(limits, ["query_id"], [F.desc("_bound"), F.asc("range")], k, F.col("range"), "_rank").withColumn("_ahead", ahead).where(F.col("_ahead") < k)
    own = of_terms(posts, queries)
    first = _ranges_scored(own, docs, _held(heads.select("query_id", "range", "_docs")), weights)
    kth = best(first, k).groupBy("query_id").agg(F.min("score").alias("_kth"), F.count("*").alias("_found"))
    threshold = kth.select("query_id", F.when(F.col("_found") >= k, F.col("_kth")).otherwise(F.lit(0.0)).alias("_theta"))
    kept = _held(limits.join(F.broadcast(threshold), "query_id").where(F.col("_bound") >= F.col("_theta") - 1e-9).select("query_id", "range", "_docs"))
    scores = _ranges_scored(own, docs, kept, weights)
    per = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(f"ranges_{name}"), F.sum("_docs").alias(f"docs_{name}"))
    stats = per(limits, "all").join(per(kept, "read"), "query_id").join(scores.groupBy("query_id").agg(F.count("*").alias("scored_docs")), "query_id")
    return best(scores, k), stats.withColumn("skip_ratio", F.lit(1.0) - F.col("ranges_read") / F.col("ranges_all"))


#: Rows that the driver holds between two steps of a pruned search, and puts into the scan as a filter; more go by a table.
HELD_ROWS = 10_000


def _held(df: DataFrame) -> DataFrame:
    rows = df.limit(HELD_ROWS + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= HELD_ROWS else materialise(df, "held")


def _ranges_scored(posts: DataFrame, docs: DataFrame, ranges: DataFrame, weights: DataFrame) -> DataFrame:
    """query_id, doc_id, score over the postings of some ranges. ranges: query_id, range."""
    wanted = [r[0] for r in ranges.select("range").distinct().limit(HELD_ROWS + 1).collect()]
    few = len(wanted) <= HELD_ROWS
    near = posts.where(F.col("range").isin(wanted)) if few else posts
    pairs = ranges.select("query_id", "range")
    hits = with_lengths(near, docs).select("term", "doc_id", "tf", "length", "range").join(F.broadcast(weights), "term").join(F.broadcast(pairs) if few else pairs, ["query_id", "range"])
    part = F.col("qtf") * F.col("idf") * saturation(F.col("tf"), F.col("length"), F.col("avg_length"))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


# --- fields ------------------------------------------------------------------------------------------


def field_contributions(posts: DataFrame, lengths: DataFrame, averages: DataFrame, queries: DataFrame) -> DataFrame:
    """RK-08: query_id, qtf, external_id, field, term, weight, contribution."""
    spark = posts.sparkSession
    specs = spark.createDataFrame([(f, w, b) for f, (w, b) in FIELD_SPECS.items()], "field string, weight double, b double")
    hits = posts.join(F.broadcast(queries), "term").join(lengths, ["external_id", "field"]).join(F.broadcast(averages.select("field", F.col("avg_length").alias("_avg"))), "field").join(F.broadcast(specs), "field")
    mean = F.when(F.col("_avg") > 0, F.col("_avg")).otherwise(F.lit(1.0))
    norm = F.lit(1.0) - F.col("b") + F.col("b") * F.col("field_length") / mean
    return hits.select("query_id", "qtf", "external_id", "field", "term", "weight", F.when(norm > 0, F.col("tf") / norm).otherwise(F.col("tf")).alias("contribution"))


def bm25f_scores(contributions: DataFrame, posts: DataFrame, total: DataFrame, k1: float = 1.2, per_field: bool = False) -> DataFrame:
    """RK-09/10: fields summed, then saturated once; RK-11 (per_field): saturated field by field, kept as the contrast."""
    c = F.col("contribution")
    inner = F.sum(F.col("weight") * (c * (k1 + 1) / (c + k1) if per_field else c))
    pseudo = contributions.groupBy("query_id", "external_id", "term").agg(inner.alias("_p"), F.max("qtf").alias("qtf"))
    df = posts.join(F.broadcast(contributions.select("term").distinct()), "term").groupBy("term").agg(F.count_distinct("external_id").alias("_df"))
    rows = attach(pseudo.join(F.broadcast(df), "term"), total)  # _n
    value = F.col("_p") if per_field else F.col("_p") * (k1 + 1) / (F.col("_p") + k1)
    return rows.groupBy("query_id", "external_id").agg(F.sum(F.col("qtf") * idf(F.col("_df"), F.col("_n")) * value).alias("score"))


def with_prior(scores: DataFrame, docs: DataFrame, alpha: float = 1.0, beta: float = 0.5) -> DataFrame:
    """RK-14: plus alpha ln(1 + pagerank) + beta quality, negative ones counting as 0."""
    joined = scores.join(docs.select("external_id", "pagerank", "quality"), "external_id", "left")
    zero = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))
    return joined.withColumn("text_score", F.col("score")).withColumn("score", F.col("score") + alpha * F.log1p(zero("pagerank")) + beta * zero("quality")).drop("pagerank", "quality")


def multiplicative_prior(scores: DataFrame, docs: DataFrame, alpha: float = 1.0) -> DataFrame:
    """RK-15, the rejected way: times (1 + alpha ln(1 + pagerank))."""
    joined = scores.join(docs.select("external_id", "pagerank"), "external_id", "left")
    return joined.withColumn("score", F.col("score") * (1 + alpha * F.log1p(F.greatest(F.coalesce(F.col("pagerank"), F.lit(0.0)), F.lit(0.0))))).drop("pagerank")


# --- anchors -----------------------------------------------------------------------------------------


def aggregate_anchors(anchors: DataFrame, cap: int = 1, min_domains: int = 3) -> DataFrame:
    """IB-22: target, term, domains, weight. anchors: target, source_domain, term."""
    per = anchors.where("target is not null and term is not null").groupBy("target", "term", "source_domain").agg(F.count("*").alias("_n"))
    rows = per.groupBy("target", "term").agg(F.sum(F.least("_n", F.lit(cap))).alias("_sum"), F.count("source_domain").alias("domains"))
    few = F.greatest(F.lit(1), F.floor(F.col("_sum") * F.col("domains") / min_domains))
    return rows.select("target", "term", "domains", F.when(F.col("domains") < min_domains, few).otherwise(F.col("_sum")).cast("bigint").alias("weight"))


# --- proximity ---------------------------------------------------------------------------------------


def phrase_matches(posts: DataFrame, first: str, second: str, slop: int = 0) -> DataFrame:
    """RK-25: doc_id, matches of second after first with at most slop words between."""
    a = posts.where(F.col("term") == first).select("doc_id", F.col("positions").alias("_a"))
    b = posts.where(F.col("term") == second).select("doc_id", F.col("positions").alias("_b"))
    count = F.aggregate("_a", F.lit(0), lambda acc, x: acc + F.size(F.filter("_b", lambda y: (y > x) & (y <= x + 1 + slop))))
    return a.join(b, "doc_id").withColumn("matches", count.cast("bigint")).where("matches > 0").select("doc_id", "matches")


def sequential_dependence(posts: DataFrame, first: str, second: str, window: int = 8, weights: tuple[float, float, float] = (0.85, 0.10, 0.05)) -> DataFrame:
    """RK-24: doc_id, unigrams, ordered pairs, pairs within a window, mixed score of log-dampened counts."""
    a = posts.where(F.col("term") == first).select("doc_id", F.col("positions").alias("_a"))
    b = posts.where(F.col("term") == second).select("doc_id", F.col("positions").alias("_b"))
    pairs = lambda test: F.aggregate("_a", F.lit(0), lambda acc, x: acc + F.size(F.filter("_b", lambda y: test(x, y))))
    rows = a.join(b, "doc_id").select(
        "doc_id", (F.size("_a") + F.size("_b")).cast("bigint").alias("unigrams"), pairs(lambda x, y: y == x + 1).cast("bigint").alias("ordered"), pairs(lambda x, y: F.abs(y - x) < window).cast("bigint").alias("unordered")
    )
    u, o, w = weights
    return rows.withColumn("score", u * F.log1p("unigrams") + o * F.log1p("ordered") + w * F.log1p("unordered"))


# --- result lists ------------------------------------------------------------------------------------


def reciprocal_rank_fusion(lists: list[DataFrame], key: str, k: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """RK-31: lists of (query_id, key, rank)."""
    every = lists[0].select("query_id", key, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", key, "rank"))
    fused = every.groupBy("query_id", key).agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("score"))
    return best(fused, k, key)


def collapse_hosts(ranked: DataFrame, host: str, per_host: int = COLLAPSE_PER_HOST) -> DataFrame:
    """RK-27: at most per_host results of a host and query."""
    w = Window.partitionBy("query_id", host).orderBy(F.desc("score"), "doc_id")
    return ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_host).drop("_r")


def page_of(ranked: DataFrame, offset: int, limit: int) -> DataFrame:
    """RK-35: limit at most 50, offset at most 1000."""
    limit, offset = min(limit, 50), min(offset, 1000)
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def after_cursor(scores: DataFrame, score: float, key_value, key: str, limit: int) -> DataFrame:
    """RK-35: keyset paging behind (score, key)."""
    s, at = F.round("score", 9), round(score, 9)
    return best(scores.where((s < at) | ((s == at) & (F.col(key) > key_value))), limit, key)


def validate_query(text: str, max_chars: int = 512, max_terms: int = 32) -> list[str]:
    """RK-36: the terms, or ValueError."""
    if len(text) > max_chars:
        raise ValueError("the query is too long")
    terms = text.split()
    if len(terms) > max_terms:
        raise ValueError("the query has too many terms")
    if any(t[0] in "*?" for t in terms):
        raise ValueError("a term may not begin with a wildcard")
    return terms


def query_problem(text: Column, max_chars: int = 512, max_terms: int = 32) -> Column:
    """RK-36 by columns: what is wrong with a query, null where nothing is."""
    terms = F.filter(F.split(F.trim(text), r"\s+"), lambda t: t != "")
    return (
        F.when(F.length(text) > max_chars, "too_long").when(F.size(terms) > max_terms, "too_many_terms")
        .when(F.exists(terms, lambda t: F.substring(t, 1, 1).isin("*", "?")), "leading_wildcard")
    )


# --- vectors -----------------------------------------------------------------------------------------


def cosine_knn(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """RK-32: query_id, vec_id, similarity, rank. The stated queries meet all rows block-wise in Arrow batches; a block's k best leave the task.

    queries: query_id, embedding. They are shipped to every task, so they are counted first; more than MAX_QUERIES go in rounds.
    """
    import numpy as np
    import pandas as pd

    MAX_QUERIES = 20_000
    total = queries.count()
    rounds = max(1, -(-total // MAX_QUERIES))
    out = None
    for r in range(rounds):
        part = queries if rounds == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r)
        rows = part.where("embedding is not null").toPandas()
        ids = rows["query_id"].to_numpy()
        q = np.stack(rows["embedding"].to_list()).astype(np.float64) if len(rows) else np.zeros((0, 1))
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches, shared=shared):
            ids, q = shared.value
            for pdf in batches:
                if not len(ids) or not len(pdf):
                    continue
                v = np.stack(pdf["embedding"].to_list()).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                names = pdf["vec_id"].to_numpy()
                for s in range(0, len(ids), block):
                    sim = np.round(q[s : s + block] @ v.T, 9)
                    order = np.lexsort((np.broadcast_to(names, sim.shape), -sim), axis=1)[:, : k + 1]
                    rows = np.repeat(np.arange(sim.shape[0]), order.shape[1])
                    cols = order.ravel()
                    yield pd.DataFrame({"query_id": ids[s + rows], "vec_id": names[cols], "similarity": sim[rows, cols]})

        found = spread(vectors.where("embedding is not null").select("vec_id", "embedding")).mapInPandas(run, "query_id bigint, vec_id bigint, similarity double")
        out = found if out is None else out.unionByName(found)
    return top_k(out.where("query_id <> vec_id"), ["query_id"], [F.desc("similarity"), F.asc("vec_id")], k, F.col("vec_id"))


# --- clicks, snippets, freshness ----------------------------------------------------------------------


def snippet(text: Column, terms: list[str], size: int = 160) -> Column:
    """RK-34: the sentence with the most query terms (the earliest of equal ones), cut to size, terms in brackets."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)
    hits = lambda s: sum((F.when(F.lower(s).contains(t), F.lit(1)).otherwise(F.lit(0)) for t in terms), F.lit(0))
    rated = F.transform(sentences, lambda s, i: F.struct((-hits(s)).alias("m"), i.alias("i"), s.alias("s")))
    out = F.substring(F.array_min(rated)["s"], 1, size)
    for t in terms:
        out = F.regexp_replace(out, f"(?i)({re.escape(t)})", "[$1]")
    return out


def recency(age_days: Column, half_life: float = 30.0) -> Column:
    """RK-41: 1 now, a half after half_life days."""
    return F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0.0)) / half_life)


def examination(position: Column) -> Column:
    """RK-33: chance that a result at a position is looked at."""
    return F.lit(1.0) / F.log2(position + 1)
