"""Searches with conditions: filters, boolean queries, phrases of any length, rare-term rules, fused lists, ranked snippets.

Defined results: null texts give no postings; a null filter allows everything; a
query without terms has no hits; ties as in ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import simple_words
from ..session import attach
from .index import idf, saturation
from .ranking import best, of_terms

COMMON_SHARE = 0.1


def text_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term, tf, positions, length of every text, by columns. A group is one document's one word."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), simple_words(F.col(text_col)).alias("_w"))
    tokens = rows.select("doc_id", F.size("_w").cast("bigint").alias("length"), F.posexplode("_w").alias("_p", "term"))
    return tokens.groupBy("doc_id", "term", "length").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("_p")).alias("positions"))


def fielded_texts(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """IB-34: id, field, terms (map of positions) of several text columns; empty fields are skipped."""
    out = None
    for f in fields:
        part = text_postings(docs.where(F.trim(F.col(f)) != ""), id_col, f).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("terms"))
        part = part.select(F.col("doc_id").alias(id_col), F.lit(f).alias("field"), "terms")
        out = part if out is None else out.unionByName(part)
    return out


def allowed(docs: DataFrame, filters: DataFrame) -> DataFrame:
    """RK-38/IB-31: query_id, doc_id that a query's filters let through, before anything is scored.

    docs: doc_id, site, lang, at, safe; filters: query_id, site, lang, since, safe_only, each null or false for any. The filters are the call's own.
    """
    f = F.broadcast(filters.select("query_id", F.col("site").alias("_s"), F.col("lang").alias("_l"), "since", "safe_only"))
    free = lambda want, have: F.col(want).isNull() | (F.col(want) == F.col(have))
    test = free("_s", "site") & free("_l", "lang") & (F.col("since").isNull() | (F.col("at") >= F.col("since"))) & (~F.coalesce("safe_only", F.lit(False)) | F.coalesce("safe", F.lit(True)))
    return docs.join(f, test).select("query_id", "doc_id")


def weighted(posts: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id, term, part: what each query term gives each document. posts with length; statistics over all documents."""
    own = of_terms(posts, queries)
    df = own.groupBy("term").agg(F.count("*").alias("_df"))
    size = docs.agg(F.count("*").alias("_n"), F.avg("length").alias("_avg"))
    weights = attach(queries.join(df, "term"), size)
    hits = own.join(F.broadcast(weights), "term")
    return hits.select("query_id", "doc_id", "term", (F.col("qtf") * idf(F.col("_df"), F.col("_n")) * saturation(F.col("tf"), F.col("length"), F.col("_avg"))).alias("part"), (F.col("_df") / F.col("_n")).alias("df_share"))


def filtered_top_k(posts: DataFrame, docs: DataFrame, queries: DataFrame, filters: DataFrame, k: int = 10) -> DataFrame:
    """RK-38: the best documents among those that the filters allow."""
    parts = weighted(posts, queries, docs).join(allowed(docs, filters), ["query_id", "doc_id"], "left_semi")
    return best(parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")), k)


def boolean_matches(field_posts: DataFrame, clauses: DataFrame, key: str = "external_id", cross_fields: bool = True) -> DataFrame:
    """RK-26: query_id, key, matched of records that hold every must term and no must_not term, and at least `least` of the should terms.

    clauses: query_id, term, clause (must, should, must_not, filter), least. cross_fields: a must term may stand in any field;
    else all of them must stand in one. A filter term is required like a must term and does not count as matched.
    """
    c = clauses.select("query_id", "term", "clause", "least")
    own = of_terms(field_posts, clauses).join(F.broadcast(c), "term")
    where = ["query_id", key] if cross_fields else ["query_id", key, "field"]
    per = own.select(*where, "term", "clause", "least").distinct().groupBy(*where).agg(
        F.count_if(F.col("clause").isin("must", "filter")).alias("_must"), F.count_if(F.col("clause") == "should").alias("_should"), F.count_if(F.col("clause") == "must").alias("_counted"), F.max("least").alias("_least"),
    )
    need = clauses.groupBy("query_id").agg(F.count_if(F.col("clause").isin("must", "filter")).alias("_need"))
    ok = per.join(F.broadcast(need), "query_id").where("_must = _need and _should >= _least")
    found = ok.groupBy("query_id", key).agg(F.max(F.col("_counted") + F.col("_should")).alias("matched"))
    banned = own.where("clause = 'must_not'").select("query_id", key).distinct()
    return found.join(banned, ["query_id", key], "left_anti")


def rare_required(parts: DataFrame, share: float = COMMON_SHARE) -> DataFrame:
    """TX-26: query_id, doc_id, score of documents that hold all rare terms of a query; terms in more than `share` of the documents are optional. parts as weighted gives them."""
    need = parts.where(F.col("df_share") <= share).groupBy("query_id").agg(F.count_distinct("term").alias("_need"))
    per = parts.groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"), F.count_if(F.col("df_share") <= share).alias("_have"))
    return per.join(F.broadcast(need), "query_id", "left").where("_have = coalesce(_need, 0)").select("query_id", "doc_id", "score")


def _positions(posts: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id and the positions of each term, of documents that hold all of them."""
    wanted = list(dict.fromkeys(terms))
    per = posts.where(F.col("term").isin(wanted)).groupBy("doc_id").pivot("term", wanted).agg(F.first("positions"))
    ready = per.where(" and ".join(f"`{t}` is not null" for t in wanted))
    return ready.select("doc_id", *[F.col(f"`{t}`").alias(f"_p{k}") for k, t in enumerate(terms)])


def phrases(posts: DataFrame, terms: list[str], slop: int = 0) -> DataFrame:
    """RK-25: doc_id, matches of the terms one after the other, with at most slop words between two of them."""

    def after(ends: Column, places: str) -> Column:
        return F.flatten(F.transform(ends, lambda x: F.filter(F.col(places), lambda y: (y > x) & (y <= x + 1 + slop))))

    ends = F.col("_p0")
    for k in range(1, len(terms)):
        ends = after(ends, f"_p{k}")
    return _positions(posts, terms).select("doc_id", F.size(ends).cast("bigint").alias("matches")).where("matches > 0")


def dependence(posts: DataFrame, terms: list[str], window: int = 8, weights: tuple[float, float, float] = (0.85, 0.10, 0.05)) -> DataFrame:
    """RK-24 for any number of terms: unigrams of all, ordered and near pairs of terms that follow each other in the query."""
    pairs = lambda k, test: F.aggregate(f"_p{k}", F.lit(0), lambda acc, x: acc + F.size(F.filter(F.col(f"_p{k + 1}"), lambda y: test(x, y))))
    each = range(len(terms) - 1)
    unigrams = sum((F.size(f"_p{k}") for k in range(len(terms))), F.lit(0))
    ordered = sum((pairs(k, lambda x, y: y == x + 1) for k in each), F.lit(0))
    near = sum((pairs(k, lambda x, y: F.abs(y - x) < window) for k in each), F.lit(0))
    u, o, w = weights
    rows = _positions(posts, terms).select("doc_id", unigrams.cast("bigint").alias("unigrams"), ordered.cast("bigint").alias("ordered"), near.cast("bigint").alias("unordered"))
    return rows.withColumn("score", u * F.log1p("unigrams") + o * F.log1p("ordered") + w * F.log1p("unordered"))


def head_bigrams(docs: DataFrame, top: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """IB-31: pair, documents: the most frequent pairs of words that follow each other, which a phrase index keeps postings of."""
    words = F.transform(F.array(simple_words(F.col(text_col))), lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(w[i], F.lit(" "), w[i + 1]))))[0]
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_d"), F.explode(F.array_distinct(words)).alias("pair"))
    return rows.groupBy("pair").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "pair").limit(top)


def ranked_snippet(text: Column, terms: list[str], size: int = 160) -> Column:
    """RK-34: struct<sentence, score>: coverage of the terms x how near they stand x how early the sentence is; the earlier of equal ones.

    coverage: share of the terms; nearness: terms found by the words from the first to the last of them; earliness: 1 / (1 + ln(1 + number)).
    """
    wanted = [t.lower() for t in dict.fromkeys(terms)]
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)

    def rate(s: Column, i: Column) -> Column:
        words = simple_words(s)
        places = F.array_compact(F.array(*[F.nullif(F.array_position(words, t), F.lit(0).cast("bigint")) for t in wanted]))
        found = F.size(places)
        span = F.array_max(places) - F.array_min(places) + 1
        return F.when(found > 0, found / F.lit(float(len(wanted))) * (found / span) / (1 + F.log1p(i.cast("double")))).otherwise(F.lit(0.0))

    rated = F.transform(sentences, lambda s, i: F.struct((-F.round(rate(s, i), 9)).alias("m"), i.alias("i"), F.substring(s, 1, size).alias("s")))
    top = F.array_min(rated)
    return F.struct(top["s"].alias("sentence"), (-top["m"]).alias("score"))


def holdback(query_id: Column, share: float = 0.001) -> Column:
    """RK-29: a fixed share of queries that go to all tiers, whatever the first one has."""
    return F.pmod(F.conv(F.substring(F.md5(query_id), 1, 8), 16, 10).cast("bigint"), F.lit(1_000_000)) < int(share * 1_000_000)


def freshness_demand(events: DataFrame, key: str, day: str, recent: int = 7) -> DataFrame:
    """RK-41: key, recent, before, demand: the daily rate of the last days by that of all days before; above 1 the topic is in the news. events: key, day (a number)."""
    last = events.agg(F.max(day).alias("_last"), F.min(day).alias("_first"))
    rows = attach(events.where(F.col(key).isNotNull()).groupBy(key, day).agg(F.count("*").alias("_n")), last)
    is_new = F.col(day) > F.col("_last") - recent
    per = rows.groupBy(key, "_last", "_first").agg(F.coalesce(F.sum(F.when(is_new, F.col("_n"))), F.lit(0)).alias("recent"), F.coalesce(F.sum(F.when(~is_new, F.col("_n"))), F.lit(0)).alias("before"))
    old_days = F.greatest(F.col("_last") - recent - F.col("_first") + 1, F.lit(1))
    return per.select(key, "recent", "before", ((F.col("recent") / recent + 0.1) / (F.col("before") / old_days + 0.1)).alias("demand"))


def choose_language(length: Column, attribute: Column, model: Column, confidence: Column, short: int = 40, least: float = 0.55) -> Column:
    """HT-25: struct<language, confidence, source, disagreed>: short texts and unsure models leave it to the page's own attribute (0.25), else und."""
    known = attribute.isNotNull() & (attribute != "")
    named = F.when(known, attribute).otherwise("und")
    fallback = F.when(known, 0.25).otherwise(0.0)
    sure = (length >= short) & model.isNotNull() & (F.coalesce(confidence, F.lit(0.0)) >= least)
    return F.struct(
        F.when(sure, model).otherwise(named).alias("language"), F.when(sure, confidence).otherwise(fallback).alias("confidence"),
        F.when(sure, "model").when(known, "attribute").otherwise("none").alias("source"), (sure & known & (F.lower(attribute) != F.lower(model))).alias("disagreed"),
    )


def tier_of(rank: Column, quality: Column, traffic: Column, age_days: Column) -> Column:
    """IB-25: 0, 1 or 2 by rank, quality, traffic and freshness together."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = 0.5 * zero(rank) + 0.2 * zero(quality) + 0.2 * F.least(F.log1p(zero(traffic)) / 5, F.lit(1.0)) + 0.1 * F.pow(F.lit(0.5), F.coalesce(age_days, F.lit(365.0)) / 30)
    return F.when(score >= 0.5, 0).when(score >= 0.2, 1).otherwise(2)


def split_words(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """TX-22: query, first, second, strength of run-together words: the cut whose rarer part is the most frequent; the earlier cut of equal ones. queries: query."""
    cuts = queries.where("length(query) > 1").select("query", F.explode(F.sequence(F.lit(1), F.length("query") - 1)).alias("_at"))
    halves = cuts.select("query", "_at", F.expr("substring(query, 1, _at)").alias("first"), F.expr("substring(query, _at + 1)").alias("second"))
    one = dictionary.select(F.col("term").alias("first"), F.col("doc_freq").alias("_a"))
    two = dictionary.select(F.col("term").alias("second"), F.col("doc_freq").alias("_b"))
    rows = halves.join(one, "first").join(two, "second").withColumn("strength", F.least("_a", "_b"))
    return rows.groupBy("query").agg(F.max_by(F.struct("first", "second", "strength"), F.struct("strength", -F.col("_at"))).alias("_c")).select("query", "_c.*")


def noisy_channel(candidates: DataFrame, error: float = 3.0) -> DataFrame:
    """TX-22: word, candidate, score of the best correction: how frequent it is against how far it is. candidates: word, candidate, distance, doc_freq."""
    score = F.round(F.log("doc_freq") - error * F.col("distance"), 9)
    return candidates.withColumn("score", score).groupBy("word").agg(F.max_by(F.struct("candidate", "score"), F.struct("score", F.struct(-F.length("candidate")), "candidate")).alias("_b")).select("word", "_b.*")


def intent(query: Column) -> Column:
    """TX-22: navigational, question, local, transactional or informational, by the words of a query; the first that fits."""
    q = F.lower(F.trim(query))
    return (
        F.when(q.rlike(r"^(https?://|www\.)|^[a-z0-9-]+\.[a-z]{2,}$"), "navigational").when(q.rlike(r"^(who|what|when|where|why|how)\b|\?$"), "question")
        .when(q.rlike(r"\bnear( me)?\b"), "local").when(q.rlike(r"\b(buy|price|cheap|order)\b"), "transactional").otherwise("informational")
    )
