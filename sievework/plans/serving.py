"""Queries around a ranking, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import crawl, evaluate, ranking, serving
from ..session import read_table
from .crawling import _CRAWLABLE, _FETCH_DOMAIN, _host
from .search import _DOCS, _SCORED, FIELD_SEARCHES, SEARCHES, _field_sql, _fields, _index, _out, _top

Query = Callable[[SparkSession, str], DataFrame]


def _scores(spark, d):
    docs, posts = _index(spark, d)
    return docs, ranking.scored(posts, docs, ranking.query_table(spark, SEARCHES))


def _shard(c="external_id"):
    return F.pmod(F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint"), F.lit(40))


def host_collapse(spark, d):
    """RK-27: at most two results of a host, hosts being told by the record's hash."""
    docs, scores = _scores(spark, d)
    placed = scores.join(docs.select("doc_id", _shard().alias("host")), "doc_id")
    return _out(ranking.best(ranking.collapse_hosts(placed, "host"), 10))


def deny_overlay(spark, d):
    """RK-28: records of zero length denied, every fourth host demoted by half."""
    docs, scores = _scores(spark, d)
    placed = scores.join(docs.select("doc_id", _shard().alias("host")), "doc_id")
    denied = docs.where("length < 60").select("doc_id")
    demoted = spark.range(40).where("id % 4 = 0").select(F.col("id").alias("host"), F.lit(0.5).alias("multiplier"))
    return _out(ranking.best(serving.deny(placed, denied, "doc_id", demoted), 10))


def staged_rerank(spark, d):
    """RK-40: BM25 for a thousand, with the static rank for two hundred, with brevity for ten."""
    docs, scores = _scores(spark, d)
    rows = scores.withColumnRenamed("score", "text").join(docs.select("doc_id", "static_rank", "length"), "doc_id")
    stages = [F.col("text"), F.col("text") + F.col("static_rank"), F.col("text") + F.col("static_rank") - F.col("length") / 1000]
    return _out(serving.staged_rerank(rows, stages, (1000, 200, 10)))


def layered_postings(spark, d):
    """IB-32: an hourly layer of input records over a daily one of fielded titles: terms of the newest layer of each record."""
    fresh = read_table(spark, d, "input_documents").where("external_id is not null and static_rank >= 0.5").select("external_id").distinct()
    base = read_table(spark, d, "input_documents").where("external_id is not null").select("external_id").distinct()
    rows = serving.layered([fresh, base], "external_id")
    return rows.groupBy("layer").agg(F.count("*").alias("records"))


def click_model(spark, d):
    """RK-33 on events: users are the items, positions fall to each by the hour, clicks are clicks."""
    e = read_table(spark, d, "events").where("event_type in ('view', 'click')")
    return serving.click_model(e.select(F.col("user_id").alias("item"), (F.hour(F.col("ts")) + 1).alias("position"), (F.col("event_type") == "click").alias("clicked"))).withColumn("relevance", F.round("relevance", 6))


def snippets(spark, d):
    """RK-34: the best sentence of each document for two words."""
    docs = read_table(spark, d, "documents")
    return docs.select("doc_id", ranking.snippet(F.col("text"), ["museum", "library"]).alias("snippet"))


def interleaved(spark, d):
    """RK-39: BM25F and the contrast scorer, interleaved."""
    docs, posts, lengths, averages = _fields(spark, d)
    c = ranking.field_contributions(posts, lengths, averages, ranking.query_table(spark, FIELD_SEARCHES))
    total = docs.agg(F.count("*").alias("_n"))
    a, b = (ranking.best(ranking.bm25f_scores(c, posts, total, per_field=p), 10, "external_id").withColumnRenamed("external_id", "doc_id") for p in (False, True))
    return evaluate.interleave(a, b, 10).select("query_id", "doc_id", F.col("place").cast("bigint").alias("place"), "team")


def response_envelopes(spark, d):
    docs, scores = _scores(spark, d)
    ranked = ranking.best(scores, 10).withColumn("rank", F.col("rank").cast("int"))
    return serving.envelope(ranked, scores.groupBy("query_id").agg(F.count("*").alias("total")), "g1", 1).select("query_id", "total_estimate", "page", F.size("results").alias("shown"))


def priority_scores(spark, d):
    t = read_table(spark, d, "crawl_tasks").where("domain is not null")
    links = t.where("source_url is not null").groupBy("domain").agg(F.count_distinct("source_url").alias("links"))
    score = serving.priority_score(F.col("priority") / 1000, F.col("depth"), F.col("attempt") / 3, F.lit(15.0), F.col("links"), F.lit(0.5))
    rows = t.join(links, "domain", "left").select("task_id", F.round(score, 6).alias("score"))
    return rows.withColumn("band", serving.band(F.col("score")))


def confirmed_gone(spark, d):
    f = read_table(spark, d, "fetch_results").where("url is not null")
    runs = crawl.outcome_runs(f.select("url", "outcome", F.col("fetched_at").alias("at"), F.col("fetch_id").alias("ord")))
    return serving.confirmed_gone(runs, f.select("url", "status"), 1)


def redirect_canonicals(spark, d):
    return serving.redirect_canonical(read_table(spark, d, "fetch_results").where("url is not null and redirect_target is not null").select("url", "redirect_target", "redirect_permanent")).distinct()


def cached_lookup(spark, d):
    """CR-25/27: for each offer, the newest fetch of its host before it, if not older than four hours (ten minutes after a failure)."""
    host = urls.url_host(F.col("url"))
    asked = read_table(spark, d, "crawl_tasks").where(urls.crawlable(F.col("url"))).select(host.alias("host"), F.col("offered_at").alias("at"), F.col("task_id").alias("id")).where("host is not null")
    known = read_table(spark, d, "fetch_results").select(host.alias("host"), F.col("fetched_at").alias("at"), F.col("outcome").alias("value"), (F.col("outcome") == "fetched").alias("ok")).where("host is not null")
    rows = serving.as_of(asked, known, "host", F.when(F.col("ok"), 14_400).otherwise(600))
    return rows.groupBy("value").agg(F.count("*").alias("offers"))


def discovery_split(spark, d):
    return serving.discovery_split(read_table(spark, d, "crawl_tasks"), F.col("etag").isNotNull() | F.col("last_modified").isNotNull())


def _anchor_links(spark, d):
    t = read_table(spark, d, "crawl_tasks").where("url is not null and source_url is not null")
    return t.select(urls.domain_of_host(urls.url_host(F.col("url"))).alias("target"), F.col("source_url").alias("source"), urls.url_path(F.col("url")).alias("anchor")).distinct()


def anchor_shuffle(spark, d):
    return serving.anchor_shuffle(_anchor_links(spark, d), 50).groupBy("target").agg(F.count("*").alias("anchors"))


def anchor_shuffle_full(spark, d):
    """IB-24 at the production number of links a target."""
    return serving.anchor_shuffle(_anchor_links(spark, d)).groupBy("target").agg(F.count("*").alias("anchors"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        host_collapse, deny_overlay, staged_rerank, layered_postings, click_model, snippets, interleaved, response_envelopes, priority_scores, confirmed_gone, redirect_canonicals,
        cached_lookup, discovery_split, anchor_shuffle, anchor_shuffle_full,
    )
}

_SHARD = "(('0x' || substr(md5(external_id), 1, 8))::ubigint % 40)"

SQL: dict[str, str] = {
    "host_collapse": f"""with {_DOCS}, {_SCORED}, placed as (select s.*, row_number() over (partition by query_id, {_SHARD} order by score desc, doc_id) as r from scored s join docs using (doc_id)),
kept as (select query_id, doc_id, score from placed where r <= 2) {_top("kept")}""",
    "deny_overlay": f"""with {_DOCS}, {_SCORED}, kept as (
  select query_id, doc_id, score * case when {_SHARD} % 4 = 0 then 0.5::double else 1 end as score from scored join docs using (doc_id) where length >= 60) {_top("kept")}""",
    "staged_rerank": f"""with {_DOCS}, {_SCORED},
a as (select query_id, doc_id, score as text, static_rank, length from scored join docs using (doc_id) qualify row_number() over (partition by query_id order by round(score, 9) desc, doc_id) <= 1000),
b as (select * from a qualify row_number() over (partition by query_id order by round(text + static_rank, 9) desc, doc_id) <= 200),
c as (select query_id, doc_id, text + static_rank - length / 1000 as score from b) {_top("c")}""",
    "layered_postings": """with b as (select external_id, max(static_rank >= 0.5) as fresh from input_documents where external_id is not null group by 1)
select (case when fresh then 0 else 1 end)::int as layer, count(*)::bigint as records from b group by 1""",
    "click_model": """select user_id as item, count(*)::bigint as shown, count_if(event_type = 'click')::bigint as clicks,
  round(least(1, count_if(event_type = 'click') / sum(1 / log2(hour(ts) + 2))), 6) as relevance from events where event_type in ('view', 'click') group by 1""",
    "interleaved": f"""with recursive {_field_sql(False).strip().removeprefix("with")},
wrong as (select query_id, external_id, sum(qtf * ln(1 + ((select count(*) from docs) - df + 0.5) / (df + 0.5)) * p) as score from (
  select query_id, external_id, term, any_value(qtf) as qtf, sum(weight * (c * 2.2 / (c + 1.2))) as p from contributions group by 1, 2, 3) join df using (term) group by 1, 2),
a as (select query_id, external_id, row_number() over (partition by query_id order by round(score, 9) desc, external_id) as r from scored),
b as (select query_id, external_id, row_number() over (partition by query_id order by round(score, 9) desc, external_id) as r from wrong),
u as (select query_id, external_id, r * 2 - 1 as o, 'a' as team from a where r <= 10 union all select query_id, external_id, r * 2, 'b' from b where r <= 10),
f as (select query_id, external_id, min(o) as o, arg_min(team, o) as team from u group by 1, 2)
select query_id, external_id as doc_id, place::bigint as place, team from (select *, row_number() over (partition by query_id order by o) as place from f) where place <= 10""",
    "response_envelopes": f"with {_DOCS}, {_SCORED} select query_id, count(*)::bigint as total_estimate, 1 as page, least(10, count(*))::int as shown from scored group by 1",
    "priority_scores": """with l as (select domain, count(distinct source_url) as links from crawl_tasks where domain is not null and source_url is not null group by 1),
s as (select task_id, round(0.30::double * least(1, greatest(0, coalesce(priority / 1000, 0))) + 0.15::double / (1 + greatest(coalesce(depth, 0), 0)) + 0.20::double * least(1, greatest(0, coalesce(attempt / 3, 0)))
  + 0.10::double * 0.5 + 0.15::double * least(1, ln(1 + coalesce(links, 0)) / 10) + 0.10::double * 0.5, 6) as score from crawl_tasks left join l using (domain) where domain is not null)
select task_id, score, greatest(0, least(1023, floor((1 - score) * 1024)))::int as band from s""",
    "confirmed_gone": """with l as (select url, arg_max(outcome, (fetched_at, fetch_id)) as outcome from fetch_results where url is not null group by 1)
select url from l where outcome = 'gone' union select url from fetch_results where url is not null and status = 410""",
    "redirect_canonicals": "select distinct url, case when redirect_permanent then redirect_target else url end as canonical from fetch_results where url is not null and redirect_target is not null",
    "cached_lookup": f"""with asked as (select {_host("url")} as host, offered_at as t, task_id from crawl_tasks where {_CRAWLABLE}),
known as (select {_host("url")} as host, fetched_at as t, outcome from fetch_results),
j as (select a.task_id, a.t, k.t as kt, k.outcome from asked a asof left join known k on a.host = k.host and a.t >= k.t where a.host is not null)
select case when epoch_us(t) - epoch_us(kt) <= (case when outcome = 'fetched' then 14400 else 600 end) * 1000000::bigint then outcome end as value, count(*)::bigint as offers from j group by 1""",
    "discovery_split": """select domain, count_if(etag is not null or last_modified is not null)::bigint as refreshes, count_if(etag is null and last_modified is null)::bigint as discoveries
from crawl_tasks where domain is not null group by 1""",
    "anchor_shuffle": f"""with r as (select distinct {_FETCH_DOMAIN} as target, source_url, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as anchor from crawl_tasks where url is not null and source_url is not null)
select target, least(50, count(*))::bigint as anchors from r where target is not null group by 1""",
}
SQL["anchor_shuffle_full"] = SQL["anchor_shuffle"].replace("least(50,", "least(1000,")
SQL["snippets"] = r"""with parts as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0) as p from documents where text is not null),
s as (select doc_id, unnest(p) as s, unnest(range(0, len(p))) as i from parts),
r as (select *, contains(lower(s), 'museum')::int + contains(lower(s), 'library')::int as m from s),
best as (select doc_id, s from r qualify row_number() over (partition by doc_id order by m desc, i) = 1)
select d.doc_id, regexp_replace(regexp_replace(substr(s, 1, 160), '(museum)', '[\1]', 'gi'), '(library)', '[\1]', 'gi') as snippet from documents d left join best using (doc_id)"""
