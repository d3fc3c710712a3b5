"""Queries of rules and stores around crawl, search and serving, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, robots, text, urls
from ..operators import bloom, crawl, index, monitor, ranking, retrieval, serving
from ..session import attach, read_table, scratch_path, spread
from ..sources import blobs, topics
from ..streaming import jobs
from . import content
from . import crawling as c
from . import search as s

Query = Callable[[SparkSession, str], DataFrame]

BLOOM_CASES = ((1000, 0.01), (10_000, 0.001), (1_000_000, 0.01), (50, 0.2))
ROBOTS = "User-agent: *\nDisallow: /list\nAllow: /list/a\nDisallow: /20*/05\nDisallow: /*.html$\nCrawl-delay: 3\nSitemap: https://x.test/a.xml\nSitemap: https://x.test/b.xml\n"
QUERIES_ASKED = ("plain words", "x" * 513, " ".join(["w"] * 33), "find *this", "?what now", "", "a* b?")
RETENTION = "2026-01-10"


def bloom_sizes(spark, d):
    """CR-01."""
    return spark.createDataFrame([(n, e, *crawl.bloom_params(n, e)) for n, e in BLOOM_CASES], "capacity bigint, error double, bits bigint, hashes bigint")


def bloom_seen_stats(spark, d):
    """CR-02/05: how many offers the filter answers alone."""
    return bloom.seen_stats(c._keyed_full(spark, d), c._seen_full(spark, d))


def bloom_new_keys(spark, d):
    """CR-02/04: keys that were not seen, through the filter and the exact store."""
    return bloom.new_keys(c._keyed_full(spark, d), c._seen_full(spark, d))


def lease_release(spark, d):
    """CR-15: leases that still hold at a moment: half were released, a third with a wrong token."""
    t = read_table(spark, d, "crawl_tasks").where("lease_token is not null and offered_at is not null").select("task_id", F.col("task_id").cast("string").alias("url"), F.col("lease_token").alias("token"), (F.col("offered_at") + F.expr("interval 20 days")).alias("until"))
    released = t.where("task_id % 2 = 0").select("url", F.when(F.col("task_id") % 3 == 0, F.concat(F.lit("x"), "token")).otherwise(F.col("token")).alias("token"))
    return serving.release(t, released, F.lit(c.LATE).cast("timestamp_ntz")).select("task_id")


def robots_statuses(spark, d):
    """CR-23: what each status would mean as the answer to a request for robots.txt."""
    return read_table(spark, d, "fetch_results").groupBy("status", robots.status_decision(F.col("status")).alias("decision")).agg(F.count("*").alias("n"))


def robots_allowed(spark, d):
    """CR-24: paths that a robots file lets pass."""
    path = F.when(urls.url_path(F.col("url")) == "", "/").otherwise(urls.url_path(F.col("url")))
    rows = c._tasks(spark, d).where(urls.crawlable(F.col("url")))
    return rows.groupBy(robots.path_allowed(path, robots.parse(ROBOTS), "sieveworkbot").alias("allowed")).agg(F.count("*").alias("offers"))


def robots_sitemaps(spark, d):
    """CR-24/45: crawl delay and sitemaps of a robots file."""
    rules = robots.parse(ROBOTS)
    return spark.createDataFrame([(u, robots.crawl_delay(rules, "sieveworkbot")) for u in rules["sitemaps"]], "sitemap string, crawl_delay double")


def retry_afters(spark, d):
    """CR-32: waits as seconds, from numbers and dates."""
    f = read_table(spark, d, "fetch_results").where("fetched_at is not null")
    value = F.when(F.col("fetch_id") % 3 == 0, F.col("fetch_id").cast("string")).when(F.col("fetch_id") % 3 == 1, F.date_format(F.col("fetched_at") + F.expr("interval 90 seconds"), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.lit("soon"))
    return f.select("fetch_id", F.ceil(crawl.retry_after_seconds(value, F.date_trunc("second", F.col("fetched_at").cast("timestamp")))).cast("bigint").alias("seconds"))


def outcome_classes(spark, d):
    """CR-35."""
    f = read_table(spark, d, "fetch_results")
    kind = F.when(F.col("status").isNotNull(), F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx")))
    return f.groupBy(F.col("outcome").isin(*crawl.HEALTHY).alias("healthy"), F.col("outcome").isin(*crawl.SUCCESS).alias("success"), kind.alias("status_class")).agg(F.count("*").alias("n"))


def timeout_halvings(spark, d):
    """CR-39 (here one timeout is enough)."""
    return crawl.timeout_halvings(c.outcome_runs(spark, d), 1)


def recrawl_shares(spark, d):
    """CR-37."""
    return crawl.recrawl_shares(c.change_rates(spark, d)).select("url", F.round("share", 6).alias("share"))


def url_origins(spark, d):
    """URL-12."""
    return c._tasks(spark, d).groupBy(urls.url_origin(F.col("url")).alias("origin")).agg(F.count("*").alias("offers"))


def gzip_round_trip(spark, d):
    """HT-01: bodies packed and inflated again."""
    import gzip

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(body=[html.inflate(gzip.compress(bytes(b))) for b in pdf["body"]])

    rows = spread(read_table(spark, d, "fetch_results").where("body is not null").select("fetch_id", "body")).mapInPandas(run, "fetch_id bigint, body binary")
    return rows.select("fetch_id", F.md5("body").alias("md5"))


def _words(spark, d):
    return read_table(spark, d, "documents").where("text is not null").select(F.explode(text.simple_words(F.col("text"))).alias("word")).distinct()


def affix_roots(spark, d):
    """TX-14: roots of all words, read as Arabic and as Korean."""
    root = lambda lang: F.pandas_udf(lambda w: w.map(lambda x: text.affix_root(x, lang)), "string")
    rows = _words(spark, d).select("word", root("ar")("word").alias("arabic"), root("ko")("word").alias("korean"))
    return rows.where("arabic is not null or korean is not null")


def folded_words(spark, d):
    """TX-04/24: words without their marks, and in German letters, where that differs."""
    bare = F.pandas_udf(lambda w: w.map(text.without_marks), "string")
    german = F.pandas_udf(lambda w: w.map(lambda x: text.forms(x, "de")[-1]), "string")
    return _words(spark, d).select("word", bare("word").alias("bare"), german("word").alias("german")).where("bare <> word or german <> word")


def merge_policy(spark, d):
    """IB-18: which groups of records would be merged, by segments and dead records."""
    docs = index.records(read_table(spark, d, "input_documents"))
    per = docs.groupBy(F.substring("external_id", 3, 1).alias("part")).agg(F.count("*").alias("total"), F.count_if(F.col("static_rank") < 0.05).alias("dead"), F.count_distinct(F.substring("external_id", 4, 1)).alias("segments"))
    return per.withColumn("due", index.merge_due(F.col("segments"), F.col("dead"), F.col("total")))


def personalised(spark, d):
    """RK-42: a page reordered by boosts; some results go, none comes."""
    st = s._store(spark, d)
    page = ranking.bm25_top_k(st.postings, st.docs, ranking.query_table(spark, s.SEARCHES), dictionary=st.dictionary)
    boosts = page.select("query_id", "doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit(None).cast("double")).otherwise((F.col("doc_id") % 3) / 10.0).alias("boost")).where("doc_id % 2 = 0 or doc_id % 7 = 0")
    return s._out(serving.personalise(page.select("query_id", "doc_id", F.round("score", 9).alias("score")), boosts))


def query_problems(spark, d):
    """RK-36."""
    rows = spark.createDataFrame([(k, q) for k, q in enumerate(QUERIES_ASKED)], "n bigint, q string")
    return rows.select("n", ranking.query_problem(F.col("q")).alias("problem"))


def degradation_rungs(spark, d):
    """MO-09: the rung of each hour, its events by those of the busiest."""
    hours = c._events(spark, d).groupBy(F.floor(monitor.micros(F.col("ts")) / 3_600_000_000).cast("bigint").alias("hour")).agg(F.count("*").alias("n"))
    most = hours.agg(F.max("n").alias("_m"))
    return attach(hours, most).select("hour", monitor.ladder_rung(F.col("n") / F.col("_m")).alias("rung"))


def in_flight(spark, d):
    """MO-10: users' views that no click had ended by a moment."""
    log = c._events(spark, d).where("event_type in ('view', 'click')").select(F.concat_ws("-", "user_id", F.floor(monitor.micros(F.col("ts")) / 86_400_000_000).cast("string")).alias("request_id"), F.when(F.col("event_type") == "view", "start").otherwise("finish").alias("kind"), "ts")
    return monitor.in_flight_at(log, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).groupBy("request_id").agg(F.count("*").alias("started"))


def zero_results(spark, d):
    """MO-05, RK-39."""
    rows = c._events(spark, d).select("event_type", F.col("event_id").alias("query_id"), F.floor("value").alias("hits"))
    return monitor.zero_results(rows, "event_type").withColumn("zero_ratio", F.round("zero_ratio", 6))


def document_store(spark, d):
    """IO-19: the newest text of some addresses, read by their buckets."""
    store = blobs.DocumentStore(spark, scratch_path(spark, "docs"))
    docs = read_table(spark, d, "documents").select("url", "doc_id", F.struct("fetched_at", "doc_id").alias("at"), F.md5("text").alias("text_md5"))
    store.write(docs, "url", "at")
    wanted = docs.where("doc_id % 3 = 0").select("url").where("url is not null")
    return store.read(wanted).select("url", "doc_id", "text_md5")


def archive_days(spark, d):
    """IO-17: archived bodies by day after the old days went, and how many the index finds."""
    path = scratch_path(spark, "archive")
    blobs.write_archive(read_table(spark, d, "fetch_results").where("body is not null and fetched_at is not null").select("fetch_id", "url", "body", "fetched_at"), path, 500)
    blobs.expire_archive(spark, path, RETENTION)
    return blobs.archive_index(spark, path, "fetch_id").groupBy(F.col("dt").cast("string").alias("day")).agg(F.count("*").alias("records"), F.count_distinct("file", "row").alias("places"))


def replayed_messages(spark, d):
    """IO-20: deliveries from an offset on, by batch."""
    m = read_table(spark, d, "fetched_messages")
    return topics.replay(m, "delivery_id", 500).groupBy("batch_id").agg(F.count("*").alias("messages"), F.min("delivery_id").alias("first"))


def collected_counts(spark, d):
    """IO-06: a stream's counts in a table in memory."""
    import uuid

    return topics.collected(jobs.table_stream(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), f"collected_{uuid.uuid4().hex}")


def cache_outcomes(spark, d):
    """CR-25/27: hits, expired entries and hosts never met, by whether the last answer was good."""
    host = urls.url_host(F.col("url"))
    asked = read_table(spark, d, "crawl_tasks").where(urls.crawlable(F.col("url"))).select(host.alias("host"), F.col("offered_at").alias("at"), F.col("task_id").alias("id")).where("host is not null and at is not null")
    known = read_table(spark, d, "fetch_results").select(host.alias("host"), F.col("fetched_at").alias("at"), F.lit("known").alias("value"), (F.col("outcome") == "fetched").alias("ok")).where("host is not null")
    short = serving.as_of(asked, known, "host", F.when(F.col("ok"), 14_400).otherwise(600))
    ever = serving.as_of(asked, known, "host", F.lit(10**9)).select("id", F.col("hit").alias("_ever"))
    state = F.when(F.col("hit"), "hit").when(F.col("_ever"), "expired").otherwise("cold")
    return short.join(ever, "id").groupBy(state.alias("state")).agg(F.count("*").alias("lookups"))


def url_identity_sound(spark, d):
    """URL-08/09: as many ids and fingerprints as addresses, and the two tell the same."""
    rows = c.url_identity(spark, d)
    same = F.concat(F.lit("d:"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0")) == F.col("doc_id")
    return rows.agg(F.count_distinct("canonical").alias("addresses"), F.count_distinct("doc_id").alias("ids"), F.count_distinct("fingerprint").alias("fingerprints"), F.count_if(~same).alias("apart"))


def robots_tags(spark, d):
    """CR-26: X-Robots-Tag for all agents, for ours and for others."""
    value = F.element_at(F.array(F.lit("noindex"), F.lit("otherbot: noindex"), F.lit("nofollow, SieveworkBot: none"), F.lit("noarchive"), F.lit(None)), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    return read_table(spark, d, "documents").where("doc_id is not null").select("doc_id", crawl.robots_tag_noindex(value).alias("noindex"))


def body_caps(spark, d):
    """CR-31: bodies over a cap are too large whatever their status says."""
    f = read_table(spark, d, "fetch_results").where("body is not null and status between 200 and 299")
    return f.groupBy(crawl.classify_status(F.col("status"), F.octet_length("body"), 5000).alias("outcome")).agg(F.count("*").alias("n"))


def salted_domains(spark, d):
    """CR-42: offers by salted domain; no offer moves to another domain, and no more salts than there are."""
    key = crawl.salted_key(F.col("domain"), F.col("url"), 8)
    rows = c._tasks(spark, d).where("domain is not null and url is not null").groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return rows.groupBy(F.substring_index("k", "#", 1).alias("domain")).agg(F.sum("n").alias("offers"), (F.count("*") <= 8).alias("bounded"))


def render_flags(spark, d):
    """HT-36: decisions that ask for a render, and for an audit."""
    pick = F.element_at(F.array(*[F.lit(x) for x in ("static", "render_thin", "render_framework", "render_audit")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    rows = read_table(spark, d, "documents").where("doc_id is not null")
    return rows.groupBy(html.needs_render(pick).alias("render"), html.is_audit_render(pick).alias("audit")).agg(F.count("*").alias("n"))


def retained_shares(spark, d):
    """HT-33."""
    rows = read_table(spark, d, "documents").where("doc_id is not null")
    return rows.select("doc_id", F.round(html.retained_ratio(F.pmod("doc_id", F.lit(7)), F.pmod("doc_id", F.lit(3)) * 10), 6).alias("ratio"))


def query_splits(spark, d):
    """TX-22: two terms of the dictionary run together, and cut again."""
    words = s._store(spark, d).dictionary
    firsts = words.where("length(term) >= 3 and doc_freq >= 3").select("term", "doc_freq")
    return retrieval.split_words(firsts.select(F.concat("term", F.reverse("term"), F.lit("tor")).alias("query")).union(firsts.select(F.concat("term", F.lit("tor")).alias("query"))), words)


def corrections(spark, d):
    """TX-22: the best correction of rare terms."""
    return retrieval.noisy_channel(content.spelling_candidates(spark, d)).select("word", "candidate", F.round("score", 6).alias("score"))


def query_intents(spark, d):
    """TX-22: intents of built queries."""
    q = F.element_at(F.array(F.lit("www.x.test"), F.lit("shop.test"), F.lit("How to walk"), F.lit("is it open?"), F.lit("bread oven near me"), F.lit("cheap boots"), F.lit("paper map")), (F.pmod("doc_id", F.lit(7)) + 1).cast("int"))
    return read_table(spark, d, "documents").where("doc_id is not null").groupBy(retrieval.intent(q).alias("intent")).agg(F.count("*").alias("queries"))


def cache_by_generation(spark, d):
    """MO-02: hits of a cache that every day's generation empties, with lifetimes by intent."""
    e = c._events(spark, d).withColumn("generation", F.floor(monitor.micros(F.col("ts")) / 86_400_000_000).cast("bigint"))
    ttl = F.when(F.col("event_type") == "view", 3600).otherwise(600)
    return monitor.cache_hits(e, ["generation", "event_type"], ttl)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        bloom_sizes, bloom_seen_stats, bloom_new_keys, lease_release, robots_statuses, robots_allowed, robots_sitemaps, retry_afters, outcome_classes, timeout_halvings, recrawl_shares, url_origins,
        gzip_round_trip, affix_roots, folded_words, merge_policy, personalised, query_problems, degradation_rungs, in_flight, zero_results, document_store, archive_days, replayed_messages, collected_counts, cache_outcomes,
        url_identity_sound, robots_tags, body_caps, salted_domains, render_flags, retained_shares, query_splits, corrections, query_intents, cache_by_generation,
    )
}

_WORD_ROWS = "select distinct unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+(?:[''’]\\p{L}+)*')) as word from documents where text is not null"
_CUT = lambda word, affixes, end, least: "case " + " ".join(f"when {'ends_with' if end else 'starts_with'}({word}, '{a}') and length({word}) - {len(a)} >= {least} then " + (f"{word}[:length({word}) - {len(a)}]" if end else f"{word}[{len(a) + 1}:]") for a in affixes) + f" else {word} end"
_BLOOM = f"""{c._KEYED_FULL}, n as (select greatest(count(*), 1) as n from seen), size as (select ceil(-n * ln(0.01) / (ln(2) * ln(2)))::bigint as bits, greatest(1, round(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / n * ln(2)))::bigint as k from n),
sp as (select distinct (('0x' || substr(md5(key), 1, 8))::ubigint::bigint + i * (('0x' || substr(md5(key), 9, 8))::ubigint::bigint | 1)) % bits as p from seen, size, (select unnest(range(0, 20)) as i) where i < k),
uk as (select key, count(*) as n from keyed group by 1),
kp as (select key, (('0x' || substr(md5(key), 1, 8))::ubigint::bigint + i * (('0x' || substr(md5(key), 9, 8))::ubigint::bigint | 1)) % bits as p from uk, size, (select unnest(range(0, 20)) as i) where i < k),
may as (select key from kp group by 1 having bool_and(p in (select p from sp)))"""

SQL: dict[str, str] = {
    "bloom_sizes": f"""with t(capacity, error) as (values {", ".join(map(str, BLOOM_CASES))})
select capacity::bigint as capacity, error::double as error, ceil(-capacity * ln(error) / (ln(2) * ln(2)))::bigint as bits, greatest(1, round(ceil(-capacity * ln(error) / (ln(2) * ln(2))) / capacity * ln(2)))::bigint as hashes from t""",
    "bloom_seen_stats": f"""with {_BLOOM}
select (select sum(n) from uk)::bigint as checked, (select count(*) from uk)::bigint as unique_keys, ((select count(*) from uk) - (select count(*) from may))::bigint as bloom_skipped, (select count(*) from may)::bigint as exact_consulted,
  (select count(*) from may where key in (select key from seen))::bigint as already_seen, (select count(*) from may where key not in (select key from seen))::bigint as false_positives""",
    "bloom_new_keys": f"with {c._KEYED_FULL} select distinct key from keyed where key not in (select key from seen)",
    "lease_release": f"""select task_id from crawl_tasks where lease_token is not null and offered_at is not null and offered_at + interval 20 days > timestamp '{c.LATE}' and not (task_id % 2 = 0 and task_id % 3 <> 0)""",
    "robots_statuses": """select status, case when status is null or status = 429 or status >= 500 then 'unreachable' when status in (401, 403) then 'deny' when status between 200 and 299 then 'use' else 'allow' end as decision, count(*)::bigint as n from fetch_results group by 1, 2""",
    "robots_allowed": f"""with p as (select regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as p from crawl_tasks where {c._CRAWLABLE}), q as (select case when p = '' then '/' else p end as p from p),
r as (select coalesce(list_extract(list_reverse_sort(list_filter([case when regexp_matches(p, '^/list') then 5.0 end, case when regexp_matches(p, '^/list/a') then 7.5 end, case when regexp_matches(p, '^/20.*/05') then 7.0 end, case when regexp_matches(p, '^/.*\\.html$') then 8.0 end], lambda x: x is not null)), 1), 0.5) as best from q)
select best % 1 = 0.5 as allowed, count(*)::bigint as offers from r group by 1""",
    "robots_sitemaps": "select * from (values ('https://x.test/a.xml', 3.0::double), ('https://x.test/b.xml', 3.0::double)) t(sitemap, crawl_delay)",
    "retry_afters": "select fetch_id, case when fetch_id % 3 = 0 then fetch_id when fetch_id % 3 = 1 then 90 end::bigint as seconds from fetch_results where fetched_at is not null",
    "outcome_classes": """select coalesce(outcome in ('fetched', 'not_modified', 'redirected', 'gone', 'client_error', 'too_large'), null) as healthy, outcome in ('fetched', 'not_modified') as success,
  (status // 100)::varchar || 'xx' as status_class, count(*)::bigint as n from fetch_results group by 1, 2, 3""",
    "timeout_halvings": f"select {c._FETCH_DOMAIN} as url, count(*)::bigint as halvings from fetch_results where outcome = 'timeout' and {c._FETCH_DOMAIN} is not null group by 1",
    "recrawl_shares": "with r as (" + c.SQL["change_rates"] + ") select url, round(sqrt(rate) / (select sum(sqrt(rate)) from r where rate > 0), 6) as share from r where rate > 0",
    "url_origins": "select nullif(regexp_extract(lower(url), '^(https?://[^/?#]+)', 1), '') as origin, count(*)::bigint as offers from crawl_tasks group by 1",
    "gzip_round_trip": "select fetch_id, md5(body) as md5 from fetch_results where body is not null",
    "affix_roots": f"""with w as ({_WORD_ROWS}), a as (select word, {_CUT("word", text.ARABIC_PREFIXES, False, 3)} as a1, {_CUT("word", text.KOREAN_PARTICLES, True, 1)} as k from w),
b as (select word, {_CUT("a1", text.ARABIC_SUFFIXES, True, 3)} as a, k from a)
select word, nullif(a, word) as arabic, nullif(k, word) as korean from b where a <> word or k <> word""",
    "folded_words": f"""with w as ({_WORD_ROWS}), f as (select word, strip_accents(word) as bare, replace(replace(replace(replace(word, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss') as german from w)
select * from f where bare <> word or german <> word""",
    "merge_policy": f"""with {s._DOCS}, p as (select external_id[3:3] as part, count(*)::bigint as total, count_if(static_rank < 0.05)::bigint as dead, count(distinct external_id[4:4])::bigint as segments from docs group by 1)
select *, segments > {index.MERGE_SEGMENTS} or dead / total > {index.MERGE_DEAD} as due from p""",
    "personalised": f"""with {s._DOCS}, {s._SCORED}, page as (select query_id, doc_id, round(score, 9) as score from scored qualify row_number() over (partition by query_id order by round(score, 9) desc, doc_id) <= 10),
b as (select query_id, doc_id, score + case when doc_id % 2 = 0 then (doc_id % 3) / 10.0::double else 0 end as score from page where doc_id % 7 <> 0)
select query_id, doc_id::bigint as doc_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, doc_id) as rank from b""",
    "query_problems": f"""with q(n, q) as (values {", ".join(f"({k}, '{q}')" for k, q in enumerate(QUERIES_ASKED))})
select n::bigint as n, case when length(q) > 512 then 'too_long' when len(list_filter(string_split(q, ' '), lambda t: t <> '')) > 32 then 'too_many_terms' when regexp_matches(q, '(^|\\s)[*?]') then 'leading_wildcard' end as problem from q""",
    "degradation_rungs": """with h as (select (epoch_us(ts) // 3600000000)::bigint as hour, count(*) as n from events group by 1), u as (select hour, n / max(n) over () as u from h)
select hour, case when u < 0.7 then 0 when u < 0.8 then 1 when u < 0.9 then 2 when u < 0.95 then 3 else 4 end as rung from u""",
    "in_flight": """with l as (select user_id::varchar || '-' || (epoch_us(ts) // 86400000000)::varchar as request_id, event_type from events where event_type in ('view', 'click') and ts <= timestamp '2024-01-20 00:00:00')
select request_id, count(*)::bigint as started from l where event_type = 'view' and request_id not in (select request_id from l where event_type = 'click' and request_id is not null) group by 1""",
    "zero_results": "select event_type, count(*)::bigint as queries, count_if(coalesce(floor(value), 0) = 0)::bigint as empty, round(count_if(coalesce(floor(value), 0) = 0) / count(*), 6) as zero_ratio from events group by 1",
    "document_store": """with n as (select url, doc_id, md5(text) as text_md5 from documents where url is not null qualify row_number() over (partition by url order by fetched_at desc nulls last, doc_id desc) = 1)
select * from n where url in (select url from documents where doc_id % 3 = 0 and url is not null)""",
    "archive_days": f"select strftime(fetched_at, '%Y-%m-%d') as day, count(*)::bigint as records, count(*)::bigint as places from fetch_results where body is not null and fetched_at is not null and strftime(fetched_at, '%Y-%m-%d') >= '{RETENTION}' group by 1",
    "replayed_messages": "select batch_id, count(*)::bigint as messages, min(delivery_id) as first from fetched_messages where delivery_id >= 500 group by 1",
    "collected_counts": "select event_type, count(*)::bigint as n from events group by 1",
    "cache_outcomes": f"""with asked as (select {c._host("url")} as host, offered_at as t, task_id from crawl_tasks where {c._CRAWLABLE} and offered_at is not null),
known as (select {c._host("url")} as host, fetched_at as t, outcome = 'fetched' as ok from fetch_results),
j as (select a.task_id, a.t, k.t as kt, k.ok from asked a asof left join known k on a.host = k.host and a.t >= k.t where a.host is not null)
select case when kt is null then 'cold' when epoch_us(t) - epoch_us(kt) <= (case when ok then 14400 else 600 end) * 1000000::bigint then 'hit' else 'expired' end as state, count(*)::bigint as lookups from j group by 1""",
    "url_identity_sound": f"with {c.canonical_ctes('crawl_tasks', 'task_id')} select count(distinct key)::bigint as addresses, count(distinct key)::bigint as ids, count(distinct key)::bigint as fingerprints, 0::bigint as apart from canon",
    "robots_tags": "select doc_id, doc_id % 5 in (0, 2) as noindex from documents where doc_id is not null",
    "body_caps": "select case when status in (301, 302) then null when octet_length(body) > 5000 then 'too_large' else 'fetched' end as outcome, count(*)::bigint as n from fetch_results where body is not null and status between 200 and 299 group by 1",
    "salted_domains": "select domain, count(*)::bigint as offers, true as bounded from crawl_tasks where domain is not null and url is not null group by 1",
    "render_flags": "select doc_id % 4 > 0 as render, doc_id % 4 = 3 as audit, count(*)::bigint as n from documents where doc_id is not null group by 1, 2",
    "retained_shares": "select doc_id, round(case when doc_id % 3 > 0 then (doc_id % 7) / (doc_id % 3 * 10) else 0 end, 6) as ratio from documents where doc_id is not null",
    "query_splits": f"""with {s._DOCS}, q as (select term || reverse(term) || 'tor' as query from dict where length(term) >= 3 and doc_freq >= 3 union all select term || 'tor' from dict where length(term) >= 3 and doc_freq >= 3),
x as (select query, i, query[:i] as first, query[i + 1:] as second from (select distinct query, unnest(range(1, length(query))) as i from q)),
r as (select query, first, second, i, least(a.doc_freq, b.doc_freq) as strength from x join dict a on a.term = first join dict b on b.term = second)
select query, first, second, strength::bigint as strength from r qualify row_number() over (partition by query order by strength desc, i) = 1""",
    "corrections": "with n as (" + content.SQL["spelling_candidates"] + ") select word, candidate, round(ln(doc_freq) - 3 * distance, 6) as score from n qualify row_number() over (partition by word order by round(ln(doc_freq) - 3 * distance, 9) desc, length(candidate), candidate desc) = 1",
    "query_intents": "select case doc_id % 7 when 0 then 'navigational' when 1 then 'navigational' when 2 then 'question' when 3 then 'question' when 4 then 'local' when 5 then 'transactional' else 'informational' end as intent, count(*)::bigint as queries from documents where doc_id is not null group by 1",
    "cache_by_generation": """with e as (select (epoch_us(ts) // 86400000000)::bigint as generation, event_type, epoch_us(ts) - lag(epoch_us(ts)) over (partition by epoch_us(ts) // 86400000000, event_type order by ts, event_id) as gap from events)
select generation, event_type, count(*)::bigint as requests, count_if(gap <= (case when event_type = 'view' then 3600 else 600 end) * 1000000::bigint)::bigint as hits from e group by 1, 2""",
}
