"""Crawl, politeness, graph, duplicate and monitoring queries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import crawl, dedup, graph, monitor, ranking
from ..session import read_table

Query = Callable[[SparkSession, str], DataFrame]

TRAP_MIN, TRAP_SHARE = 20, 0.999
NODES = [f"node-{i}" for i in range(8)]
LATE = "2026-01-20 00:00:00"


def _tasks(spark, d):
    return read_table(spark, d, "crawl_tasks")


def _keyed(spark, d):
    return _tasks(spark, d).where(urls.crawlable(F.col("url"))).select(urls.native_canonical(F.col("url")).alias("key"), F.col("task_id").alias("ord"), "domain", "url")


def _seen(spark, d):
    return read_table(spark, d, "fetch_results").where(urls.crawlable(F.col("url"))).select(urls.native_canonical(F.col("url")).alias("key"))


def _keyed_full(spark, d):
    """_keyed by the full rules; addresses without a key are left out."""
    rows = _tasks(spark, d).where("url is not null").select(urls.canonical_url(F.col("url")).alias("key"), F.col("task_id").alias("ord"), "domain", "url")
    return rows.where("key is not null")


def _seen_full(spark, d):
    return read_table(spark, d, "fetch_results").where("url is not null").select(urls.canonical_url(F.col("url")).alias("key")).where("key is not null")


def url_canonical_native(spark, d):
    return _tasks(spark, d).where(urls.crawlable(F.col("url"))).select("task_id", urls.native_canonical(F.col("url")).alias("canonical"))


def url_canonical(spark, d):
    """The full rules, in Arrow batches."""
    return _tasks(spark, d).select("task_id", urls.canonical_url(F.col("url")).alias("canonical"))


def url_identity(spark, d):
    """Document id and 64-bit fingerprint of every canonical address."""
    key = _tasks(spark, d).select(urls.canonical_url(F.col("url")).alias("canonical")).where("canonical is not null").distinct()
    return key.select("canonical", urls.url_document_id(F.col("canonical")).alias("doc_id"), urls.url_fingerprint(F.col("canonical")).alias("fingerprint"))


def url_host_parts(spark, d):
    host = urls.url_host(F.col("url"))
    return _tasks(spark, d).where(host.isNotNull()).groupBy(host.alias("host"), urls.domain_of_host(host).alias("registrable")).agg(F.count("*").alias("offers"))


def url_path_prefixes(spark, d):
    rows = _tasks(spark, d).where(urls.crawlable(F.col("url"))).select(F.explode(urls.path_prefixes(F.col("url"))).alias("prefix"))
    return rows.groupBy("prefix").agg(F.count("*").alias("offers"))


def url_token_counts(spark, d):
    rows = _tasks(spark, d).where(urls.crawlable(F.col("url"))).select(F.explode(urls.url_tokens(F.col("url"))).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("n"))


def seen_url_filter(spark, d):
    return crawl.filter_new(_keyed(spark, d), _seen(spark, d))


def seen_stats(spark, d):
    return crawl.seen_stats(_keyed(spark, d), _seen(spark, d)).withColumn("absorption", F.round("absorption", 6))


def seen_url_filter_full(spark, d):
    """CR-04 by the canonical address, as no SQL can."""
    return crawl.filter_new(_keyed_full(spark, d), _seen_full(spark, d))


def seen_stats_full(spark, d):
    """CR-05 by the canonical address."""
    return crawl.seen_stats(_keyed_full(spark, d), _seen_full(spark, d)).withColumn("absorption", F.round("absorption", 6))


def _budgets(spark, d, base=2):
    spent = read_table(spark, d, "fetch_results").select(urls.domain_of_host(urls.url_host(F.col("url"))).alias("domain")).where("domain is not null").groupBy("domain").agg(F.count("*").alias("spent"))
    authority = _tasks(spark, d).where("domain is not null").groupBy("domain").agg((F.avg("priority") / 1000).alias("authority"))
    limit = crawl.budget_limit(F.col("authority"), base=base)
    return authority.join(spent, "domain", "left").select("domain", limit.alias("limit"), (limit - F.coalesce("spent", F.lit(0))).alias("left"))


def site_budgets(spark, d):
    return _budgets(spark, d)


def _admitted(spark, d, budgets):
    offers = _tasks(spark, d).select("domain", F.col("task_id").alias("ord"))
    return crawl.admit_within_budget(offers, budgets).select("domain", F.col("ord").alias("task_id"), "place")


def site_budget_admission(spark, d):
    return _admitted(spark, d, _budgets(spark, d))


def site_budgets_full(spark, d):
    """CR-06 at the production base."""
    return _budgets(spark, d, crawl.BUDGET_BASE)


def site_budget_admission_full(spark, d):
    """CR-08 at the production base."""
    return _admitted(spark, d, _budgets(spark, d, crawl.BUDGET_BASE))


def _traps(spark, d, **how):
    return crawl.trap_prefixes(read_table(spark, d, "fetch_results").where(urls.crawlable(F.col("url"))).select("url", "content_hash"), TRAP_MIN, TRAP_SHARE, **how)


def trap_detect(spark, d):
    return _traps(spark, d).select("prefix", "depth", "urls", "distinct_bodies")


def trap_detect_sketch(spark, d):
    """The same with approximate distinct counts."""
    return _traps(spark, d, approximate=True)


def trapped_urls(spark, d):
    rows = _tasks(spark, d).where(urls.crawlable(F.col("url"))).select("url").distinct()
    return crawl.shallowest_trap(rows, _traps(spark, d))


def priority_bands(spark, d):
    return _tasks(spark, d).groupBy(crawl.priority_band(F.col("priority")).alias("band")).agg(F.count("*").alias("n"), F.min("priority").alias("low"), F.max("priority").alias("high"))


def frontier_enqueue(spark, d):
    return crawl.enqueue(_keyed(spark, d).select("domain", "key", "ord"), cap=200).select("domain", "key", "ord", "place")


def frontier_enqueue_full(spark, d):
    """CR-12 by the canonical address, at the production cap."""
    return crawl.enqueue(_keyed_full(spark, d).select("domain", "key", "ord")).select("domain", "key", "ord", "place")


def frontier_lease(spark, d):
    """The oldest task of every host that is due: hosts wait a second for each fetch made of them."""
    queue = _tasks(spark, d).where("domain is not null and url is not null").select("domain", F.col("task_id").alias("ord"), "url")
    last = read_table(spark, d, "fetch_results").select(urls.domain_of_host(urls.url_host(F.col("url"))).alias("domain"), "fetched_at").where("domain is not null").groupBy("domain").agg(F.max("fetched_at").alias("due_at"))
    return crawl.lease(queue, last, F.lit(LATE).cast("timestamp_ntz"))


def latest_validators(spark, d):
    return crawl.latest_validators(_tasks(spark, d).select("url", "etag", "last_modified", F.struct("offered_at", "task_id").alias("at")))


def domain_ownership(spark, d):
    return crawl.consistent_owner(_tasks(spark, d).where("domain is not null").select("domain").distinct(), "domain", NODES)


def fetch_outcomes(spark, d):
    """Classes by status, limiter signals and next steps of every fetch, counted."""
    f = read_table(spark, d, "fetch_results")
    kind = F.coalesce(F.when(F.col("outcome").isin("robots_denied", "robots_unreachable", "rate_limited", "timeout", "network_error", "dns_failed"), F.col("outcome")), crawl.classify_status(F.col("status"), F.coalesce(F.octet_length("body"), F.lit(0))), F.col("outcome"))
    rows = f.withColumn("kind", kind).withColumn("signal", crawl.limiter_signal(F.col("kind"), F.col("elapsed_s")))
    noindex = crawl.robots_tag_noindex(crawl.header(F.col("headers"), "x-robots-tag"))
    step = crawl.next_step(F.col("kind"), F.lit(1), F.col("retry_after_s"), noindex)
    return rows.withColumn("step", step).groupBy("kind", "signal", F.col("step.action").alias("action"), F.col("step.delay_s").alias("delay_s")).agg(F.count("*").alias("n"))


def content_types(spark, d):
    """Media type and charset label of the header, whatever the case of its name."""
    value = F.lower(crawl.header(F.col("headers"), "content-type"))
    rows = read_table(spark, d, "fetch_results").select(F.trim(F.split_part(value, F.lit(";"), F.lit(1))).alias("media_type"), F.regexp_extract(value, "charset\\s*=\\s*[\"']?\\s*([a-z0-9_:.+-]+)", 1).alias("charset"))
    return rows.groupBy("media_type", F.nullif("charset", F.lit("")).alias("charset")).agg(F.count("*").alias("n"))


def change_rates(spark, d):
    f = read_table(spark, d, "fetch_results").select("url", "content_hash", F.col("fetched_at").cast("timestamp").alias("at"))
    return crawl.change_rates(f).select("url", "visits", "changes", F.round("days", 6).alias("days"), F.round("rate", 4).alias("rate"))


def outcome_runs(spark, d):
    f = read_table(spark, d, "fetch_results").select(urls.domain_of_host(urls.url_host(F.col("url"))).alias("url"), "outcome", F.col("fetched_at").alias("at"), F.col("fetch_id").alias("ord"))
    return crawl.outcome_runs(f)


def redirect_chains(spark, d):
    f = read_table(spark, d, "fetch_results")
    return crawl.follow_redirects(f.select("url", F.col("redirect_target").alias("target"))).select("url", "final_url", "hops", "outcome")


def _signals(spark, d):
    f = read_table(spark, d, "fetch_results")
    return f.select(urls.domain_of_host(urls.url_host(F.col("url"))).alias("domain"), F.col("fetch_id").alias("ord"), crawl.limiter_signal(F.col("outcome"), F.col("elapsed_s")).alias("signal"), "fetched_at")


def aimd_fold(spark, d):
    rows = crawl.aimd_fold(_signals(spark, d))
    return rows.withColumn("rate", F.round("rate", 6))


def token_bucket_fold(spark, d):
    """Which fetches a bucket of one request in ten minutes would have let pass."""
    rows = _signals(spark, d).select("domain", "ord", F.floor(monitor.micros(F.col("fetched_at")) / 1000).cast("bigint").alias("at_ms"))
    return crawl.token_bucket_fold(rows, rate=1 / 600)


def _refreshes(keyed):
    return keyed.where("domain is not null").groupBy("domain").agg(F.count("*").alias("offers"), F.count_distinct("key").alias("addresses")).withColumn("refresh_share", F.round(1 - F.col("addresses") / F.col("offers"), 6))


def refresh_split(spark, d):
    """CR-38: per domain the offers, the distinct addresses and the share of refreshes."""
    return _refreshes(_keyed(spark, d))


def refresh_split_full(spark, d):
    """CR-38 by the canonical address."""
    return _refreshes(_keyed_full(spark, d))


def message_events(spark, d):
    """IO-07: the message of every fetch, without its id."""
    f = read_table(spark, d, "fetch_results")
    millis = F.round(F.col("elapsed_s") * 1000).cast("bigint")
    return f.select("url", "outcome", F.coalesce("status", F.lit(-1)).alias("status"), "content_hash", F.coalesce(F.octet_length("body"), F.lit(0)).cast("bigint").alias("size_bytes"), F.coalesce(millis, F.lit(-1)).alias("elapsed_ms"), "redirect_target", "redirect_permanent", crawl.header(F.col("headers"), "etag").alias("etag"))


def stored_blobs(spark, d):
    """IO-01/02: distinct blobs of the messages beside the stored ones: named, stored, and missing."""
    from ..operators.delivery import blob_name

    stored = read_table(spark, d, "blob_refs").where("key is not null").groupBy(F.col("key").alias("blob")).agg(F.max("size_bytes").alias("size_bytes"))
    named = read_table(spark, d, "fetched_messages").select(blob_name(F.col("blob")).alias("blob")).where("blob is not null").groupBy("blob").agg(F.count("*").alias("messages"))
    return named.join(stored.withColumn("_s", F.lit(True)), "blob", "full").select("blob", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("_s", F.lit(False)).alias("stored"), F.coalesce("size_bytes", F.lit(-1)).alias("size_bytes"))


# --- graph -------------------------------------------------------------------------------------------


def _host_edges(spark, d):
    links = _tasks(spark, d).select(urls.domain_of_host(urls.url_host(F.col("source_url"))).alias("s"), urls.domain_of_host(urls.url_host(F.col("url"))).alias("t"), "depth", "priority")
    # links within a host say nothing on hosts; depth-0 offers name the hosts they come to
    return links.select("s", "t")


def _word_edges(spark, d):
    """A denser graph: hosts linked to the first path segment of their pages and back."""
    rows = _tasks(spark, d).where(urls.crawlable(F.col("url"))).select(urls.url_host(F.col("url")).alias("h"), F.split_part(urls.url_path(F.col("url")), F.lit("/"), F.lit(2)).alias("p")).where("p <> ''")
    there = rows.select(F.col("h").alias("src"), F.concat(F.lit("/"), "p").alias("dst"))
    back = rows.where("length(p) <= 4").select(F.concat(F.lit("/"), "p").alias("src"), F.col("h").alias("dst"))
    return graph.edges_of(there.union(back).union(_host_edges(spark, d).select(F.col("s").alias("src"), F.col("t").alias("dst"))), "src", "dst")


def pagerank(spark, d):
    return graph.pagerank(_word_edges(spark, d), 10).select("node", F.round("rank", 9).alias("rank"))


def _page_edges(spark, d):
    """Hosts linked by the pages that were fetched."""
    from .content import page_links

    links = page_links(spark, d).where("rel = 'follow'")
    return graph.edges_of(links.select(urls.url_host(F.col("url")).alias("s"), urls.url_host(F.col("target_url")).alias("t")), "s", "t")


def link_graph_rank(spark, d):
    """RK-20 on the links of the pages themselves, by host."""
    return graph.log_rank(graph.pagerank(_page_edges(spark, d), 10)).select("node", F.round("rank", 9).alias("rank"), F.round("log_rank", 6).alias("log_rank"))


def link_graph_hits(spark, d):
    """RK-23 on the links of the pages themselves, by host."""
    return graph.hits(_page_edges(spark, d), 4).select("node", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


def log_rank(spark, d):
    return graph.log_rank(graph.pagerank(_word_edges(spark, d), 10)).select("node", F.round("log_rank", 6).alias("log_rank"))


def trustrank(spark, d):
    edges = _word_edges(spark, d)
    seeds = graph.nodes_of(edges).where("node like 'www.%'")
    return graph.pagerank(edges, 10, seeds=seeds).select("node", F.round("rank", 9).alias("rank"))


def hits(spark, d):
    return graph.hits(_word_edges(spark, d), 4).select("node", F.round("hub", 9).alias("hub"), F.round("authority", 9).alias("authority"))


def linked_components(spark, d):
    rows = _tasks(spark, d).where(urls.crawlable(F.col("url"))).select(urls.url_host(F.col("url")).alias("src"), urls.url_host(F.col("source_url")).alias("dst"))
    own = graph.edges_of(rows.union(rows.select(urls.domain_of_host(F.col("src")), F.col("src"))), "src", "dst")
    return graph.connected_components(own)


def _anchors(spark, d):
    host = urls.url_host(F.col("url"))
    rows = _tasks(spark, d).where(urls.crawlable(F.col("url"))).select(urls.domain_of_host(host).alias("target"), urls.url_host(F.col("source_url")).alias("source_domain"), F.split_part(urls.url_path(F.col("url")), F.lit("/"), F.lit(2)).alias("term"))
    return rows.where("term <> '' and source_domain is not null")


def anchor_aggregate(spark, d):
    return ranking.aggregate_anchors(_anchors(spark, d), cap=2)


def anchor_diversity(spark, d):
    return _anchors(spark, d).groupBy("target").agg(F.count_distinct("source_domain").alias("domains"), F.count("*").alias("links"))


# --- duplicates --------------------------------------------------------------------------------------


def exact_dups(spark, d):
    return dedup.exact_copies(read_table(spark, d, "documents"), "doc_id", "text")


def shingle_counts(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.size(dedup.shingles(words)).cast("bigint").alias("shingles"))


def simhash_values(spark, d):
    return dedup.simhashes(read_table(spark, d, "documents"), "doc_id", "text")


def near_duplicate_classes(spark, d):
    """One row per document: its class and the number of links of its text."""
    return dedup.near_duplicate_classes(read_table(spark, d, "documents"), "doc_id", "text")


def simhash_classes(spark, d):
    """The same by SimHash distance alone, for reference."""
    return dedup.simhash_classes(read_table(spark, d, "documents"), "doc_id", "text")


def canonical_election(spark, d):
    """Of the exact copies the longest text stays, the earlier of equal ones."""
    docs = read_table(spark, d, "documents")
    copies = dedup.exact_copies(docs, "doc_id", "text").join(docs.select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id")
    return dedup.elect(copies, "copy_of", "doc_id", "score")


# --- monitoring --------------------------------------------------------------------------------------


def _events(spark, d):
    return read_table(spark, d, "events")


def second_sight_cache(spark, d):
    return monitor.second_sight(_events(spark, d), ["user_id", "event_type"], 3600).select("event_id", "user_id", "event_type")


def cache_simulation(spark, d):
    return monitor.cache_hits(_events(spark, d), ["event_type", "user_id"], 3600)


def quota_per_minute(spark, d):
    return monitor.over_quota(_events(spark, d), ["event_type"], "1 minute", 2)


def burn_rate(spark, d):
    rows = monitor.burn_rate(_events(spark, d), F.col("event_type") == "error", 1, 6, 0.2)
    return rows.select("hour", "n", "bad", F.round("short_burn", 6).alias("short_burn"), F.round("long_burn", 6).alias("long_burn"))


def user_sessions(spark, d):
    return monitor.sessions(_events(spark, d), 1800)


def reformulation_sessions(spark, d):
    return monitor.abandonment(_events(spark, d), "view", "click", 3600)


def day_over_day(spark, d):
    days = _events(spark, d).groupBy(F.floor(monitor.micros(F.col("ts")) / 86_400_000_000).cast("bigint").alias("day")).agg(F.count("*").alias("n"))
    return monitor.day_over_day(days, -0.05, 0.05).select("day", "n", F.round("day_change", 6).alias("day_change"), F.round("week_change", 6).alias("week_change"), "alert")


def corpus_health(spark, d):
    """Documents by language and source with totals (rollup), text lengths and duplicate shares."""
    docs = read_table(spark, d, "documents")
    rows = docs.withColumn("_key", F.md5("text")).rollup("lang", "source").agg(
        F.grouping_id().alias("level"), F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.percentile("n_chars", 0.5).alias("median_chars"), F.count_distinct("_key").alias("texts")
    )
    return rows.withColumn("level", F.col("level").cast("bigint"))


def freshness_sli(spark, d):
    """Messages delivered within a day of their fetch."""
    m = read_table(spark, d, "fetched_messages").where("delivered_at is not null and fetched_at is not null")
    age = (monitor.micros(F.col("delivered_at")) - monitor.micros(F.col("fetched_at"))) / 1e6
    return monitor.freshness(m, age).withColumn("fresh_share", F.round("fresh_share", 6))


def body_size_histogram(spark, d):
    rows = read_table(spark, d, "fetch_results").select("outcome", F.octet_length("body").alias("size"))
    return monitor.histogram(rows, "size", [1000, 2000, 4000, 8000, 16000], ["outcome"])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        url_canonical_native, url_canonical, url_identity, url_host_parts, url_path_prefixes, url_token_counts, seen_url_filter, seen_stats, site_budgets, site_budget_admission,
        trap_detect, trap_detect_sketch, trapped_urls, priority_bands, frontier_enqueue, frontier_lease, latest_validators, domain_ownership, fetch_outcomes, content_types,
        change_rates, outcome_runs, redirect_chains, aimd_fold, token_bucket_fold, refresh_split, message_events, stored_blobs, pagerank, link_graph_rank, link_graph_hits, log_rank, trustrank, hits, linked_components,
        seen_url_filter_full, seen_stats_full, frontier_enqueue_full, refresh_split_full, site_budgets_full, site_budget_admission_full,
        anchor_aggregate, anchor_diversity, exact_dups, shingle_counts, simhash_values, near_duplicate_classes, simhash_classes, canonical_election, second_sight_cache, cache_simulation,
        quota_per_minute, burn_rate, user_sessions, reformulation_sessions, day_over_day, corpus_health, freshness_sli, body_size_histogram,
    )
}

_JUNK = ", ".join(f"'{x}'" for x in sorted(urls.JUNK_PARAMS))
_TWO = ", ".join(f"'{x}'" for x in sorted(urls.TWO_LABEL_SUFFIXES))


def _canon(url: str) -> str:
    query = f"regexp_extract({url}, '\\?([^#]*)', 1)"
    kept = f"list_sort(list_filter(string_split({query}, '&'), lambda p: p <> '' and lower(split_part(p, '=', 1)) not in ({_JUNK})))"
    path = f"regexp_extract({url}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
    return (
        f"lower(regexp_extract({url}, '^([a-zA-Z]+)://', 1)) || '://' || regexp_replace(lower(regexp_extract({url}, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#]*)', 1)), '\\.?(:80|:443)?$', '') || "
        f"case when {path} = '' then '/' else {path} end || case when len({kept}) > 0 then '?' || array_to_string({kept}, '&') else '' end"
    )


def canonical_ctes(table: str, extra: str, name: str = "canon") -> str:
    """canon(key, extra columns): the whole of the canonical form in SQL, but for hosts beyond ascii. Null where an address has no key."""
    junk, safe = _JUNK, "[A-Za-z0-9_.~/%:@!$&''()*+,;=-]"
    resolved = ", ".join(f"'{ord(ch):02X}'" for ch in urls.RESOLVED)
    octet = f"case when regexp_matches(x, '^[0-9a-fA-F]{{2}}') then (case when upper(x[1:2]) in ({resolved}) then chr(('0x' || x[1:2])::int) else '%' || upper(x[1:2]) end) || x[3:] else '%' || x end"
    plus = "replace(url_encode({0}), '%20', '+')"
    return f"""{name}_split as (select {extra}, regexp_extract(trim(translate(url, chr(9) || chr(10) || chr(13), ''), ' '), '(?is)^(https?)://([^/?#]*)([^?#]*)(?:[?]([^#]*))?(?:#.*)?$', ['scheme', 'auth', 'path', 'query']) as u from {table} where url is not null),
{name}_named as (select {extra}, lower(u.scheme) as scheme, regexp_extract(regexp_replace(u.auth, '^.*@', ''), '^([^:]*)(?::(.*))?$', ['host', 'port']) as h, contains(u.auth, '[') or contains(u.auth, ']') as bracket, u.path as path, u.query as query from {name}_split),
{name}_resolved as (select *, rtrim(lower(h.host), '.') as host, string_split(path, '%')[1] || coalesce(array_to_string(list_transform(string_split(path, '%')[2:], lambda x: {octet}), ''), '') as p1 from {name}_named),
{name}_folded as (select *, case when contains(p1, '/.') then list_reduce(string_split(p1, '/'), lambda acc, x: case x when '.' then acc when '..' then regexp_replace(acc, '/[^/]+$', '') else acc || '/' || x end) else p1 end as p2 from {name}_resolved),
{name}_quoted as (select *, case when p2 = '' then '/' when regexp_full_match(p2, '{safe}*') then p2 else array_to_string(list_transform(string_split(p2, ''), lambda ch: case when regexp_full_match(ch, '{safe}') then ch else url_encode(ch) end), '') end as p3 from {name}_folded),
{name}_asked as (select *, list_sort(list_filter(list_transform(list_filter(string_split(query, '&'), lambda x: x <> ''), lambda x: {{'k': url_decode(replace(split_part(x, '=', 1), '+', ' ')), 'v': url_decode(replace(substr(x, length(split_part(x, '=', 1)) + 2), '+', ' '))}}), lambda x: lower(x.k) not in ({junk}))) as q from {name}_quoted),
{name} as (select {extra}, case when scheme = '' or host = '' or bracket or not regexp_full_match(h.port, '[0-9]*') or coalesce(try_cast(h.port as bigint), 0) > 65535 then null
  else scheme || '://' || host || case when h.port = '' or (scheme = 'http' and coalesce(try_cast(h.port as int), -1) = 80) or (scheme = 'https' and coalesce(try_cast(h.port as int), -1) = 443) then '' else ':' || coalesce(try_cast(h.port as int), -1) end
    || case when regexp_matches(p3, '/[^/]*[.][^/]*/$') then rtrim(p3, '/') else p3 end
    || case when len(q) > 0 then '?' || array_to_string(list_transform(q, lambda x: {plus.format('x.k')} || '=' || {plus.format('x.v')}), '&') else '' end end as key from {name}_asked)"""


def _host(url: str) -> str:
    return f"nullif(regexp_extract(lower({url}), '^https?://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '')"


def _domain(host: str) -> str:
    labels = f"string_split({host}, '.')"
    two = f"array_to_string(list_slice({labels}, greatest(len({labels}) - 1, 1), len({labels})), '.')"
    return (
        f"case when {host} is null then null when regexp_matches({host}, '^[0-9.]+$') or len({labels}) < 2 then {host} "
        f"when {two} in ({_TWO}) and len({labels}) >= 3 then array_to_string(list_slice({labels}, len({labels}) - 2, len({labels})), '.') else {two} end"
    )


def _prefixes(url: str) -> str:
    segs = f"list_transform(list_filter(string_split(regexp_extract({url}, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> ''), lambda s: case when regexp_matches(s, '^([0-9]+|[0-9a-fA-F]{{8,}})$') then '*' else s end)"
    return f"list_transform(range(1, least(len({segs}), 4) + 1), lambda i: {_host(url)} || '/' || array_to_string(list_slice({segs}, 1, i), '/'))"


_CRAWLABLE = "regexp_matches(lower(url), '^https?://')"
_KEYED = f"keyed as (select {_canon('url')} as key, task_id as ord, domain, url from crawl_tasks where {_CRAWLABLE}), seen as (select distinct {_canon('url')} as key from fetch_results where {_CRAWLABLE})"
_FETCH_DOMAIN = _domain(_host("url"))
_BUDGETS = f"""spent as (select {_FETCH_DOMAIN} as domain, count(*) as spent from fetch_results group by 1),
budgets as (select a.domain, floor(2 * ln(2 + 1000 * authority))::bigint as lim, floor(2 * ln(2 + 1000 * authority))::bigint - coalesce(spent, 0) as room
  from (select domain, avg(priority) / 1000 as authority from crawl_tasks where domain is not null group by 1) a left join spent using (domain))"""
_TRAPS = f"""hit as (select unnest({_prefixes("url")}) as prefix, content_hash from fetch_results where content_hash is not null and {_CRAWLABLE}),
traps as (select prefix, count(*) as urls, count(distinct content_hash) as distinct_bodies from hit group by 1 having count(*) >= {TRAP_MIN} and count(distinct content_hash) / count(*) < {TRAP_SHARE})"""
_SIGNAL = """case when outcome in ('throttled', 'server_error', 'network_error', 'timeout', 'dns_failed') then 'err'
  when outcome in ('robots_denied', 'robots_unreachable', 'rate_limited') then 'none' when outcome = 'fetched' and elapsed_s > 5 then 'slow' else 'ok' end"""
_EDGES = f"""rows as (select {_host("url")} as h, split_part(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/', 2) as p from crawl_tasks where {_CRAWLABLE}),
edges as (select distinct src, dst from (
  select h as src, '/' || p as dst from rows where p <> '' union all select '/' || p, h from rows where p <> '' and length(p) <= 4
  union all select {_domain(_host("source_url"))}, {_domain(_host("url"))} from crawl_tasks) where src is not null and dst is not null and src <> dst),
nodes as (select src as node from edges union select dst from edges), degree as (select src as node, count(*) as degree from edges group by 1)"""


def _rank_sql(seeds: str | None) -> str:
    jump = "1.0::double" if seeds is None else f"case when {seeds} then 1.0::double else 0 end"
    out = f"with {_EDGES}, base as materialized (select node, {jump} / sum({jump}) over () as jump, degree from nodes left join degree using (node)), r0 as (select node, jump as rank from base)"
    for i in range(10):
        out += f""", r{i + 1} as materialized (
  select b.node, 0.15::double * b.jump + 0.85::double * (coalesce(x.received, 0) + d.lost * b.jump) as rank from base b
  left join (select e.dst as node, sum(r.rank / g.degree) as received from edges e join r{i} r on r.node = e.src join degree g on g.node = e.src group by 1) x using (node),
  (select coalesce(sum(rank), 0) as lost from r{i} join base using (node) where degree is null) d)"""
    return out


def _hits_sql() -> str:
    out = f"with {_EDGES}, h0 as (select node, 1.0::double as hub from nodes)"
    for i in range(4):
        out += f""", a{i + 1} as materialized (select node, authority / sum(authority) over () as authority from (select e.dst as node, sum(hub) as authority from edges e join h{i} h on h.node = e.src group by 1)),
h{i + 1} as materialized (select node, hub / sum(hub) over () as hub from (select e.src as node, sum(authority) as hub from edges e join a{i + 1} a on a.node = e.dst group by 1))"""
    return out + " select node, round(coalesce(hub, 0), 9) as hub, round(coalesce(authority, 0), 9) as authority from nodes left join h4 using (node) left join a4 using (node)"


_HEADER = "list_filter(map_entries(headers), lambda e: lower(e.key) = '{name}')[1].value"
_KIND = """coalesce(case when outcome in ('robots_denied', 'robots_unreachable', 'rate_limited', 'timeout', 'network_error', 'dns_failed') then outcome end,
  case when status in (301, 302, 303, 307, 308) then 'redirected' when status = 304 then 'not_modified' when status in (429, 503) then 'throttled' when status in (404, 410) then 'gone'
       when status >= 400 and status < 500 then 'client_error' when status >= 500 then 'server_error'
       when status >= 200 and status < 300 and coalesce(octet_length(body), 0) > 10485760 then 'too_large' when status >= 200 and status < 300 then 'fetched' end, outcome)"""
_ENTRY = "lambda p: trim(regexp_replace(p, '^\\s*sieveworkbot\\s*:', '')) in ('noindex', 'none')"

_SHINGLED = """w as (select doc_id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
runs as (select doc_id, text, case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as r from w)"""

SQL: dict[str, str] = {
    "url_canonical": f"with {canonical_ctes('crawl_tasks', 'task_id')} select t.task_id, c.key as canonical from crawl_tasks t left join canon c using (task_id)",
    "redirect_chains": """with recursive e as (select url, min(redirect_target) as target from fetch_results where url is not null and redirect_target is not null group by 1),
f as (
  select url, target as final_url, [url] as met, 1 as hops, 0 as round from e
  union all
  select f.url, case when go then n.target else final_url end, case when go then list_append(met, final_url) else met end, case when go then hops + 1 else hops end, round + 1
  from (select *, not list_contains(met, final_url) and final_url in (select url from e) as go from f where round < 5) f left join e n on n.url = f.final_url)
select url, final_url, hops, case when list_contains(met, final_url) then 'loop' when hops > 5 then 'too_many' else 'resolved' end as outcome from f where round = 5""",
    "token_bucket_fold": f"""with recursive r as (select {_FETCH_DOMAIN} as domain, fetch_id as ord, floor(epoch_us(fetched_at) / 1000)::bigint as at_ms,
  row_number() over (partition by {_FETCH_DOMAIN} order by floor(epoch_us(fetched_at) / 1000)::bigint, fetch_id) as n from fetch_results where {_FETCH_DOMAIN} is not null),
f as (
  select distinct domain, 0::bigint as ord, false as allowed, 0::bigint as wait_ms, 2.0::double as held, null::bigint as last, 0::bigint as n from r
  union all
  select domain, ord, level >= 1, case when level >= 1 then 0 else ceil((1 - level) / (1.0::double / 600) * 1000)::bigint end, case when level >= 1 then level - 1 else held end, case when level >= 1 then at_ms else last end, n
  from (select r.domain, r.ord, r.at_ms, r.n, f.held, f.last, least(2.0::double, f.held + greatest(0, coalesce(r.at_ms - f.last, 0)) / 1000.0::double * (1.0::double / 600)) as level from f join r on r.domain = f.domain and r.n = f.n + 1))
select domain, ord, allowed, wait_ms from f where n > 0""",
    "linked_components": f"""with recursive raw as (select {_host("url")} as s, {_host("source_url")} as t from crawl_tasks where {_CRAWLABLE}),
e as (select distinct s, t from (select s, t from raw union all select {_domain("s")}, s from raw) where s is not null and t is not null and s <> t),
ways as (select s, t from e union select t, s from e),
walk as (select distinct s as node, s as component from ways union select b.t, w.component from walk w join ways b on b.s = w.node where w.component < b.t)
select node, min(component) as component from walk group by 1""",
    "simhash_values": f"""with {_SHINGLED}, h as (select doc_id, len(r) as n, unnest(r) as x from runs),
bits as (select doc_id, n, b, sum(((('0x' || substr(md5(x), 1, 16))::ubigint >> b) & 1)::bigint) as ones from h, (select unnest(range(64))::ubigint as b) group by 1, 2, 3),
v as (select doc_id, sum(case when 2 * ones > n then (1::hugeint << b::int) else 0::hugeint end) as v from bits group by 1)
select d.doc_id, (case when v >= 9223372036854775808::hugeint then v - 18446744073709551616::hugeint else v end)::bigint as simhash from documents d left join v using (doc_id)""",
    "near_duplicate_classes": f"""with recursive {_SHINGLED}, keyed as (select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as k, list_sort(list_distinct(r)) as r from runs where len(r) > 0),
sets as (select md5(array_to_string(r, chr(1))) as sig, any_value(r) as r, min(doc_id) as rep, count(distinct k) as texts from keyed group by 1),
x as (select rep, unnest(r) as x from sets),
pairs as (select a.rep as a, b.rep as b from x a join x b on a.x = b.x and a.rep <> b.rep join sets sa on sa.rep = a.rep join sets sb on sb.rep = b.rep group by 1, 2, sa.r, sb.r having 9 * count(*) >= 4 * (len(sa.r) + len(sb.r))),
walk as (select rep as node, rep as class_id from sets union select p.b, w.class_id from walk w join pairs p on p.a = w.node where w.class_id < p.b),
classes as (select node, min(class_id) as class_id from walk group by 1),
others as (select p.a as rep, sum(s.texts) as n from pairs p join sets s on s.rep = p.b group by 1)
select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, coalesce(s.texts - 1 + coalesce(o.n, 0), 0)::bigint as links
from documents d left join keyed k using (doc_id) left join sets s on s.sig = md5(array_to_string(k.r, chr(1))) left join classes c on c.node = s.rep left join others o on o.rep = s.rep""",
    "url_token_counts": f"""with raw as (select concat_ws(' ', regexp_replace({_host("url")}, '^www\\.', ''), url_decode(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1))) as t from crawl_tasks where {_CRAWLABLE}),
p as (select unnest(list_filter(string_split_regex(lower(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda x: length(x) >= 2 and not regexp_full_match(x, '[0-9a-f]{{8,}}') and x not in ('html', 'htm', 'php', 'asp', 'aspx', 'jsp', 'index', 'www'))[:64]) as token from raw)
select token, count(*)::bigint as n from p group by 1""",
    "url_canonical_native": f"select task_id, {_canon('url')} as canonical from crawl_tasks where {_CRAWLABLE}",
    "url_host_parts": f"select host, {_domain('host')} as registrable, count(*)::bigint as offers from (select {_host('url')} as host from crawl_tasks) where host is not null group by 1, 2",
    "url_path_prefixes": f"select prefix, count(*)::bigint as offers from (select unnest({_prefixes('url')}) as prefix from crawl_tasks where {_CRAWLABLE}) group by 1",
    "seen_url_filter": f"with {_KEYED} select key, min(ord)::bigint as ord, count(*)::bigint as offers from keyed where key not in (select key from seen) group by 1",
    "seen_stats": f"""with {_KEYED}, per as (select key, count(*) as n, key in (select key from seen) as known from keyed group by 1)
select sum(n)::bigint as checked, count(*)::bigint as unique_keys, count_if(known)::bigint as already_seen, round(1 - count_if(not known) / sum(n), 6) as absorption from per""",
    "site_budgets": f'with {_BUDGETS} select domain, lim as "limit", room::bigint as "left" from budgets',
    "site_budget_admission": f"""with {_BUDGETS}, numbered as (select domain, task_id, row_number() over (partition by domain order by task_id) - 1 as place from crawl_tasks where domain is not null)
select domain, task_id, place::bigint as place from numbered join budgets using (domain) where place < greatest(room, 0)""",
    "trap_detect": f"with {_TRAPS} select prefix, (length(prefix) - length(replace(prefix, '/', '')))::int as depth, urls::bigint as urls, distinct_bodies::bigint as distinct_bodies from traps",
    "trapped_urls": f"""with {_TRAPS}, offered as (select distinct url from crawl_tasks where {_CRAWLABLE}), each as (select url, unnest({_prefixes("url")}) as prefix from offered)
select url, arg_min(prefix, length(prefix) - length(replace(prefix, '/', ''))) as prefix from each where prefix in (select prefix from traps) group by 1""",
    "priority_bands": "select least(7, greatest(0, floor(priority * 8 / 1000)))::int as band, count(*)::bigint as n, min(priority) as low, max(priority) as high from crawl_tasks group by 1",
    "frontier_enqueue": f"""with {_KEYED}, once as (select domain, key, min(ord) as ord from keyed where domain is not null group by 1, 2)
select domain, key, ord::bigint as ord, place::bigint as place from (select *, row_number() over (partition by domain order by ord) - 1 as place from once) where place < 200""",
    "frontier_lease": f"""with due as (select {_FETCH_DOMAIN} as domain, max(fetched_at) as due_at from fetch_results group by 1)
select domain, due_at, min(task_id)::bigint as ord, arg_min(url, task_id) as url from crawl_tasks join due using (domain) where url is not null and due_at <= timestamp '{LATE}' group by 1, 2""",
    "latest_validators": """select url, arg_max(etag, (offered_at, task_id)) filter (where etag is not null) as etag, arg_max(last_modified, (offered_at, task_id)) filter (where last_modified is not null) as last_modified
from crawl_tasks where url is not null group by 1""",
    "domain_ownership": f"""with ring as (select node, ('0x' || substr(md5(node || '#' || v), 1, 8))::bigint as spot from (values {", ".join(f"('{n}')" for n in NODES)}) n(node), range(150) r(v)),
keys as (select distinct domain, ('0x' || substr(md5(domain), 1, 8))::bigint as h from crawl_tasks where domain is not null)
select domain, coalesce(arg_min(node, (spot, node)) filter (where spot >= h), arg_min(node, (spot, node))) as node from keys, ring group by domain""",
    "fetch_outcomes": f"""with kinds as (select *, {_KIND} as kind from fetch_results),
steps as (select kind, {_SIGNAL.replace("outcome", "kind")} as signal,
  case when kind = 'fetched' then case when len(list_filter(string_split(lower(coalesce({_HEADER.format(name="x-robots-tag")}, '')), ','), {_ENTRY})) > 0 then 'store' else 'emit' end
       when kind = 'not_modified' then 'emit' when kind = 'gone' then 'tombstone'
       when kind in ('throttled', 'server_error', 'network_error', 'timeout', 'dns_failed', 'robots_unreachable', 'rate_limited') then 'requeue' else 'release' end as action,
  case when kind = 'throttled' then greatest(1, least(coalesce(retry_after_s, 60), 300)) when kind in ('server_error', 'network_error', 'timeout', 'dns_failed') then 60
       when kind = 'robots_unreachable' then 600 when kind = 'rate_limited' then greatest(coalesce(retry_after_s, 0), 1) end::double as delay_s from kinds)
select kind, signal, action, delay_s, count(*)::bigint as n from steps group by 1, 2, 3, 4""",
    "content_types": f"""with h as (select lower({_HEADER.format(name="content-type")}) as v from fetch_results)
select trim(split_part(v, ';', 1)) as media_type, nullif(regexp_extract(v, 'charset\\s*=\\s*["'']?\\s*([a-z0-9_:.+-]+)', 1), '') as charset, count(*)::bigint as n from h group by 1, 2""",
    "change_rates": """with v as (select url, content_hash, fetched_at as seen_at, lag(content_hash) over w as last, lag(fetched_at) over w as last_at from fetch_results
  where url is not null and content_hash is not null window w as (partition by url order by fetched_at, content_hash)),
per as (select url, count(*) as visits, count_if(last <> content_hash) as changes, coalesce(sum((epoch_us(seen_at) - epoch_us(last_at)) / 86400e6), 0) as days from v group by 1)
select url, visits::bigint as visits, changes::bigint as changes, round(days, 6) as days, round(case when days > 0 then changes / days end, 4) as rate from per where visits > 1""",
    "outcome_runs": f"""with f as (select {_FETCH_DOMAIN} as url, outcome, fetched_at as seen_at, fetch_id as ord from fetch_results),
r as (select *, row_number() over (partition by url order by seen_at, ord) - row_number() over (partition by url, outcome order by seen_at, ord) as run from f where url is not null and outcome is not null)
select url, outcome, run::int as run, min(seen_at) as first_at, max(seen_at) as last_at, count(*)::bigint as length from r group by 1, 2, 3""",
    "aimd_fold": f"""with recursive f as (select {_FETCH_DOMAIN} as domain, fetch_id as ord, {_SIGNAL} as signal, row_number() over (partition by {_FETCH_DOMAIN} order by fetch_id) as n from fetch_results where {_FETCH_DOMAIN} is not null),
s(domain, n, ord, rate, streak) as (
  select domain, 0::bigint, null::bigint, 1.0::double, 0 from (select distinct domain from f)
  union all
  select f.domain, f.n, f.ord,
    case signal when 'err' then greatest(0.05, rate * 0.5) when 'slow' then greatest(0.05, rate * 0.75) when 'ok' then case when streak + 1 >= 10 then least(5.0, rate + 0.25) else rate end else rate end::double,
    case signal when 'err' then 0 when 'slow' then 0 when 'ok' then case when streak + 1 >= 10 then 0 else streak + 1 end else streak end
  from s join f on f.domain = s.domain and f.n = s.n + 1)
select domain, ord, round(rate, 6) as rate, streak::bigint as streak from s where n > 0""",
    "refresh_split": f"""with {_KEYED} select domain, count(*)::bigint as offers, count(distinct key)::bigint as addresses, round(1 - count(distinct key) / count(*), 6) as refresh_share
from keyed where domain is not null group by 1""",
    "message_events": f"""select url, outcome, coalesce(status, -1) as status, content_hash, coalesce(octet_length(body), 0)::bigint as size_bytes, coalesce(round(elapsed_s * 1000)::bigint, -1) as elapsed_ms, redirect_target, redirect_permanent,
  {_HEADER.format(name="etag")} as etag from fetch_results""",
    "stored_blobs": """with named as (select coalesce(nullif(regexp_extract(blob, '([0-9]{4}/[0-9]{2}/[0-9]{2}/.*)$', 1), ''), blob) as blob, count(*) as messages from fetched_messages where blob is not null group by 1),
stored as (select key as blob, max(size_bytes) as size_bytes from blob_refs where key is not null group by 1)
select coalesce(n.blob, s.blob) as blob, coalesce(messages, 0)::bigint as messages, s.blob is not null as stored, coalesce(size_bytes, -1) as size_bytes from named n full join stored s on n.blob = s.blob""",
    "pagerank": f"{_rank_sql(None)} select node, round(rank, 9) as rank from r10",
    "log_rank": f"{_rank_sql(None)} select node, round(ln(1 + rank * count(*) over ()), 6) as log_rank from r10",
    "trustrank": f"{_rank_sql(chr(110) + 'ode like ' + chr(39) + 'www.%' + chr(39))} select node, round(rank, 9) as rank from r10",
    "hits": _hits_sql(),
    "anchor_aggregate": f"""with a as (select {_domain(_host("url"))} as target, {_host("source_url")} as sd, split_part(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/', 2) as term from crawl_tasks where {_CRAWLABLE}),
per as (select target, term, sd, count(*) as n from a where term <> '' and sd is not null and target is not null group by 1, 2, 3),
r as (select target, term, sum(least(n, 2)) as s, count(*) as domains from per group by 1, 2)
select target, term, domains::bigint as domains, (case when domains < 3 then greatest(1, floor(s * domains / 3)) else s end)::bigint as weight from r""",
    "anchor_diversity": f"""with a as (select {_domain(_host("url"))} as target, {_host("source_url")} as sd, split_part(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/', 2) as term from crawl_tasks where {_CRAWLABLE})
select target, count(distinct sd)::bigint as domains, count(*)::bigint as links from a where term <> '' and sd is not null group by 1""",
    "exact_dups": """with k as (select doc_id, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as key from documents where text is not null)
select doc_id, min(doc_id) over (partition by key) as copy_of, count(*) over (partition by key) as copies from k""",
    "shingle_counts": """with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null)
select doc_id, (case when len(w) >= 5 then len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')))) when len(w) > 0 then 1 else 0 end)::bigint as shingles from w""",
    "canonical_election": """with k as (select doc_id, n_chars, sha256(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as key from documents where text is not null),
m as (select *, min(doc_id) over (partition by key) as copy_of from k) select copy_of, arg_max(doc_id, (n_chars, -doc_id)) as elected from m group by 1""",
    "second_sight_cache": """select event_id, user_id, event_type from events qualify epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id, event_type order by ts, event_id)) <= 3600000000""",
    "cache_simulation": """with r as (select event_type, user_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) over (partition by event_type, user_id order by ts, event_id)) <= 3600000000, false) as hit from events)
select event_type, user_id, count(*)::bigint as requests, count_if(hit)::bigint as hits from r group by 1, 2""",
    "quota_per_minute": "select event_type, date_trunc('minute', ts) as window_start, count(*)::bigint as requests from events group by 1, 2 having count(*) > 2",
    "burn_rate": """with h as (select floor(epoch_us(ts) / 3600000000)::bigint as hour, count(*) as n, count_if(event_type = 'error') as bad from events group by 1)
select hour, n::bigint as n, bad::bigint as bad, round(bad / n / 0.2, 6) as short_burn,
  round(sum(bad) over w / sum(n) over w / 0.2, 6) as long_burn from h window w as (order by hour range between 5 preceding and current row)""",
    "user_sessions": """with m as (select *, coalesce(epoch_us(ts) - epoch_us(lag(ts) over w) > 1800000000, true)::int as fresh from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(fresh) over (partition by user_id order by ts, event_id) as session from m)
select user_id, session::bigint as session, min(ts) as started, max(ts) as ended, count(*)::bigint as events from s group by 1, 2""",
    "reformulation_sessions": """with r as (select user_id, event_type, lead(event_type) over w as nxt, coalesce((epoch_us(lead(ts) over w) - epoch_us(ts)) / 1e6 <= 3600, false) as soon
  from events where event_type in ('view', 'click') window w as (partition by user_id order by ts, event_id))
select user_id, count(*)::bigint as queries, count_if(not (soon and coalesce(nxt = 'click', false)))::bigint as abandoned, count_if(soon and nxt = 'view')::bigint as reformulated from r where event_type = 'view' group by 1""",
    "day_over_day": """with c as (select floor(epoch_us(ts) / 86400000000)::bigint as day, count(*) as n from events group by 1),
r as (select *, n / lag(n) over (order by day) - 1 as dc, n / lag(n, 7) over (order by day) - 1 as wc from c)
select day, n::bigint as n, round(dc, 6) as day_change, round(wc, 6) as week_change, coalesce(dc <= -0.05, false) or coalesce(wc >= 0.05, false) as alert from r""",
    "corpus_health": """select lang, source, grouping(lang, source)::bigint as level, count(*)::bigint as docs, sum(n_chars)::bigint as chars, quantile_cont(n_chars::double, 0.5) as median_chars,
  count(distinct md5(text))::bigint as texts from documents group by rollup (lang, source)""",
    "freshness_sli": """select count(*)::bigint as n, round(count_if(epoch_us(delivered_at) - epoch_us(fetched_at) <= 86400000000) / count(*), 6) as fresh_share
from fetched_messages where delivered_at is not null and fetched_at is not null""",
    "body_size_histogram": """select outcome, (case when s < 1000 then 0 when s < 2000 then 1 when s < 4000 then 2 when s < 8000 then 3 when s < 16000 then 4 else 5 end)::int as bucket, count(*)::bigint as n
from (select outcome, octet_length(body) as s from fetch_results) where s is not null group by 1, 2""",
}

# the full rules in place of the native ones, and production limits
_KEYED_FULL = (
    f"{canonical_ctes('crawl_tasks', 'task_id, domain, url')}, {canonical_ctes('fetch_results', 'fetch_id', 'canonf')}, "
    "keyed as (select key, task_id as ord, domain, url from canon where key is not null), seen as (select distinct key from canonf where key is not null)"
)
for _name in ("seen_url_filter", "seen_stats", "frontier_enqueue", "refresh_split"):
    SQL[f"{_name}_full"] = SQL[_name].replace(_KEYED, _KEYED_FULL).replace("place < 200", f"place < {crawl.QUEUE_CAP}")
for _name in ("site_budgets", "site_budget_admission"):
    SQL[f"{_name}_full"] = SQL[_name].replace("floor(2 * ln", f"floor({crawl.BUDGET_BASE} * ln")
SQL["simhash_classes"] = (
    SQL["simhash_values"].replace("with w as", "with recursive w as", 1).replace("select d.doc_id, (case", "hashed as (select d.doc_id, d.text, (case", 1).replace(" as simhash from documents d left join v using (doc_id)", " as simhash from documents d left join v using (doc_id))", 1).replace(
        "group by 1)\nhashed", "group by 1),\nhashed", 1
    )
    + """,
one as (select simhash, min(doc_id) as rep, count(distinct lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) as texts from hashed where simhash is not null group by 1),
pairs as (select a.rep as a, b.rep as b from one a join one b on a.rep <> b.rep and bit_count(xor(a.simhash, b.simhash)) <= 3),
walk as (select rep as node, rep as class_id from one union select p.b, w.class_id from walk w join pairs p on p.a = w.node where w.class_id < p.b),
classes as (select node, min(class_id) as class_id from walk group by 1), others as (select p.a as rep, sum(o.texts) as n from pairs p join one o on o.rep = p.b group by 1)
select h.doc_id, coalesce(c.class_id, h.doc_id) as class_id, coalesce(o.texts - 1 + coalesce(x.n, 0), 0)::bigint as links
from hashed h left join one o using (simhash) left join classes c on c.node = o.rep left join others x on x.rep = o.rep"""
)
