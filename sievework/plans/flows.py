"""Queries that write and read back: streams, segments, blobs, topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, urls
from ..operators import crawl, delivery, index
from ..session import read_table, scratch_path
from ..sources import blobs, segments, topics
from ..streaming import jobs
from .core import SQL as CORE_SQL
from .crawling import SQL as CRAWL_SQL
from .search import SQL as SEARCH_SQL

Query = Callable[[SparkSession, str], DataFrame]


def stream_hourly_counts(spark, d):
    return jobs.run_to_table(jobs.windowed_counts(jobs.table_stream(spark, d, "events"), ["event_type"]), "hourly")


def stream_sessions(spark, d):
    return jobs.run_to_table(jobs.session_counts(jobs.table_stream(spark, d, "events")), "sessions")


def stream_unique_messages(spark, d):
    return jobs.run_to_table(jobs.unique_messages(jobs.table_stream(spark, d, "fetched_messages")), "unique")


def stream_delivery(spark, d):
    """Deliveries to be dropped, after the stream has been merged."""
    store = delivery.DeliveryStore(spark)
    jobs.deliver(jobs.table_stream(spark, d, "fetched_messages", 8), store).awaitTermination()
    return delivery.repeated_deliveries(store, read_table(spark, d, "fetched_messages"))


def stream_aimd(spark, d):
    f = jobs.table_stream(spark, d, "fetch_results")
    signals = f.select(urls.domain_of_host(urls.url_host(F.col("url"))).alias("domain"), F.col("fetch_id").alias("ord"), crawl.limiter_signal(F.col("outcome"), F.col("elapsed_s")).alias("signal"))
    rows = jobs.run_to_table(jobs.aimd_rates(signals), "aimd")
    return rows.groupBy("domain").agg(F.max_by(F.struct(F.round("rate", 6).alias("rate"), "streak"), "last_ord").alias("_l")).select("domain", "_l.rate", "_l.streak")


def stream_second_sight(spark, d):
    return jobs.run_to_table(jobs.second_sight(jobs.table_stream(spark, d, "events"), ["user_id", "event_type"], 3600), "second-sight")


def segment_round_trip(spark, d):
    """Written, published, verified and read again: the dictionary of the serving generation."""
    path = scratch_path(spark, "segment")
    segments.write_segment(index.records(read_table(spark, d, "input_documents")), f"{path}/one", "a1")
    live = segments.Generations(spark, path)
    live.publish([f"{path}/one"])
    return live.table("dictionary").select("term", "doc_freq", "total_tf")


def segment_rules(spark, d):
    path = scratch_path(spark, "segment")
    segments.write_segment(index.records(read_table(spark, d, "input_documents")), path, "a1")
    return segments.broken_rules(segments.open_segment(spark, path)[1])


def blob_round_trip(spark, d):
    """Bodies stored once and read back: hash of what comes out, by key."""
    path = scratch_path(spark, "blobs")
    f = read_table(spark, d, "fetch_results").select("body", "content_hash", "fetched_at")
    stored = blobs.write_blobs(f, path)
    blobs.write_blobs(f, path)  # again: nothing is added
    return stored.join(blobs.read_blobs(spark, path), "key").select("content_hash", "size_bytes", F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("read_hash"))


def topic_round_trip(spark, d):
    """Links of all pages as JSON messages, read again as a stream."""
    path = scratch_path(spark, "topic")
    f = read_table(spark, d, "fetch_results")
    pages = html.parsed_pages(f.select("fetch_id", "url", F.lower(crawl.header(F.col("headers"), "content-type")).alias("content_type"), "body"))
    topics.folder_sink(topics.parse_outputs(pages)["links"], path)
    back = jobs.run_to_table(topics.folder_source(spark, path, topics.LINKS), "links")
    return back.groupBy("source_url").agg(F.count("*").alias("links"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (stream_hourly_counts, stream_sessions, stream_unique_messages, stream_delivery, stream_aimd, stream_second_sight, segment_round_trip, segment_rules, blob_round_trip, topic_round_trip)
}

SQL: dict[str, str] = {
    "stream_hourly_counts": """select date_trunc('hour', ts) as window_start, event_type, count(*)::bigint as events from events
group by 1, 2 having date_trunc('hour', ts) + interval 1 hour <= (select max(ts) from events) - interval 10 minutes""",
    "stream_sessions": """with m as (select *, case when ts - lag(ts) over w < interval 30 minutes then 0 else 1 end as fresh from events where ts is not null window w as (partition by user_id order by ts)),
n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as s from m),
x as (select user_id, s, min(ts) as started, max(ts) + interval 30 minutes as closes, count(*)::bigint as events from n group by 1, 2)
select user_id, started, closes, events from x where closes <= (select max(ts) from events) - interval 10 minutes""",
    "stream_unique_messages": """select distinct length(url)::varchar || ':' || url || '|' || case when coalesce(blob, '') = '' then 't:' || coalesce(epoch_us(fetched_at)::varchar, '-')
  else 'b:' || coalesce(nullif(regexp_extract(blob, '([0-9]{4}/[0-9]{2}/[0-9]{2}/.*)$', 1), ''), blob) end as msg_key from fetched_messages where url is not null""",
    "stream_delivery": CORE_SQL["p6_found"],
    "stream_aimd": CRAWL_SQL["aimd_fold"].replace("select domain, ord, round(rate, 6) as rate, streak::bigint as streak from s where n > 0", "select domain, round(arg_max(rate, n), 6) as rate, arg_max(streak, n)::bigint as streak from s where n > 0 group by 1"),
    "stream_second_sight": CRAWL_SQL["second_sight_cache"].replace("select event_id, user_id, event_type", "select event_id"),
    "segment_round_trip": SEARCH_SQL["dictionary_stats"],
    "segment_rules": "select * from (values ('dictionary', 0::bigint), ('orphans', 0::bigint), ('bounds', 0::bigint)) t(rule, rows)",
    "blob_round_trip": "select content_hash, min(octet_length(body))::bigint as size_bytes, content_hash as read_hash from fetch_results where body is not null and content_hash is not null group by 1",
}
