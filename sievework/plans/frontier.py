"""Frontier queries: admission in one plan, recrawls, pauses, gates and paired buckets, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import crawl, frontier, monitor
from ..session import read_table
from . import crawling as c

Query = Callable[[SparkSession, str], DataFrame]

ADDRESSES = 7


def _prefix_sets(spark, d):
    """Detected traps; prefixes demoted by hand and taken out by hand."""
    traps = c._traps(spark, d)
    tasks = c._tasks(spark, d).where(urls.crawlable(F.col("url"))).select(F.explode(urls.path_prefixes(F.col("url"))).alias("prefix")).distinct()
    return traps, tasks.where("prefix like '%/login'"), traps.where("prefix like '%*'")


def demoted_prefixes(spark, d):
    """CR-10: traps and prefixes demoted by hand, without those taken back."""
    return frontier.demoted(*_prefix_sets(spark, d))


def _added(spark, d, keyed, seen):
    return frontier.add_many(keyed, frontier.demoted(*_prefix_sets(spark, d)), c._budgets(spark, d, crawl.BUDGET_BASE), seen)


def frontier_add_many(spark, d):
    """CR-13: what of all offers enters the queue, by the native key."""
    return _added(spark, d, c._keyed(spark, d), c._seen(spark, d))


def frontier_add_many_full(spark, d):
    """CR-13 by the canonical address."""
    return _added(spark, d, c._keyed_full(spark, d), c._seen_full(spark, d))


def frontier_spend(spark, d):
    """CR-07: what the added tasks take from the budgets."""
    return frontier.spend(frontier_add_many(spark, d))


def _domains(spark, d):
    return read_table(spark, d, "fetch_results").withColumn("domain", urls.domain_of_host(urls.url_host(F.col("url"))))


def budget_window(spark, d):
    """CR-07: fetches of each domain within seven days."""
    return frontier.spent_in_window(_domains(spark, d).select("domain", F.floor(monitor.micros(F.col("fetched_at")) / 86_400_000_000).cast("bigint").alias("day")))


def recrawl_schedule(spark, d):
    """CR-16: when fetched pages are due again, and when tasks that failed for now are."""
    f = read_table(spark, d, "fetch_results").where(urls.crawlable(F.col("url"))).withColumn("key", urls.native_canonical(F.col("url")))
    again = frontier.recrawls(f.where("outcome in ('fetched', 'not_modified')").select("key", "url", F.col("fetched_at").alias("at")), c._traps(spark, d))
    step = crawl.next_step(F.col("outcome"), F.lit(1), F.col("retry_after_s"), F.lit(False))
    failed = frontier.requeued(f.withColumn("_s", step).select("key", F.col("fetched_at").alias("at"), "_s.action", "_s.delay_s"))
    both = again.withColumn("reason", F.lit("recrawl")).unionByName(failed.withColumn("reason", F.lit("requeue")))
    return both.select("key", "reason", monitor.micros(F.col("due_at")).alias("due_us"))


def frontier_stats(spark, d):
    """CR-18: hosts scheduled, due, and the next to be due, at a moment."""
    last = _domains(spark, d).where("domain is not null and fetched_at is not null").groupBy("domain").agg(F.max("fetched_at").alias("due_at"))
    rows = frontier.frontier_stats(last, F.lit(c.LATE).cast("timestamp_ntz"))
    return rows.select("hosts", "hosts_due", monitor.micros(F.col("next_due")).alias("next_due_us"))


def crawl_delay_ceiling(spark, d):
    """CR-22/43: rates of domains under a crawl delay (here the length of the name in seconds), and lowered by a lag of twelve hours."""
    rows = c._tasks(spark, d).where("domain is not null").groupBy("domain").agg((F.avg("priority") / 250).alias("rate"))
    delay = F.when(F.length("domain") % 3 > 0, F.length("domain").cast("double"))
    return rows.select("domain", F.round("rate", 6).alias("rate"), F.round(frontier.delay_ceiling(F.col("rate"), delay), 6).alias("ceiling"), F.round(frontier.lag_rate(F.col("rate"), F.lit(12.0)), 6).alias("lagging"))


def _requests(spark, d):
    f = _domains(spark, d).select("domain", F.col("fetch_id").alias("ord"), F.floor(monitor.micros(F.col("fetched_at")) / 1000).cast("bigint").alias("at_ms"), "outcome", "retry_after_s")
    return frontier.paused(f.where("domain is not null and at_ms is not null"))


def paused_fetches(spark, d):
    """CR-21: fetches made while their domain was paused, and for how much longer it was."""
    return _requests(spark, d).where("paused_ms > 0").select(F.col("ord").alias("fetch_id"), "domain", "paused_ms")


def gate_decisions(spark, d):
    """CR-30: what would stop a fetch of each domain after its last outcome."""
    last = _domains(spark, d).where("domain is not null").groupBy("domain").agg(F.max_by("outcome", F.struct("fetched_at", "fetch_id")).alias("_o"), F.max_by("retry_after_s", F.struct("fetched_at", "fetch_id")).alias("_r"))
    robots = F.when(F.col("_o") == "robots_unreachable", "unreachable").when(F.col("_o") == "robots_denied", "deny").otherwise("use")
    pause = F.when(F.col("_o") == "throttled", F.coalesce("_r", F.lit(60.0)) * 1000).otherwise(F.lit(0.0))
    return last.select("domain", frontier.gate(F.col("_o") != "dns_failed", robots, pause).alias("decision"))


def paired_bucket_fold(spark, d):
    """CR-19: which fetches a bucket per domain of one request in ten minutes, and one per address of three, would have let pass."""
    address = F.concat(F.lit("ip-"), F.pmod(F.conv(F.substring(F.md5("domain"), 1, 8), 16, 10).cast("bigint"), F.lit(ADDRESSES)).cast("string"))
    return frontier.paired_buckets(_requests(spark, d).withColumn("address", address), rate=1 / 600)


def seed_offers(spark, d):
    """IO-15: the offers of a seed list: here the roots of all domains."""
    roots = c._tasks(spark, d).where("domain is not null").select(F.concat(F.lit("https://"), "domain", F.lit("/")).alias("url"), F.col("task_id").alias("ord"))
    return frontier.seeds(roots)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        demoted_prefixes, frontier_add_many, frontier_add_many_full, frontier_spend, budget_window, recrawl_schedule, frontier_stats, crawl_delay_ceiling, paused_fetches, gate_decisions, paired_bucket_fold, seed_offers,
    )
}

_BUDGETS = c._BUDGETS.replace("floor(2 * ln", f"floor({crawl.BUDGET_BASE} * ln")
_DEMOTED = f"""{c._TRAPS}, offered as (select distinct unnest({c._prefixes("url")}) as prefix from crawl_tasks where {c._CRAWLABLE}),
demoted as ((select prefix from traps union select prefix from offered where prefix like '%/login') except select prefix from traps where prefix like '%*')"""
_ADDED = f"""{c._KEYED}, {_DEMOTED}, {_BUDGETS},
trapped as (select distinct ord from (select ord, unnest({c._prefixes("url")}) as prefix from keyed) join demoted using (prefix)),
placed as (select *, row_number() over (partition by domain order by ord) - 1 as n from keyed where domain is not null and ord not in (select ord from trapped)),
allowed as (select * from placed join budgets using (domain) where n < greatest(room, 0)),
firsts as (select key, min(ord) as ord from allowed group by 1 having key not in (select key from seen)),
added as (select domain, key, ord, row_number() over (partition by domain order by ord) - 1 as place from allowed join firsts using (key, ord) qualify place < {crawl.QUEUE_CAP})"""
_PAUSED = f"""req as (select {c._FETCH_DOMAIN} as domain, fetch_id as ord, floor(epoch_us(fetched_at) / 1000)::bigint as at_ms, outcome, retry_after_s from fetch_results where fetched_at is not null),
stops as (select domain, at_ms as f, at_ms + ceil(greatest(1.0, least(coalesce(retry_after_s, 60.0), 300.0)) * 1000) as t from req where outcome = 'throttled'),
paused as (select r.*, coalesce((select max(t - r.at_ms) from stops s where s.domain = r.domain and r.at_ms > f and r.at_ms < t), 0)::bigint as paused_ms from req r where domain is not null)"""

SQL: dict[str, str] = {
    "demoted_prefixes": f"with {_DEMOTED} select prefix from demoted",
    "frontier_add_many": f"with {_ADDED} select domain, key, ord, place::bigint as place from added",
    "frontier_spend": f"with {_ADDED} select domain, count(*)::bigint as spent from added group by 1",
    "budget_window": f"""with daily as (select {c._FETCH_DOMAIN} as domain, (epoch_us(fetched_at) // 86400000000)::bigint as day, count(*) as n from fetch_results where fetched_at is not null group by 1, 2)
select domain, day, (sum(n) over (partition by domain order by day range between 6 preceding and current row))::bigint as spent from daily where domain is not null""",
    "recrawl_schedule": f"""with {c._TRAPS}, f as (select {c._canon("url")} as key, url, fetched_at, outcome, retry_after_s from fetch_results where {c._CRAWLABLE}),
last as (select key, arg_max(url, fetched_at) as url, max(fetched_at) as seen_at from f where outcome in ('fetched', 'not_modified') group by 1),
bad as (select distinct key from (select key, unnest({c._prefixes("url")}) as prefix from last) join traps using (prefix)),
steps as (select key, fetched_at, case when outcome = 'throttled' then greatest(1.0, least(coalesce(retry_after_s, 60.0), 300.0)) when outcome = 'server_error' then 60.0
  when outcome in ('network_error', 'timeout', 'dns_failed') then 60.0 when outcome = 'robots_unreachable' then 600.0 when outcome = 'rate_limited' then greatest(coalesce(retry_after_s, 0.0), 1.0) end as delay_s from f)
select key, 'recrawl' as reason, epoch_us(seen_at) + 7 * 86400000000 as due_us from last where key not in (select key from bad)
union all select key, 'requeue', min(epoch_us(fetched_at) + round(delay_s * 1e6)::bigint) from steps where delay_s is not null group by 1""",
    "frontier_stats": f"""with last as (select {c._FETCH_DOMAIN} as domain, max(fetched_at) as due_at from fetch_results where fetched_at is not null group by 1)
select count(*)::bigint as hosts, count_if(due_at <= timestamp '{c.LATE}')::bigint as hosts_due, epoch_us(min(due_at)) as next_due_us from last where domain is not null""",
    "crawl_delay_ceiling": """with r as (select domain, avg(priority) / 250 as rate from crawl_tasks where domain is not null group by 1)
select domain, round(rate, 6) as rate, round(case when length(domain) % 3 > 0 then least(rate, greatest(1.0 / length(domain), 0.05)) else rate end, 6) as ceiling, round(greatest(rate * 6.0 / 12.0, 0.05), 6) as lagging from r""",
    "paused_fetches": f"with {_PAUSED} select ord as fetch_id, domain, paused_ms from paused where paused_ms > 0",
    "gate_decisions": f"""with f as (select {c._FETCH_DOMAIN} as domain, outcome, row_number() over (partition by {c._FETCH_DOMAIN} order by fetched_at desc nulls last, fetch_id desc) as n from fetch_results)
select domain, case outcome when 'dns_failed' then 'dns_failed' when 'robots_unreachable' then 'robots_unreachable' when 'robots_denied' then 'robots_denied' when 'throttled' then 'rate_limited' else 'go' end as decision
from f where n = 1 and domain is not null""",
    "paired_bucket_fold": f"""with recursive {_PAUSED},
r as (select *, 'ip-' || (('0x' || substr(md5(domain), 1, 8))::ubigint % {ADDRESSES})::varchar as address from paused),
q as (select *, row_number() over (partition by address order by at_ms, ord) as n from r),
f as (
  select distinct address, 0::bigint as ord, false as allowed, 0::bigint as wait_ms, '' as reason, null::struct(t double, l bigint) as own, map([]::varchar[], []::struct(t double, l bigint)[]) as doms, 0::bigint as n from q
  union all
  select address, ord, why = '', case why when '' then 0 when 'paused' then paused_ms when 'domain' then ceil((1 - dt) / (1.0 / 600) * 1000) else ceil((1 - it) / (3.0 / 600) * 1000) end::bigint, why,
    case when why = '' then {{'t': it - 1, 'l': at_ms}} else own end, case when why = '' then map_concat(doms, map([domain], [{{'t': dt - 1, 'l': at_ms}}])) else doms end, n
  from (
    select *, case when paused_ms > 0 then 'paused' when dt < 1 then 'domain' when it < 1 then 'ip' else '' end as why from (
      select q.address, q.ord, q.domain, q.at_ms, q.paused_ms, q.n, f.own, f.doms,
        coalesce(least(2.0::double, doms[q.domain].t + greatest(0, q.at_ms - doms[q.domain].l) / 1000.0::double * (1.0::double / 600)), 2.0::double) as dt,
        coalesce(least(6.0::double, own.t + greatest(0, q.at_ms - own.l) / 1000.0::double * (3.0::double / 600)), 6.0::double) as it
      from f join q on q.address = f.address and q.n = f.n + 1)))
select address, ord, allowed, wait_ms, reason from f where n > 0""",
    "seed_offers": "select 'https://' || domain || '/' as url, min(task_id) as ord, 0 as depth, 0 as priority from crawl_tasks where domain is not null group by 1",
}
SQL["frontier_add_many_full"] = SQL["frontier_add_many"].replace(c._KEYED, c._KEYED_FULL)
