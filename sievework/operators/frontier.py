"""The frontier as one plan: admission of offers, recrawls, pauses, gates and paired politeness buckets.

Defined results: offers without a key or domain are left out; ties go to the
smaller ord; hot domains are numbered in chunks, and pauses are looked up in time
buckets, so neither gathers a domain in a task. The paired buckets are a fold that
is sequential by nature: the requests of an address follow each other in one task,
which holds the state of the address and of its domains, not the requests.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import path_prefixes
from .crawl import PAUSE_CAP, QUEUE_CAP, admit_within_budget, enqueue, filter_new, ordered_fold

BUDGET_DAYS = 7
MIN_RATE = 0.05
#: An address may carry so many times what one of its domains may.
ADDRESS_SHARE = 3.0
RECRAWL_DAYS = 7


def demoted(traps: DataFrame, demote: DataFrame | None = None, undemote: DataFrame | None = None) -> DataFrame:
    """CR-10: prefixes that hold: detected or demoted by hand, but for those that a hand took out."""
    out = traps.select("prefix")
    if demote is not None:
        out = out.union(demote.select("prefix"))
    out = out.distinct()
    return out if undemote is None else out.join(undemote.select("prefix").distinct(), "prefix", "left_anti")


def outside_traps(offers: DataFrame, prefixes: DataFrame, by: str = "ord") -> DataFrame:
    """Offers none of whose path prefixes is demoted."""
    hit = offers.select(by, F.explode(path_prefixes(F.col("url"))).alias("prefix")).join(prefixes.select("prefix"), "prefix").select(by).distinct()
    return offers.join(hit, by, "left_anti")


def add_many(offers: DataFrame, prefixes: DataFrame, budgets: DataFrame, seen: DataFrame, queued: DataFrame | None = None, cap: int = QUEUE_CAP) -> DataFrame:
    """CR-13: domain, key, ord, place of the offers that enter the queue: no trap, within what is left of the budget, not seen, not queued, under the cap.

    offers: key, domain, url, ord; prefixes: prefix; budgets: domain, left; seen and queued: key. The budget is looked at in
    order of arrival before duplicates are known, as each offer is a claim on it.
    """
    free = outside_traps(offers.where("key is not null and domain is not null"), prefixes)
    allowed = admit_within_budget(free.select("domain", "key", "ord"), budgets).select("domain", "key", "ord")
    known = seen.select("key") if queued is None else seen.select("key").union(queued.select("key"))
    first = filter_new(allowed, known).select("key", "ord")
    return enqueue(allowed.join(first, ["key", "ord"]), cap).select("domain", "key", "ord", "place")


def add_one(spark, url: str, key: str, domain: str, prefixes: DataFrame, budgets: DataFrame, seen: DataFrame) -> bool:
    """CR-48: whether a single address would enter the queue."""
    return not add_many(spark.createDataFrame([(key, domain, url, 0)], "key string, domain string, url string, ord bigint"), prefixes, budgets, seen).isEmpty()


def spend(added: DataFrame) -> DataFrame:
    """What the added tasks take from each domain's budget."""
    return added.groupBy("domain").agg(F.count("*").alias("spent"))


def spent_in_window(fetches: DataFrame, days: int = BUDGET_DAYS) -> DataFrame:
    """CR-07: domain, day, spent within the days up to it. fetches: domain, day (a number). One row a domain and day is windowed, not the fetches."""
    daily = fetches.where("domain is not null and day is not null").groupBy("domain", "day").agg(F.count("*").alias("_n"))
    return daily.select("domain", "day", F.sum("_n").over(Window.partitionBy("domain").orderBy("day").rangeBetween(1 - days, 0)).alias("spent"))


def recrawls(pages: DataFrame, prefixes: DataFrame, days: int = RECRAWL_DAYS) -> DataFrame:
    """CR-16: key, due_at of fetched pages, whatever was seen or spent, none from a trap. pages: key, url, at."""
    last = pages.where("key is not null").groupBy("key").agg(F.max_by("url", "at").alias("url"), F.max("at").alias("at"))
    return outside_traps(last, prefixes, "key").select("key", (F.col("at") + F.expr(f"interval {days} days")).alias("due_at"))


def requeued(steps: DataFrame) -> DataFrame:
    """CR-16: key, due_at of tasks that go back into the queue. steps: key, at, action, delay_s; the earliest of several holds."""
    due = F.timestamp_micros(F.unix_micros(F.col("at").cast("timestamp")) + F.round(F.col("delay_s") * 1e6).cast("bigint")).cast("timestamp_ntz")
    return steps.where("action = 'requeue' and key is not null").groupBy("key").agg(F.min(due).alias("due_at"))


def frontier_stats(due: DataFrame, now: Column) -> DataFrame:
    """CR-18: hosts scheduled, hosts due. due: domain, due_at."""
    return due.agg(F.count("*").alias("hosts"), F.count_if(F.col("due_at") <= now).alias("hosts_due"), F.min("due_at").alias("next_due"))


def delay_ceiling(rate: Column, delay_s: Column, least: float = MIN_RATE) -> Column:
    """CR-22: a crawl delay only ever lowers a rate, and not below the least one."""
    return F.when(delay_s.isNull() | (delay_s <= 0), rate).otherwise(F.least(rate, F.greatest(F.lit(1.0) / delay_s, F.lit(least))))


def paused(fetches: DataFrame) -> DataFrame:
    """CR-21: fetches with paused_ms, the rest of the pause that their domain was under. fetches: domain, ord, at_ms, outcome, retry_after_s.

    A pause lasts PAUSE_CAP seconds at most, so it is met in its own time bucket of that length or in the next.
    """
    long = F.greatest(F.lit(1.0), F.least(F.coalesce("retry_after_s", F.lit(60.0)), F.lit(float(PAUSE_CAP))))
    width = PAUSE_CAP * 1000
    stops = fetches.where("outcome = 'throttled' and domain is not null").select("domain", F.col("at_ms").alias("_from"), (F.col("at_ms") + F.ceil(long * 1000)).alias("_to"))
    stops = stops.withColumn("_b", F.explode(F.array(F.floor(F.col("_from") / width), F.floor(F.col("_from") / width) + 1)))
    # of the stops of a domain that begin in one millisecond only the longest tells
    stops = stops.groupBy("domain", "_b", "_from").agg(F.max("_to").alias("_to"))
    met = fetches.where("domain is not null").select("domain", "ord", "at_ms", F.floor(F.col("at_ms") / width).alias("_b")).join(stops, ["domain", "_b"])
    held = met.where("at_ms > _from and at_ms < _to").groupBy("ord").agg(F.max(F.col("_to") - F.col("at_ms")).alias("_p"))
    return fetches.join(held, "ord", "left").withColumn("paused_ms", F.coalesce("_p", F.lit(0)).cast("bigint")).drop("_p")


def gate(dns_ok: Column, robots: Column, paused_ms: Column) -> Column:
    """CR-30: the first thing that stops a fetch: dns, robots_unreachable, robots, pause; go where nothing does."""
    return (
        F.when(~F.coalesce(dns_ok, F.lit(True)), "dns_failed").when(robots == "unreachable", "robots_unreachable").when(robots == "deny", "robots_denied")
        .when(F.coalesce(paused_ms, F.lit(0)) > 0, "rate_limited").otherwise("go")
    )


def paired_buckets(requests: DataFrame, rate: float = 1.0, burst: float = 2.0, cost: float = 1.0, share: float = ADDRESS_SHARE) -> DataFrame:
    """CR-19: address, ord, allowed, wait_ms, reason for requests in order: both the domain's and its address's bucket must hold enough, and no pause hold.

    requests: address, domain, ord, at_ms, paused_ms. A denied request writes nothing.
    """

    def level(held: tuple[float, int] | None, at: int, per_s: float, most: float) -> float:
        return most if held is None else min(most, held[0] + max(0, at - held[1]) / 1000 * per_s)

    def step(state, row):
        if row.paused_ms > 0:
            return state, (row.address, row.ord, False, int(row.paused_ms), "paused")
        own, domains = state
        for name, held, per_s, most in (("domain", domains.get(row.domain), rate, burst), ("ip", own, rate * share, burst * share)):
            tokens = level(held, row.at_ms, per_s, most)
            if tokens < cost:
                return state, (row.address, row.ord, False, math.ceil((cost - tokens) / per_s * 1000), name)
        domains[row.domain] = (level(domains.get(row.domain), row.at_ms, rate, burst) - cost, row.at_ms)
        return ((level(own, row.at_ms, rate * share, burst * share) - cost, row.at_ms), domains), (row.address, row.ord, True, 0, "")

    rows = requests.where("domain is not null").select("address", "domain", "ord", "at_ms", "paused_ms")
    return ordered_fold(rows, "address", ["at_ms", "ord"], lambda row: (None, {}), step, "address string, ord bigint, allowed boolean, wait_ms bigint, reason string")


def valid_agent(agent: str) -> str:
    """CR-47: a crawler's name must tell where it can be reached; ValueError else."""
    if not re.search(r"https?://[^\s;()]+|[\w.+-]+@[\w-]+\.[\w.-]+", agent or ""):
        raise ValueError("a user agent must carry a contact address")
    return agent


def lag_rate(rate: Column, lag_h: Column, most_h: float = 6.0, least: float = MIN_RATE) -> Column:
    """CR-43: a rate lowered by how far consumers are behind beyond most_h hours."""
    return F.when(lag_h > most_h, F.greatest(rate * most_h / lag_h, F.lit(least))).otherwise(rate)


def seeds(urls: DataFrame) -> DataFrame:
    """IO-15: offers of a list of addresses: depth 0, the most urgent band. urls: url, ord; null and repeated ones are left out."""
    return urls.where("url is not null").groupBy("url").agg(F.min("ord").alias("ord")).select("url", "ord", F.lit(0).alias("depth"), F.lit(0).alias("priority"))
