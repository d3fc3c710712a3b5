"""Crawl bookkeeping as set operations: seen filter, budgets, traps, frontier, outcomes, politeness."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import path_prefixes, url_host
from ..session import attach
from .ranks import CHUNK, chunked_row_number

# Fixed values of the crawl.
BUDGET_BASE = 500
TRAP_MIN_URLS, TRAP_RATIO = 1000, 0.05
BANDS = 8
QUEUE_CAP = 10_000
RETRIES = 3
PAUSE_CAP = 300
REDIRECTS = (301, 302, 303, 307, 308)
MAX_REDIRECTS = 5
HEALTHY = ("fetched", "not_modified", "redirected", "gone", "client_error", "too_large")
SUCCESS = ("fetched", "not_modified")


def bloom_params(capacity: int, error: float) -> tuple[int, int]:
    """CR-01: bits and hash functions."""
    bits = math.ceil(-capacity * math.log(error) / math.log(2) ** 2)
    return bits, max(1, round(bits / capacity * math.log(2)))


# --- seen addresses ----------------------------------------------------------------------------------


def filter_new(offers: DataFrame, seen: DataFrame, key: str = "key", order: str = "ord") -> DataFrame:
    """CR-04: the first offer of every key that was not seen. offers: key, order, ...; seen: key. Null keys are left out.

    Partial aggregation leaves one row a key and task, so a hot key does not gather.
    """
    first = offers.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order), F.count("*").alias("offers"))
    return first.join(seen.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def seen_stats(offers: DataFrame, seen: DataFrame, key: str = "key") -> DataFrame:
    """CR-05: checked, unique, already_seen, absorption."""
    per = offers.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    known = per.join(seen.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True)), key, "left")
    return known.agg(
        F.sum("_n").alias("checked"), F.count("*").alias("unique_keys"), F.count_if(F.col("_known")).alias("already_seen"),
        (F.lit(1.0) - F.count_if(F.col("_known").isNull()) / F.sum("_n")).alias("absorption"),
    )


# --- budgets and traps -------------------------------------------------------------------------------


def budget_limit(authority: Column, base: int = BUDGET_BASE) -> Column:
    """CR-06."""
    return F.floor(F.lit(base) * F.log(F.lit(2.0) + F.lit(1000.0) * F.coalesce(authority, F.lit(0.0)))).cast("bigint")


def admit_within_budget(offers: DataFrame, budgets: DataFrame) -> DataFrame:
    """CR-08: offers (domain, ord) in order up to what is left of the domain's budget (domain, left); hot domains are numbered in chunks."""
    numbered = chunked_row_number(offers.where("domain is not null"), ["domain"], ["ord"], F.floor(F.col("ord") / CHUNK), "place")
    return numbered.join(budgets, "domain").where(F.col("place") < F.greatest(F.col("left"), F.lit(0)))


def trap_prefixes(fetches: DataFrame, min_urls: int = TRAP_MIN_URLS, ratio: float = TRAP_RATIO, approximate: bool = False) -> DataFrame:
    """CR-09: prefix, depth, urls, distinct_bodies of address prefixes that show few bodies under many addresses. fetches: url, content_hash."""
    rows = fetches.where("content_hash is not null").select("content_hash", F.posexplode(path_prefixes(F.col("url"))).alias("_p", "prefix"))
    per = rows.groupBy("prefix", (F.col("_p") + 1).alias("depth"), "content_hash").agg(F.count("*").alias("_n"))
    if approximate:
        grouped = per.groupBy("prefix", "depth").agg(F.sum("_n").alias("urls"), F.approx_count_distinct("content_hash").alias("distinct_bodies"))
    else:
        grouped = per.groupBy("prefix", "depth").agg(F.sum("_n").alias("urls"), F.count("*").alias("distinct_bodies"))
    return grouped.where((F.col("urls") >= min_urls) & (F.col("distinct_bodies") / F.col("urls") < ratio))


def shallowest_trap(urls: DataFrame, traps: DataFrame) -> DataFrame:
    """CR-10: url and the shallowest trap prefix that it lies under."""
    rows = urls.select("url", F.posexplode(path_prefixes(F.col("url"))).alias("_p", "prefix")).join(traps.select("prefix"), "prefix")
    return rows.groupBy("url").agg(F.min_by("prefix", "_p").alias("prefix"))


# --- frontier ----------------------------------------------------------------------------------------


def priority_band(priority: Column) -> Column:
    """CR-11."""
    return F.least(F.lit(BANDS - 1), F.greatest(F.lit(0), F.floor(priority * BANDS / 1000))).cast("int")


def enqueue(tasks: DataFrame, cap: int = QUEUE_CAP) -> DataFrame:
    """CR-12: one task per key, at most cap per domain in order of ord."""
    once = tasks.where("key is not null and domain is not null").groupBy("domain", "key").agg(F.min("ord").alias("ord"))
    return chunked_row_number(once, ["domain"], ["ord"], F.floor(F.col("ord") / CHUNK), "place").where(F.col("place") < cap)


def lease(queue: DataFrame, due: DataFrame, now, limit: int | None = None) -> DataFrame:
    """CR-14: of every due host the oldest task; the ripest hosts first where a limit is set. queue: domain, ord, ...; due: domain, due_at."""
    ready = due.where(F.col("due_at") <= F.lit(now))
    head = queue.groupBy("domain").agg(F.min_by(F.struct(*queue.columns), "ord").alias("_t"))
    out = head.join(ready, "domain").select("domain", "due_at", *[F.col("_t")[c].alias(c) for c in queue.columns if c != "domain"])
    return out if limit is None else out.orderBy("due_at", "domain").limit(limit)


def latest_validators(fetches: DataFrame) -> DataFrame:
    """CR-17: the newest non-null etag and last-modified of each url. fetches: url, etag, last_modified, at."""
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    return fetches.where("url is not null").groupBy("url").agg(newest("etag"), newest("last_modified"))


def consistent_owner(keys: DataFrame, key: str, nodes: list[str], virtual: int = 150) -> DataFrame:
    """CR-41: the node of each key on a ring of virtual places; the ring is of fixed size."""
    spark = keys.sparkSession
    ring = spark.createDataFrame([(n, v) for n in nodes for v in range(virtual)], "node string, v int")
    place = lambda c: F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")
    points = ring.select("node", place(F.concat("node", F.lit("#"), F.col("v").cast("string"))).alias("at")).groupBy().agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("_ring"))
    hashed = attach(keys.withColumn("_h", place(F.col(key))), points)
    after = F.filter("_ring", lambda p: p["at"] >= F.col("_h"))
    return hashed.withColumn("node", F.when(F.size(after) > 0, F.element_at(after, 1)["node"]).otherwise(F.element_at("_ring", 1)["node"])).drop("_h", "_ring")


def salted_key(domain: Column, url: Column, salts: int) -> Column:
    """CR-42."""
    return F.concat(domain, F.lit("#"), F.pmod(F.xxhash64(url), F.lit(salts)).cast("string"))


# --- outcomes ----------------------------------------------------------------------------------------


def classify_status(status: Column, size: Column, max_bytes: int = 10 * 1024 * 1024) -> Column:
    """CR-28."""
    return (
        F.when(status.isin(*REDIRECTS), "redirected").when(status == 304, "not_modified").when(status.isin(429, 503), "throttled").when(status.isin(404, 410), "gone")
        .when((status >= 400) & (status < 500), "client_error").when(status >= 500, "server_error").when((status >= 200) & (status < 300) & (size > max_bytes), "too_large")
        .when((status >= 200) & (status < 300), "fetched")
    )


def limiter_signal(outcome: Column, elapsed_s: Column, slow_s: float = 5.0) -> Column:
    """The signal that an outcome sends to the politeness controller."""
    return (
        F.when(outcome == "throttled", "err").when(outcome.isin("server_error", "network_error", "timeout", "dns_failed"), "err")
        .when(outcome.isin("robots_denied", "robots_unreachable", "rate_limited"), "none").when((outcome == "fetched") & (elapsed_s > slow_s), "slow").otherwise("ok")
    )


def next_step(outcome: Column, attempt: Column, retry_after_s: Column, noindex: Column) -> Column:
    """CR-33: struct<action, delay_s>."""
    pause = F.greatest(F.lit(1.0), F.least(F.coalesce(retry_after_s, F.lit(60.0)), F.lit(float(PAUSE_CAP))))
    tries = F.coalesce(attempt, F.lit(0))
    spent = tries >= RETRIES
    step = lambda action, delay=None: F.struct(F.lit(action).alias("action"), (F.lit(None) if delay is None else delay).cast("double").alias("delay_s"))
    return (
        F.when(outcome == "fetched", F.when(noindex, step("store")).otherwise(step("emit"))).when(outcome == "not_modified", step("emit")).when(outcome == "gone", step("tombstone"))
        .when(outcome == "throttled", step("requeue", pause))
        .when((outcome == "server_error") & ~spent, step("requeue", 30 * F.pow(F.lit(2.0), tries)))
        .when(outcome.isin("network_error", "timeout", "dns_failed") & ~spent, step("requeue", F.lit(60.0) * tries))
        .when(outcome == "robots_unreachable", step("requeue", F.lit(600.0))).when(outcome == "rate_limited", step("requeue", F.greatest(F.coalesce(retry_after_s, F.lit(0.0)), F.lit(1.0))))
        .when(outcome.isin("server_error", "network_error", "timeout", "dns_failed"), step("give_up")).otherwise(step("release"))
    )


def header(headers: Column, name: str) -> Column:
    """The value of a header, its name in any case; null when it is missing."""
    found = F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name))
    return F.when(F.size(found) > 0, found[0])


def retry_after_seconds(value: Column, now: Column) -> Column:
    """CR-32: seconds, or an HTTP date as seconds from now; null for anything else."""
    date = F.try_to_timestamp(F.regexp_replace(value, "^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    ahead = date.cast("timestamp").cast("double") - now.cast("timestamp").cast("double")
    return F.when(value.rlike(r"^\s*[0-9]+\s*$"), F.trim(value).cast("double")).when(ahead.isNotNull(), F.greatest(F.lit(0.0), ahead))


def robots_tag_noindex(value: Column, agent: str = "sieveworkbot") -> Column:
    """CR-26: noindex or none for all agents, or for ours."""
    parts = F.split(F.lower(F.coalesce(value, F.lit(""))), ",")
    return F.exists(parts, lambda p: F.trim(F.regexp_replace(p, f"^\\s*{agent}\\s*:", "")).isin("noindex", "none"))


def follow_redirects(hops: DataFrame, max_hops: int = MAX_REDIRECTS) -> DataFrame:
    """CR-29: url, final_url, hops, outcome (resolved, loop, too_many). hops: url, target, one per url."""
    edges = hops.where("url is not null and target is not null").groupBy("url").agg(F.min("target").alias("target"))
    at = edges.select("url", F.col("target").alias("final_url"), F.array("url").alias("_seen"), F.lit(1).alias("hops"))
    step = edges.select(F.col("url").alias("final_url"), F.col("target").alias("_next"))
    for _ in range(max_hops):
        looped = F.array_contains("_seen", F.col("final_url"))
        at = at.join(step, "final_url", "left").select(
            "url", F.when(F.col("_next").isNotNull() & ~looped & (F.col("hops") <= max_hops), F.col("_next")).otherwise(F.col("final_url")).alias("final_url"),
            F.when(F.col("_next").isNotNull() & ~looped, F.array_append("_seen", F.col("final_url"))).otherwise(F.col("_seen")).alias("_seen"),
            F.when(F.col("_next").isNotNull() & ~looped, F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"),
        )
    loop = F.array_contains("_seen", F.col("final_url"))
    return at.select("url", "final_url", "hops", F.when(loop, "loop").when(F.col("hops") > max_hops, "too_many").otherwise("resolved").alias("outcome"))


def change_rates(fetches: DataFrame) -> DataFrame:
    """CR-37: url, visits, changes, days, changes a day. fetches: url, content_hash, at. The window is per url, whose visits are few."""
    w = Window.partitionBy("url").orderBy("at", "content_hash")
    rows = fetches.where("url is not null and content_hash is not null").withColumn("_last", F.lag("content_hash").over(w)).withColumn("_at", F.lag("at").over(w))
    per = rows.groupBy("url").agg(
        F.count("*").alias("visits"), F.count_if(F.col("_last") != F.col("content_hash")).alias("changes"), F.coalesce(F.sum((F.unix_micros("at") - F.unix_micros("_at")) / 86_400e6), F.lit(0.0)).alias("days")
    )
    return per.where("visits > 1").withColumn("rate", F.when(F.col("days") > 0, F.col("changes") / F.col("days")))


def outcome_runs(fetches: DataFrame) -> DataFrame:
    """CR-39: url, outcome, run, first_at, last_at, length of maximal runs of one outcome. fetches: url, outcome, at, ord."""
    w, v = Window.partitionBy("url").orderBy("at", "ord"), Window.partitionBy("url", "outcome").orderBy("at", "ord")
    rows = fetches.where("url is not null and outcome is not null").withColumn("run", F.row_number().over(w) - F.row_number().over(v))
    return rows.groupBy("url", "outcome", "run").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("length"))


def timeout_halvings(runs: DataFrame, every: int = 3) -> DataFrame:
    """CR-39: url, halvings: a rate is halved once for every so many timeouts in a row. runs: of outcome_runs."""
    return runs.where("outcome = 'timeout'").groupBy("url").agg(F.sum(F.floor(F.col("length") / every)).cast("bigint").alias("halvings")).where("halvings > 0")


def recrawl_shares(rates: DataFrame) -> DataFrame:
    """CR-37: each page's share of the recrawls, by the root of its change rate: what changes all the time is not chased in proportion. rates: url, rate."""
    rows = rates.where("rate > 0").withColumn("_w", F.sqrt("rate"))
    return attach(rows, rows.agg(F.sum("_w").alias("_all"))).select("url", "rate", (F.col("_w") / F.col("_all")).alias("share"))


# --- politeness --------------------------------------------------------------------------------------

AIMD = {"start": 1.0, "low": 0.05, "high": 5.0, "add": 0.25, "times": 0.5, "streak": 10}


def aimd_step(rate: float, ok: int, signal: str, low: float, high: float, add: float, times: float, streak: int) -> tuple[float, int]:
    """CR-20."""
    if signal == "err":
        return max(low, rate * times), 0
    if signal == "slow":
        return max(low, rate * (1 - (1 - times) / 2)), 0
    if signal != "ok":
        return rate, ok
    ok += 1
    return (min(high, rate + add), 0) if ok >= streak else (rate, ok)


def bucket_step(tokens: float, since_ms: float, rate: float, burst: float, cost: float = 1.0) -> tuple[bool, float, int]:
    """CR-19 for one key: allowed, tokens left, milliseconds to wait. A denied request writes nothing."""
    now = min(burst, tokens + max(0.0, since_ms) / 1000 * rate)
    return (True, now - cost, 0) if now >= cost else (False, tokens, math.ceil((cost - now) / rate * 1000))


def ordered_fold(df: DataFrame, key: str, order: list[str], start, step, schema: str) -> DataFrame:
    """A fold over the rows of each key in order, as a stream: rows of a key follow each other in one partition and only its state is held.

    start(row) -> state of a key whose first row that is; step(state, row) -> (state, output tuple).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        names = [c.strip().split()[0] for c in schema.split(",")]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if row[0] != at:
                    at, state = row[0], start(row)
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=names)

    columns = [key, *[c for c in df.columns if c != key]]
    return df.select(*columns).where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


#: Numbers of the order that one task folds at a time.
FOLD_CHUNK = 1 << 16


class RateMaps:
    """What a run of signals does to a rate, for every streak it may begin with: r -> min(high, max(low, a * r + b)), and the streak it ends with.

    Every step of the controller is such a map, and two of them make one again; so runs can be folded apart and composed.
    """

    def __init__(self, p: dict):
        n = p["streak"]
        self.p, self.ok = p, np.arange(n)
        self.a, self.b, self.low, self.high = np.ones(n), np.zeros(n), np.full(n, -np.inf), np.full(n, np.inf)

    def then(self, mask: np.ndarray, a: float, b: float, low: float, high: float) -> None:
        """Where mask holds, another map after this one."""
        self.a[mask], self.b[mask] = a * self.a[mask], a * self.b[mask] + b
        self.low[mask] = np.minimum(high, np.maximum(low, a * self.low[mask] + b))
        self.high[mask] = np.minimum(high, np.maximum(low, a * self.high[mask] + b))

    def signal(self, signal: str) -> None:
        p, every = self.p, np.ones(len(self.ok), bool)
        if signal in ("err", "slow"):
            self.then(every, p["times"] if signal == "err" else 1 - (1 - p["times"]) / 2, 0.0, p["low"], np.inf)
            self.ok[:] = 0
        elif signal == "ok":
            self.ok += 1
            full = self.ok >= p["streak"]
            if full.any():
                self.then(full, 1.0, p["add"], -np.inf, p["high"])
                self.ok[full] = 0

    def rows(self) -> list[tuple]:
        return list(zip(self.a.tolist(), self.b.tolist(), self.low.tolist(), self.high.tolist(), self.ok.tolist()))


def _chunk_starts(signals: DataFrame, p: dict) -> DataFrame:
    """domain, chunk, rate, ok: the state at the beginning of every chunk of a domain that has several. signals: domain, ord, signal, chunk."""
    hot = signals.groupBy("domain", "chunk").agg(F.count("*").alias("_n")).groupBy("domain").agg(F.count("*").alias("_c")).where("_c > 1").select("domain")

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, now = None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if (row.domain, row.chunk) != at:
                    if at is not None:
                        out.append((*at, now.rows()))
                    at, now = (row.domain, row.chunk), RateMaps(p)
                now.signal(row.signal)
            yield pd.DataFrame(out, columns=["domain", "chunk", "maps"])
        if at is not None:
            yield pd.DataFrame([(*at, now.rows())], columns=["domain", "chunk", "maps"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rate, ok, out = p["start"], 0, []
        for row in pdf.sort_values("chunk").itertuples(index=False):
            out.append((row.domain, row.chunk, rate, ok))
            m = row.maps[ok]
            rate, ok = min(m["high"], max(m["low"], m["a"] * rate + m["b"])), m["ok"]
        return pd.DataFrame(out, columns=["domain", "chunk", "rate", "ok"])

    per = signals.join(hot, "domain").repartition("domain", "chunk").sortWithinPartitions("domain", "chunk", "ord")
    summaries = per.select("domain", "chunk", "signal").mapInPandas(maps, "domain string, chunk bigint, maps array<struct<a:double,b:double,low:double,high:double,ok:int>>")
    # a row a chunk: as many as the order has chunks
    return summaries.groupBy("domain").applyInPandas(fold, "domain string, chunk bigint, rate double, ok int")


def aimd_fold(signals: DataFrame, chunk: int = FOLD_CHUNK, **limits) -> DataFrame:
    """Rate of every domain after each of its signals. signals: domain, ord, signal.

    The signals of a domain are cut by ord. What a cut does to a rate is found for every cut apart, these maps are composed
    to the state at the beginning of each, and from there the cuts are folded side by side: a hot domain is many tasks.
    """
    p = {**AIMD, **limits}
    rest = {k: p[k] for k in ("low", "high", "add", "times", "streak")}
    cut = signals.where("domain is not null").select("domain", "ord", "signal", F.floor(F.col("ord") / chunk).cast("bigint").alias("chunk"))
    started = cut.join(_chunk_starts(cut, p), ["domain", "chunk"], "left").withColumn("_key", F.concat("domain", F.lit("\u0000"), F.col("chunk").cast("string")))

    def start(row):
        return (p["start"], 0) if math.isnan(row.rate) else (row.rate, int(row.ok))

    def step(state, row):
        state = aimd_step(*state, row.signal, **rest)
        return state, (row.domain, row.ord, state[0], state[1])

    rows = started.select("_key", "domain", "ord", "signal", F.coalesce("rate", F.lit(float("nan"))).alias("rate"), F.coalesce("ok", F.lit(0)).alias("ok"))
    return ordered_fold(rows, "_key", ["ord"], start, step, "domain string, ord bigint, rate double, streak bigint")


def token_bucket_fold(requests: DataFrame, rate: float = 1.0, burst: float = 2.0) -> DataFrame:
    """Which requests of a domain pass its bucket. requests: domain, ord, at_ms."""

    def step(state, row):
        tokens, last = state
        since = 0.0 if last is None else row.at_ms - last
        allowed, left, wait = bucket_step(tokens, since, rate, burst)
        return ((left, row.at_ms) if allowed else state), (row.domain, row.ord, allowed, wait)

    return ordered_fold(requests.select("domain", "ord", "at_ms"), "domain", ["at_ms", "ord"], lambda row: (burst, None), step, "domain string, ord bigint, allowed boolean, wait_ms bigint")


def host_of_url(url: Column) -> Column:
    return url_host(url)
