"""Serving-log and corpus-health aggregates over (user_id, ts, event_type, ...) and the crawl tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import chunked_neighbour, chunked_sum

#: Rows of a key are ordered day by day.
CELL_US = 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds of a timestamp with or without zone (UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def _cell() -> Column:
    return F.floor(micros(F.col("ts")) / CELL_US)


def _beside(events: DataFrame, key: list[str], values: list[str], ahead: bool = False) -> DataFrame:
    """events with _near: the values of the event before (or ahead) of its key; a hot key is ordered day by day."""
    return chunked_neighbour(events, key, ["ts", "event_id"], _cell(), values, "_near", ahead)


def second_sight(events: DataFrame, key: list[str], within_s: int = 600) -> DataFrame:
    """MO-01: occurrences of a key that follow an earlier one within the time: those are admitted to the cache."""
    return _beside(events, key, ["ts"]).where((micros(F.col("ts")) - micros(F.col("_near.ts"))) <= within_s * 1_000_000).drop("_near")


def cache_hits(events: DataFrame, key: list[str], ttl_s: int | Column) -> DataFrame:
    """MO-02: per key the requests, and the hits of a cache whose entries live ttl_s (which may depend on the event's intent) from their last fill.

    A generation of the index among the key's columns empties the cache.

    A request is a hit when the one before it (which filled or hit) is within the time: a sliding lifetime.
    """
    hit = (micros(F.col("ts")) - micros(F.col("_near.ts"))) <= (F.lit(ttl_s) if isinstance(ttl_s, int) else ttl_s).cast("bigint") * 1_000_000
    return _beside(events, key, ["ts"]).withColumn("_hit", F.coalesce(hit, F.lit(False))).groupBy(*key).agg(F.count("*").alias("requests"), F.count_if("_hit").alias("hits"))


def over_quota(events: DataFrame, key: list[str], window: str = "1 minute", limit: int = 2) -> DataFrame:
    """MO-03: tumbling windows in which a key exceeds its limit."""
    return events.groupBy(*key, F.window(F.col("ts").cast("timestamp"), window).alias("_w")).agg(F.count("*").alias("requests")).where(F.col("requests") > limit).select(*key, F.col("_w.start").alias("window_start"), "requests")


def burn_rate(events: DataFrame, bad: Column, short_h: int, long_h: int, budget: float) -> DataFrame:
    """MO-04: per hour the error shares of the last short_h and long_h hours over the budget."""
    hourly = events.groupBy(F.floor(micros(F.col("ts")) / 3_600_000_000).cast("bigint").alias("hour")).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    back = lambda h: Window.orderBy("hour").rangeBetween(-(h - 1), 0)  # noqa: E731  one row an hour
    share = lambda h: F.sum("bad").over(back(h)) / F.sum("n").over(back(h)) / budget
    return hourly.select("hour", "n", "bad", share(short_h).alias("short_burn"), share(long_h).alias("long_burn"))


def sessions(events: DataFrame, gap_s: int = 1800) -> DataFrame:
    """Sessions of a user: user_id, session, start, events, last event."""
    new = (micros(F.col("ts")) - micros(F.col("_near.ts"))) > gap_s * 1_000_000
    flagged = _beside(events, ["user_id"], ["ts"]).withColumn("_new", F.coalesce(new, F.lit(True)).cast("int"))
    marked = chunked_sum(flagged, ["user_id"], ["ts", "event_id"], _cell(), F.col("_new"), "session")
    return marked.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))


def abandonment(events: DataFrame, query: str = "view", click: str = "click", within_s: int = 30) -> DataFrame:
    """MO-05: per user the queries, and those that no click follows in time and before the next query, and the queries that follow another in time (reformulations)."""
    rows = _beside(events.where(F.col("event_type").isin(query, click)), ["user_id"], ["ts", "event_type"], ahead=True)
    asked = rows.where(F.col("event_type") == query)
    soon = F.coalesce((micros(F.col("_near.ts")) - micros(F.col("ts"))) / 1e6 <= within_s, F.lit(False))
    return asked.groupBy("user_id").agg(
        F.count("*").alias("queries"), F.count_if(~(soon & (F.col("_near.event_type") == click))).alias("abandoned"), F.count_if(soon & (F.col("_near.event_type") == query)).alias("reformulated")
    )


def zero_results(results: DataFrame, by: str) -> DataFrame:
    """MO-05, RK-39: by group the queries, those without a result, and their ratio: a guardrail beside a ranking's gain. results: query_id, hits and the group."""
    return results.groupBy(by).agg(F.count("*").alias("queries"), F.count_if(F.coalesce("hits", F.lit(0)) == 0).alias("empty")).withColumn("zero_ratio", F.col("empty") / F.col("queries"))


def day_over_day(counts: DataFrame, drop: float = -0.3, rise: float = 0.15) -> DataFrame:
    """MO-07: day, n, change on the day before and the week before, alert. counts: day (int), n."""
    w = Window.orderBy("day")  # one row a day
    change = lambda k: F.col("n") / F.lag("n", k).over(w) - 1
    rows = counts.withColumn("day_change", change(1)).withColumn("week_change", change(7))
    return rows.withColumn("alert", F.coalesce(F.col("day_change") <= drop, F.lit(False)) | F.coalesce(F.col("week_change") >= rise, F.lit(False)))


def freshness(rows: DataFrame, age_s: Column, within_h: int = 24) -> DataFrame:
    """MO-08: share of rows younger than the limit."""
    return rows.agg(F.count("*").alias("n"), (F.count_if(age_s <= within_h * 3600) / F.count("*")).alias("fresh_share"))


def ladder_rung(utilisation: Column) -> Column:
    """MO-09."""
    return F.when(utilisation < 0.7, 0).when(utilisation < 0.8, 1).when(utilisation < 0.9, 2).when(utilisation < 0.95, 3).otherwise(4)


def in_flight_at(log: DataFrame, at) -> DataFrame:
    """MO-10: requests started and not finished at a crash. log: request_id, kind (start/finish), ts."""
    before = log.where(F.col("ts") <= F.lit(at))
    return before.where("kind = 'start'").join(before.where("kind = 'finish'").select("request_id"), "request_id", "left_anti")


def histogram(df: DataFrame, value: str, edges: list[float], by: list[str] | None = None) -> DataFrame:
    """HT-34: counts by bucket; bucket i holds values from edges[i-1] up to edges[i]."""
    bucket = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        bucket = F.when(F.col(value) < edges[i], F.lit(i)).otherwise(bucket)
    return df.where(F.col(value).isNotNull()).groupBy(*(by or []), bucket.alias("bucket")).agg(F.count("*").alias("n"))
