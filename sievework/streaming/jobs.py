"""Structured Streaming jobs: windows with watermarks, exactly-once delivery, politeness state.

Event times are UTC timestamps; rows later than the watermark are dropped by
the windows, as event time must end somewhere, and counted by nobody.

Keyed state sees the rows of a key in a micro-batch in no order. What a step needs
of them (some 16 bytes a row) is put in order as arrays; maxFilesPerTrigger bounds
how many rows one key can have in a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.crawl import AIMD, aimd_step
from ..operators.delivery import DeliveryStore, message_key
from ..session import scratch_path


def table_stream(spark: SparkSession, base: str, name: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stored table as a stream of its files."""
    schema = spark.read.parquet(f"{base}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{base}/{name}.parquet*")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run over all that is there, into a table in the shared folder."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def windowed_counts(events: DataFrame, keys: list[str], size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """MO-03: tumbling windows by event time; a window leaves when the watermark has passed it."""
    timed = events.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", size).alias("_w"), *keys).agg(F.count("*").alias("events")).select(F.col("_w.start").alias("window_start"), *keys, "events")


def session_counts(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Session windows by event time."""
    timed = events.withColumn("_t", F.col("ts").cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.session_window("_t", gap).alias("_w"), key).agg(F.count("*").alias("events")).select(key, F.col("_w.start").alias("started"), F.col("_w.end").alias("closes"), "events")


def unique_messages(messages: DataFrame, late: str = "7 days") -> DataFrame:
    """One row per message key within the watermark. messages: url, blob, fetched_at, delivered_at."""
    keyed = messages.select(message_key(F.col("url"), F.col("blob"), F.col("fetched_at")).alias("msg_key"), F.col("delivered_at").cast("timestamp").alias("_t")).where("msg_key is not null")
    return keyed.withWatermark("_t", late).dropDuplicatesWithinWatermark(["msg_key"]).select("msg_key")


def deliver(messages: DataFrame, store: DeliveryStore):
    """Merge every micro-batch into the delivery store; a batch that runs again changes nothing, as merging is idempotent."""

    def merge(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.merge(batch)

    return messages.writeStream.foreachBatch(merge).option("checkpointLocation", f"{store.path}-checkpoint").trigger(availableNow=True).start()


SIGNALS = ("ok", "slow", "err")


def _in_order(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Two columns of a key's rows, by the first and then the second."""
    first, second = (np.concatenate(x) for x in zip(*pairs))
    order = np.lexsort((second, first))
    return first[order], second[order]


def aimd_rates(signals: DataFrame, **limits) -> DataFrame:
    """CR-20 as keyed state: the rate of a domain after each micro-batch. signals: domain, ord, signal."""
    p = {**AIMD, **limits}
    rest = {k: p[k] for k in ("low", "high", "add", "times", "streak")}

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rate, ok = state.get if state.exists else (p["start"], 0)
        order, signals_ = _in_order((b["ord"].to_numpy(np.int64), pd.Categorical(b["signal"], SIGNALS).codes) for b in batches)
        for code in signals_.tolist():
            rate, ok = aimd_step(rate, ok, SIGNALS[code] if code >= 0 else "", **rest)
        state.update((rate, ok))
        yield pd.DataFrame({"domain": [key[0]], "last_ord": [int(order[-1])], "rate": [rate], "streak": [ok]})

    return signals.where("domain is not null").groupBy("domain").applyInPandasWithState(step, "domain string, last_ord bigint, rate double, streak bigint", "rate double, streak bigint", "append", GroupStateTimeout.NoTimeout)


def second_sight(events: DataFrame, keys: list[str], within_s: int = 600) -> DataFrame:
    """MO-01 as keyed state: events whose key occurred before, within the time."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at, ids = _in_order((b["at"].to_numpy(np.int64), b["event_id"].to_numpy(np.int64)) for b in batches)
        before = np.concatenate(([state.get[0] if state.exists else np.iinfo(np.int64).min // 2], at[:-1]))
        state.update((int(at[-1]),))
        yield pd.DataFrame({"event_id": ids[at - before <= within_s * 1_000_000]})

    timed = events.select(*keys, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.groupBy(*keys).applyInPandasWithState(step, "event_id bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
