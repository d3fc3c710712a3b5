"""Has this key been seen before? Scalable Bloom chains over a stream of keyed records.

Records are cut into shards by key. Within a shard they pass in order of their
id through a chain of Bloom layers: layer i holds growth^i times as many keys
as the first at tightening^i times its error rate, and a new layer is opened
when half of the bits of the last are set. The chance that a new key is called
seen stays under error / (1 - tightening), however long the history grows; the
rate that the bits set so far imply is carried on every row. Only the chain is
held in memory, some 30 bits a key at the default error, never the keys.

The answer is the chain's own. It never misses a key that was there; what it
wrongly calls seen is counted by wrong_answers, and confirmed takes it out where
a caller wants no wrong answer at all.

Keys travel as 128-bit hashes. Copies of a key within an Arrow batch, and of keys
that prove frequent within the task, are answered before the shuffle, so a key
with a third of all rows reaches its shard as some rows per task. The table of
frequent keys ages, so that a key that becomes hot late gets into it.

Defined results
* null id: the record has no place in the order; it is left out.
* null key: never seen, never remembered; the record is left out.
* equal ids under one key (repeated rows): one of them is new, the others count as seen.
* an empty table: no rows.
* further columns: ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

FIRST_CAPACITY = 1 << 14
GROWTH = 4
#: Error of the first layer; the chance of a wrong answer stays under ERROR / (1 - TIGHTENING).
ERROR = 1e-9
TIGHTENING = 0.5
FILL = 0.5
#: Rows that a shard gets at most, about: its chain takes some 90 MB then. Tables of fewer are cut into as many shards as a shuffle has partitions.
SHARD_ROWS = 1 << 24
#: Frequent keys that a task remembers before the shuffle.
FREQUENT = 1 << 13


class BloomLayer:
    def __init__(self, capacity: int, error: float):
        self.k = max(1, math.ceil(-math.log2(error)))
        self.m = np.uint64(max(64, math.ceil(-capacity * math.log(error) / math.log(2) ** 2)))
        self.bits = np.zeros(int(self.m) // 8 + 1, np.uint8)
        self.set_bits = 0

    def places(self, h1: np.ndarray, h2: np.ndarray) -> Iterator[np.ndarray]:
        at = h1.copy()
        for _ in range(self.k):
            yield at % self.m
            at += h2

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place after place, of those whose bits were all set so far: new keys drop out after two places or so."""
        left, at, step = np.arange(len(h1)), h1.copy(), h2
        for _ in range(self.k):
            place = at % self.m
            is_set = (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            left, at, step = left[is_set], at[is_set], step[is_set]
            at = at + step
        found = np.zeros(len(h1), bool)
        found[left] = True
        return found

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        at = np.unique(np.concatenate(list(self.places(h1, h2))))
        where, bit = at >> np.uint64(3), np.left_shift(1, (at & np.uint64(7)).astype(np.uint8)).astype(np.uint8)
        self.set_bits += int(((self.bits[where] & bit) == 0).sum())
        np.bitwise_or.at(self.bits, where, bit)

    @property
    def fill(self) -> float:
        return self.set_bits / int(self.m)


class BloomChain:
    """Layers that grow geometrically while their error rates shrink; the bound on the compounded rate is error / (1 - tightening)."""

    def __init__(self, capacity: int = FIRST_CAPACITY, error: float = ERROR, growth: int = GROWTH, tightening: float = TIGHTENING):
        self.capacity, self.error, self.growth, self.tightening = capacity, error, growth, tightening
        self.layers = [BloomLayer(capacity, error)]

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.zeros(len(h1), bool)
        for layer in self.layers:
            rest = ~found
            found[rest] = layer.contains(h1[rest], h2[rest])
        return found

    def add(self, h1: np.ndarray, h2: np.ndarray) -> None:
        """h1, h2 of keys that the chain does not hold."""
        while len(h1):
            layer = self.layers[-1]
            room = max(1, int((FILL - layer.fill) * int(layer.m) / layer.k))
            layer.add(h1[:room], h2[:room])
            h1, h2 = h1[room:], h2[room:]
            if layer.fill >= FILL - 1e-3:
                i = len(self.layers)
                self.layers.append(BloomLayer(self.capacity * self.growth**i, self.error * self.tightening**i))

    def wrong_rate(self) -> float:
        """Chance that a new key is called seen, from the bits that are set now."""
        right = 1.0
        for layer in self.layers:
            right *= 1 - layer.fill**layer.k
        return 1 - right

    def bound(self) -> float:
        return self.error / (1 - self.tightening)

    def pass_batch(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Seen flags for keys in order; the new ones are remembered."""
        _, first = np.unique(np.rec.fromarrays([h1, h2]), return_index=True)
        seen = np.ones(len(h1), bool)
        seen[first] = self.contains(h1[first], h2[first])
        new = np.flatnonzero(~seen)
        self.add(h1[new], h2[new])
        return seen


class Frequent:
    """Keys of which a task met copies, with the smallest id it passed on; the least frequent give way to new ones."""

    def __init__(self, size: int = FREQUENT):
        self.size = size
        self.h1, self.h2 = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.first, self.count = np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Place of each key in the table, -1 for others."""
        at = np.searchsorted(self.h1, h1)
        at = np.where(at < len(self.h1), at, -1)
        if len(self.h1):
            at[(self.h1[at] != h1) | (self.h2[at] != h2)] = -1
        return at

    def met(self, at: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        np.minimum.at(self.first, at, ids)
        np.add.at(self.count, at, copies)

    def take(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> None:
        """Keys that are not in the table; two that agree in the first hash can't both be in it."""
        h1 = np.concatenate((self.h1, h1))
        h1, where = np.unique(h1, return_index=True)
        self.h1, self.h2 = h1, np.concatenate((self.h2, h2))[where]
        self.first, self.count = np.concatenate((self.first, ids))[where], np.concatenate((self.count, copies))[where]
        if len(self.h1) > self.size:
            keep = np.sort(np.argsort(-self.count, kind="stable")[: self.size // 2])
            self.h1, self.h2, self.first, self.count = self.h1[keep], self.h2[keep], self.first[keep], self.count[keep] // 2


def _local(key_of: Callable[[str], str | None]):
    """Before the shuffle: the hashes of each row's key, and whether this task has passed it on with a smaller id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent = Frequent()
        for pdf in batches:
            keys = [key_of(x) for x in pdf["_raw"]]
            ids = pdf["_id"].to_numpy()[[k is not None for k in keys]]
            digests = b"".join([xxhash.xxh3_128_digest(k) for k in keys if k is not None])
            both = np.frombuffer(digests, "<u8").reshape(-1, 2)
            order = np.lexsort((ids, both[:, 1], both[:, 0]))
            ids, h1, h2 = ids[order], both[order, 0], both[order, 1]
            new = np.ones(len(ids), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            lead = np.flatnonzero(new)
            copies = np.diff(np.append(lead, len(ids)))
            at = frequent.find(h1[lead], h2[lead])
            known = ~new
            hit = at >= 0
            known[lead[hit]] = frequent.first[at[hit]] < ids[lead[hit]]
            frequent.met(at[hit], ids[lead[hit]], copies[hit])
            fresh = ~hit & (copies > 1)
            if fresh.any():
                frequent.take(h1[lead[fresh]], h2[lead[fresh]], ids[lead[fresh]], copies[fresh])
            yield pd.DataFrame({"_id": ids, "_h1": h1.view(np.int64), "_h2": h2.view(np.int64), "_known": known})

    return run


def _chain(capacity: int, error: float, growth: int, tightening: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = BloomChain(capacity, error, growth, tightening)
        for pdf in batches:
            seen = pdf["_known"].to_numpy().copy()
            asked = np.flatnonzero(~seen)
            if len(asked):
                h1 = pdf["_h1"].to_numpy().view(np.uint64)[asked]
                h2 = pdf["_h2"].to_numpy().view(np.uint64)[asked] | np.uint64(1)
                seen[asked] = chain.pass_batch(h1, h2)
            yield pdf.assign(_seen=seen, _layers=len(chain.layers), _rate=chain.wrong_rate(), _bound=chain.bound())

    return run


def seen_before(
    df: DataFrame,
    id_col: str,
    key_col: str,
    key_of: Callable[[str], str | None] = lambda x: x,
    shards: int | None = None,
    capacity: int = FIRST_CAPACITY,
    error: float = ERROR,
    growth: int = GROWTH,
    tightening: float = TIGHTENING,
) -> DataFrame:
    """_id, _seen (the answer), _known (given before the shuffle, for certain), _h1, _h2, _shard, _layers, _rate, _bound."""
    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), F.col(key_col).cast("string").alias("_raw")).where("_id is not null and _raw is not null")
    shards = shards or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SHARD_ROWS))
    keyed = spread(rows).mapInPandas(_local(key_of), "_id bigint, _h1 bigint, _h2 bigint, _known boolean")
    # rows that are answered carry no key: they go anywhere
    spare = [F.when(F.col("_known"), F.col("_id")).otherwise(F.col(c)).alias(c) for c in ("_h1", "_h2")]
    placed = keyed.select("_id", *spare, "_known").repartition(shards, "_h1", "_h2").sortWithinPartitions("_id")
    answers = placed.mapInPandas(_chain(capacity, error, growth, tightening), "_id bigint, _h1 bigint, _h2 bigint, _known boolean, _seen boolean, _layers int, _rate double, _bound double")
    return answers.withColumn("_shard", F.spark_partition_id())


def repeated(df: DataFrame, id_col: str, key_col: str, key_of: Callable[[str], str | None] = lambda x: x, **chain) -> DataFrame:
    """The ids of the records that the chain has seen before."""
    return seen_before(df, id_col, key_col, key_of, **chain).where("_seen").select(F.col("_id").alias(id_col))


def _keys(answers: DataFrame) -> DataFrame:
    """Per key that was asked: shard, smallest id, rows, rows called new. Partial aggregation; no key gathers."""
    asked = answers.where("not _known")
    return asked.groupBy("_shard", "_h1", "_h2").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"), F.count_if(~F.col("_seen")).alias("_new"))


def confirmed(answers: DataFrame) -> DataFrame:
    """The exact check behind the chain: _id of the rows called seen, without first occurrences that were wrongly so called."""
    wrong = _keys(answers).where("_new = 0").select(F.col("_first").alias("_id"))
    return answers.where("_seen").select("_id").join(wrong, "_id", "left_anti")


def wrong_answers(answers: DataFrame) -> DataFrame:
    """Per shard: layers, rows asked and called seen, keys, first occurrences called seen, missed repeats, and the rates: by the bits set, the bound kept, as measured."""
    rows = answers.where("not _known").groupBy("_shard").agg(
        F.max("_layers").alias("layers"), F.count("*").alias("asked"), F.count_if("_seen").alias("called_seen"), F.round(F.max("_rate"), 15).alias("rate_from_fill"), F.max("_bound").alias("bound")
    )
    keys = _keys(answers).groupBy("_shard").agg(F.count("*").alias("distinct_keys"), F.count_if(F.col("_new") == 0).alias("wrongly_seen"), F.sum(F.greatest(F.col("_new") - 1, F.lit(0))).alias("missed"))
    return rows.join(keys, "_shard").select(F.col("_shard").alias("shard"), "layers", "asked", "called_seen", "distinct_keys", "wrongly_seen", "missed", "rate_from_fill", "bound", F.round(F.col("wrongly_seen") / F.col("distinct_keys"), 12).alias("rate_measured"))
