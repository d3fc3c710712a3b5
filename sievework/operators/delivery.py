"""Exactly-once delivery: keep one copy of each message that was delivered at least once.

History lies in partitions (by day), each in a versioned folder. An identifier
index maps every message to its home partition; it is cut into buckets by the
message's hash. A merge reads the buckets that the incoming messages fall into
and the partitions that they turn out to touch, recomputes the single winners
(smallest delivery id) from history plus incoming, writes those partitions anew
under a new version and publishes the next manifest, so that a reader sees either
the old or the new state of all of them.

Manifests are numbered and never overwritten. Of two writers that started from
the same one the second finds the next number taken, and merges anew from there.
What a manifest no longer names is deleted one manifest later, so a reader that
has planned on the one before still finds its files.

Messages are known by 128 bits of the SHA-256 of their key.

Defined results
* a null url: the row names no message; it is neither kept nor dropped.
* a null or empty blob: the message is named by url and fetched_at, a null fetched_at being a value of its own.
* a null delivery id: ordered after all others; it wins only where nothing else has the key.
* equal delivery ids of one message (repeated rows): one of them stays, the others are repeats.
* an empty table: an empty history.
* further columns: ignored; only the four columns named below are read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, scratch_path
from ..sources import files

SCHEMA = "msg binary, delivery_id bigint, part string"
INDEX_SCHEMA = "msg binary, part string"
#: Messages that a file of a partition, or a bucket of the index, holds about.
FILE_ROWS = 2_000_000
#: Pieces of an index bucket that a merge writes into one.
PIECES = 6
#: Merges that start anew because another writer was faster.
ATTEMPTS = 8


def blob_name(blob: Column) -> Column:
    """The key from yyyy/mm/dd on, whatever store location stands in front; the key itself where it holds no date."""
    dated = F.regexp_extract(blob, r"([0-9]{4}/[0-9]{2}/[0-9]{2}/.*)$", 1)
    return F.when(dated != "", dated).otherwise(blob)


def message_key(url: Column, blob: Column, fetched_at: Column) -> Column:
    """Null where url is null. The parts are length-prefixed, so no two messages share a key."""
    name = F.nullif(blob_name(blob), F.lit(""))
    what = F.coalesce(F.concat(F.lit("b:"), name), F.concat(F.lit("t:"), F.coalesce(F.unix_micros(fetched_at.cast("timestamp")).cast("string"), F.lit("-"))))
    return F.concat(F.length(url).cast("string"), F.lit(":"), url, F.lit("|"), what)


def message_id(url: Column, blob: Column, fetched_at: Column) -> Column:
    """128 bits that stand for the key; null where url is null."""
    return F.unhex(F.substring(F.sha2(message_key(url, blob, fetched_at), 256), 1, 32))


def _winner(df: DataFrame) -> DataFrame:
    """One row per message; partial aggregation leaves a hot one a row per task before the shuffle."""
    best = F.min_by(F.struct("delivery_id", "part"), F.struct(F.col("delivery_id").isNull(), F.col("delivery_id"), F.col("part")))
    return df.groupBy("msg").agg(best.alias("_w")).select("msg", "_w.delivery_id", "_w.part")


class ConcurrentMerge(RuntimeError):
    """Other writers were faster ATTEMPTS times."""


class DeliveryStore:
    """Winners in day partitions under path, with an identifier index beside them."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "deliveries")

    # -- manifest -----------------------------------------------------------------------------------

    def manifest(self) -> dict:
        """number, parts {day: [folder, rows]}, buckets and index {bucket: [folders]}, rows, retired. Its size follows days and buckets, not messages."""
        numbers = [int(n[9:-5]) for n in files.names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        return files.read_json(self.spark, self._manifest_path(max(numbers))) if numbers else {"number": 0, "parts": {}, "buckets": 1, "index": {}, "rows": 0, "retired": []}

    def _manifest_path(self, number: int) -> str:
        return f"{self.path}/manifest-{number:012}.json"

    def _publish(self, old: dict, new: dict) -> bool:
        """False where another writer has published this number. Then nothing has changed."""
        if not files.create_json(self.spark, self._manifest_path(new["number"]), new):
            return False
        for folder in old["retired"]:  # named by no manifest since the one before the last
            delete_path(self.spark, f"{self.path}/{folder}")
        if new["number"] > 2:
            delete_path(self.spark, self._manifest_path(new["number"] - 2))
        return True

    # -- reading ------------------------------------------------------------------------------------

    def _read(self, manifest: dict, parts: list[str]) -> DataFrame:
        folders = [f"{self.path}/{manifest['parts'][p][0]}" for p in sorted(parts) if p in manifest["parts"]]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def winners(self) -> DataFrame:
        """msg, delivery_id, part: the copies that are kept."""
        manifest = self.manifest()
        return self._read(manifest, list(manifest["parts"]))

    def index(self, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """msg, part: the home of every message, or of those in some buckets."""
        manifest = manifest or self.manifest()
        folders = [f"{self.path}/{x}" for b, own in sorted(manifest["index"].items()) if buckets is None or int(b) in buckets for x in own]
        return self.spark.read.schema(INDEX_SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], INDEX_SCHEMA)

    # -- merging ------------------------------------------------------------------------------------

    def merge(self, incoming: DataFrame) -> list[str]:
        """Merge messages with columns delivery_id, url, blob, fetched_at; the names of the partitions that were rewritten."""
        keyed = incoming.select(
            message_id(F.col("url"), F.col("blob"), F.col("fetched_at")).alias("msg"),
            F.col("delivery_id").cast("bigint").alias("delivery_id"),
            F.coalesce(F.date_format("fetched_at", "yyyy-MM-dd"), F.lit("none")).alias("part"),
        ).where("msg is not null")
        staged = f"{self.path}/staged-{uuid.uuid4().hex}"
        _winner(keyed).write.parquet(staged)
        fresh = self.spark.read.schema(SCHEMA).parquet(staged)
        try:
            for _ in range(ATTEMPTS):
                touched = self._attempt(fresh)
                if touched is not None:
                    return touched
        finally:
            delete_path(self.spark, staged)
        raise ConcurrentMerge(self.path)

    def _attempt(self, fresh: DataFrame) -> list[str] | None:
        manifest, version = self.manifest(), uuid.uuid4().hex
        made = f"{self.path}/v-{version}"
        place = F.pmod(F.xxhash64("msg"), F.lit(manifest["buckets"])).cast("int")
        buckets = sorted(r[0] for r in fresh.select(place.alias("b")).distinct().collect())  # as many as buckets
        index = self.index(manifest, buckets).withColumnRenamed("part", "home")
        placed_columns = [F.col("msg"), F.col("delivery_id"), F.coalesce("home", "part").alias("part"), F.col("home").isNull().alias("is_new")]
        fresh.join(index, "msg", "left").select(*placed_columns).write.parquet(f"{made}/placed")
        placed = self.spark.read.schema(SCHEMA + ", is_new boolean").parquet(f"{made}/placed")
        sizes = {r["part"]: (r["n"], r["new"]) for r in placed.groupBy("part").agg(F.count("*").alias("n"), F.count_if("is_new").alias("new")).collect()}  # as many as days
        if sizes:
            rows = {p: manifest["parts"].get(p, ["", 0])[1] + new for p, (_, new) in sizes.items()}
            merged = _winner(self._read(manifest, list(sizes)).unionByName(placed.select("msg", "delivery_id", "part")))
            self._write_parts(merged, rows, made)
        new = self._next_index(manifest, placed, buckets, sum(n for _, n in sizes.values()), made, version)
        gone = [manifest["parts"][p][0] for p in sizes if p in manifest["parts"]]
        new["parts"] = manifest["parts"] | {p: [f"v-{version}/parts/home={p}", rows[p]] for p in sizes}
        new["retired"] = [*new["retired"], *gone, f"v-{version}/placed"]
        if self._publish(manifest, new):
            return sorted(sizes)
        delete_path(self.spark, made)
        return None

    def _write_parts(self, merged: DataFrame, rows: dict[str, int], made: str) -> None:
        """A folder a day, in files of FILE_ROWS rows."""
        counts = {p: -(-n // FILE_ROWS) for p, n in rows.items()}
        per_day = F.coalesce(F.create_map(*[x for p, n in sorted(counts.items()) for x in (F.lit(p), F.lit(n))])[F.col("part")], F.lit(1)) if max(counts.values()) > 1 else F.lit(1)
        file = F.pmod(F.xxhash64("msg"), per_day).cast("int")
        target = max(1, min(sum(counts.values()), 100_000))
        merged.withColumn("home", F.col("part")).repartition(target, "part", file).write.partitionBy("home").parquet(f"{made}/parts")

    def _next_index(self, manifest: dict, placed: DataFrame, buckets: list[int], added: int, made: str, version: str) -> dict:
        """The next manifest with its index: new entries beside the old ones, buckets of many pieces written into one, all of it cut anew when it has grown fourfold."""
        new = {"number": manifest["number"] + 1, "rows": manifest["rows"] + added, "buckets": manifest["buckets"], "index": dict(manifest["index"]), "retired": []}
        entries = placed.where("is_new").select("msg", "part")
        wanted = max(1, -(-new["rows"] // FILE_ROWS))
        grown = wanted >= 4 * manifest["buckets"]
        full = list(map(int, manifest["index"])) if grown else [b for b in buckets if len(manifest["index"].get(str(b), [])) >= PIECES]
        if grown:
            new["buckets"], new["index"] = wanted, {}
        if full:
            entries = entries.unionByName(self.index(manifest, full))
            new["retired"] = [x for b in full for x in manifest["index"].get(str(b), [])]
        if added or full:
            place = F.pmod(F.xxhash64("msg"), F.lit(new["buckets"])).cast("int")
            entries.withColumn("bucket", place).repartition(max(1, min(new["buckets"], 100_000)), "bucket").write.partitionBy("bucket").parquet(f"{made}/index")
            for name in files.names(self.spark, f"{made}/index"):
                if name.startswith("bucket="):
                    b = name[7:]
                    kept = [] if int(b) in full else new["index"].get(b, [])
                    new["index"][b] = [*kept, f"v-{version}/index/{name}"]
        return new


def replay(store: DeliveryStore, messages: DataFrame, rounds: int = 3) -> DeliveryStore:
    """Merge a table of deliveries in arrival order: equal ranges of delivery ids, one merge each."""
    low, high = messages.agg(F.min("delivery_id"), F.max("delivery_id")).first()
    if low is None:
        store.merge(messages)
        return store
    step = max(1, -(-(high - low + 1) // rounds))
    for start in range(low, high + 1, step):
        last = start + step > high
        within = F.col("delivery_id").between(start, start + step - 1)
        store.merge(messages.where(within | F.col("delivery_id").isNull() if last else within))
    return store


def repeated_deliveries(store: DeliveryStore, messages: DataFrame) -> DataFrame:
    """delivery_id of every message copy that the store does not keep, equal and null ids among them."""
    named = messages.select(message_id(F.col("url"), F.col("blob"), F.col("fetched_at")).alias("msg"), F.col("delivery_id").cast("bigint").alias("delivery_id")).where("msg is not null")
    copies = named.groupBy("msg", "delivery_id").agg(F.count("*").alias("_n"))
    kept = store.winners().select("msg", F.col("delivery_id").alias("_kept"), F.lit(1).alias("_one"))
    extra = F.col("_n") - F.when(F.col("delivery_id").eqNullSafe(F.col("_kept")) & F.col("_one").isNotNull(), 1).otherwise(0)
    return copies.join(kept, "msg", "left").withColumn("_extra", extra.cast("int")).where("_extra > 0").select(F.explode(F.array_repeat("delivery_id", F.col("_extra"))).alias("delivery_id"))
