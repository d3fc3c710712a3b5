"""Index segments and generations on shared storage, and the index that grows by them.

A segment is a folder of tables; its manifest, written last, is the commit mark
and names every file with its size. A generation names its segments and the
tombstones that hold; publishing one flips a pointer, rolling back follows its
parent. Searches read the tables of the published generation.

Postings lie in ranges of (term, document), so a query's terms are few row groups
of few files, a common term is spread over many, and their number follows the
data. Every posting carries the length of its document: scoring joins nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index
from ..session import REMEMBERED, attach, scratch_path
from . import files

TABLES = ("docs", "postings", "dictionary", "blocks", "bounds")
#: Postings of a file.
FILE_POSTINGS = 8_000_000
#: Document ids of a segment follow each other; those of the next one begin here.
SEGMENT_IDS = 1 << 40


def _row_hash(df: DataFrame) -> str:
    """An order-free hash of all rows."""
    return str(df.agg(F.coalesce(F.sum(F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)]).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()[0])


def write_segment(docs: DataFrame, path: str, analyzer: str, k1: float = 1.2, b: float = 0.75, hashes: bool = False) -> dict:
    """IO-10. docs: external_id, terms, static_rank, length (as index.records gives). hashes: note what the rows hash to, for a full check on opening."""
    spark = docs.sparkSession
    numbered = index.assign_doc_ids(docs)
    numbered.write.parquet(f"{path}/docs")
    numbered = spark.read.parquet(f"{path}/docs")
    size = numbered.agg(F.count("*").alias("n"), F.avg("length").alias("a"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("p")).first()
    posts = index.postings(numbered.select("doc_id", "terms", "length"), keep=["length"]).withColumn("range", index.range_of(F.col("doc_id")))
    posts.repartitionByRange(max(1, -(-size["p"] // FILE_POSTINGS)), "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings")
    posts = spark.read.parquet(f"{path}/postings")
    index.dictionary(posts).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/dictionary")
    index.posting_blocks(posts, numbered).write.parquet(f"{path}/blocks")
    average = attach(posts, numbered.agg(F.avg("length").alias("_avg")))
    index.range_bounds(average, k1, b).repartitionByRange("term").sortWithinPartitions("term", "range").write.parquet(f"{path}/bounds")
    manifest = {
        "id": uuid.uuid4().hex, "analyzer": analyzer, "doc_count": size["n"], "avg_length": size["a"], "scorer": {"k1": k1, "b": b}, "created_at": datetime.now(UTC).isoformat(),
        "tables": {t: files.sizes(spark, f"{path}/{t}") for t in TABLES}, "hashes": {t: _row_hash(spark.read.parquet(f"{path}/{t}")) for t in TABLES} if hashes else {},
    }
    files.write_json(spark, f"{path}/manifest.json", manifest)
    return manifest


def open_segment(spark: SparkSession, path: str, verify: bool = True, rows: bool = False) -> tuple[dict, dict[str, DataFrame]]:
    """IO-11: manifest and tables; an unfinished or altered segment is refused, by its files or (rows) by all that is in them."""
    manifest = files.read_json(spark, f"{path}/manifest.json")
    if manifest is None:
        raise FileNotFoundError(f"{path} holds no finished segment")
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in manifest["tables"]}
    for t, df in tables.items():
        if verify and files.sizes(spark, f"{path}/{t}") != manifest["tables"][t]:
            raise ValueError(f"{path}/{t} differs from its manifest")
        if rows and _row_hash(df) != manifest["hashes"].get(t):
            raise ValueError(f"the rows of {path}/{t} differ from its manifest")
    return manifest, tables


class Generations:
    """IO-14/18: generations under path, a pointer to the one that serves."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def current(self) -> dict | None:
        pointer = files.read_json(self.spark, f"{self.path}/current.json")
        return None if pointer is None else files.read_json(self.spark, f"{self.path}/generation-{pointer['id']}.json")

    def publish(self, segments: list[str], tombstones: list[str] | None = None) -> dict:
        """The gate: all segments must open, and share one analyzer."""
        manifests = [open_segment(self.spark, s)[0] for s in segments]
        if len({m["analyzer"] for m in manifests}) > 1:
            raise ValueError("segments of different analyzers can't serve together")
        before = self.current()
        own = {"id": uuid.uuid4().hex, "segments": segments, "tombstones": tombstones or [], "doc_count": sum(m["doc_count"] for m in manifests), "analyzer_version": manifests[0]["analyzer"] if manifests else None, "created_at": datetime.now(UTC).isoformat(), "parent": before and before["id"]}
        files.write_json(self.spark, f"{self.path}/generation-{own['id']}.json", own)
        files.write_json(self.spark, f"{self.path}/current.json", {"id": own["id"]})
        return own

    def rollback(self) -> dict:
        now = self.current()
        if now is None or not now["parent"]:
            raise ValueError("there is no generation before this one")
        files.write_json(self.spark, f"{self.path}/current.json", {"id": now["parent"]})
        return self.current()

    def table(self, name: str) -> DataFrame:
        """One table over the segments of the serving generation, with the segment's number; document ids and ranges go on from one segment to the next."""
        now = self.current()
        if now is None:
            raise FileNotFoundError("nothing is published")
        out = None
        for k, s in enumerate(now["segments"]):
            part = self.spark.read.parquet(f"{s}/{name}").withColumn("segment", F.lit(k))
            for c, step in (("doc_id", SEGMENT_IDS), ("range", SEGMENT_IDS // index.RANGE_DOCS)):
                if k and c in part.columns:
                    part = part.withColumn(c, F.col(c) + F.lit(k * step))
            out = part if out is None else out.unionByName(part)
        return out

    def tombstones(self) -> DataFrame:
        """external_id, action, at of the serving generation."""
        paths = (self.current() or {}).get("tombstones") or []
        schema = "external_id string, action string, at bigint"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


class SearchIndex:
    """IB-16/18/20: an index that takes documents and deletions, publishes what it has, and merges its segments when they are many or much is dead.

    What is added or deleted is on disk at once and searched after the next publish.
    """

    def __init__(self, spark: SparkSession, path: str, analyzer: str):
        self.spark, self.path, self.analyzer = spark, path, analyzer
        self.live = Generations(spark, path)
        serving = self.live.current() or {"segments": [], "tombstones": []}
        self.segments, self.dead = list(serving["segments"]), list(serving["tombstones"])

    def add(self, docs: DataFrame) -> str:
        """A new segment. docs as index.records gives them; a record that is in an older segment replaces it there."""
        path = f"{self.path}/segment-{uuid.uuid4().hex}"
        write_segment(docs, path, self.analyzer)
        if self.segments:
            self._mark(docs.select("external_id"), "delete")
        self.segments.append(path)
        return path

    def _mark(self, ids: DataFrame, action: str) -> None:
        """Holds for the segments that there are now: at is their number."""
        path = f"{self.path}/tombstones-{uuid.uuid4().hex}"
        ids.select("external_id", F.lit(action).alias("action"), F.lit(len(self.segments) * 1_000_000 + len(self.dead)).cast("bigint").alias("at")).write.parquet(path)
        self.dead.append(path)

    def delete(self, ids: DataFrame) -> None:
        self._mark(ids, "delete")

    def undelete(self, ids: DataFrame) -> None:
        self._mark(ids, "undelete")

    def publish(self) -> dict:
        return self.live.publish(self.segments, self.dead)

    def _alive(self, docs: DataFrame, marks: DataFrame) -> DataFrame:
        """docs: with their segment. The last mark made after a segment was there decides on its record."""
        own = docs.select("external_id", "segment").join(marks, "external_id").where(F.floor(F.col("at") / 1_000_000) > F.col("segment"))
        gone = own.groupBy("external_id", "segment").agg(F.max_by("action", "at").alias("_last")).where("_last = 'delete'")
        return docs.join(gone, ["external_id", "segment"], "left_anti")

    def _staged(self, name: str) -> DataFrame:
        parts = [self.spark.read.parquet(f"{s}/{name}").withColumn("segment", F.lit(k)) for k, s in enumerate(self.segments)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def maintain(self) -> bool:
        """IB-17/18: one segment from all of them where the rule asks for it; the deleted records are gone then."""
        if not self.segments:
            return False
        docs = self._staged("docs")
        marks = self.spark.read.parquet(*self.dead) if self.dead else self.spark.createDataFrame([], "external_id string, action string, at bigint")
        alive = self._alive(docs, marks)
        total, left = docs.count(), alive.count()
        if not index.should_merge(len(self.segments), total - left, total):
            return False
        path = f"{self.path}/segment-{uuid.uuid4().hex}"
        write_segment(alive.select("external_id", "terms", "static_rank", "length"), path, self.analyzer)
        self.segments, self.dead = [path], []
        return True

    def docs(self) -> DataFrame:
        """The documents of the serving generation."""
        return self.live.table("docs")

    def alive(self) -> DataFrame:
        return self._alive(self.docs(), self.live.tombstones())

    def postings(self) -> DataFrame:
        return self.live.table("postings")

    def bounds(self) -> DataFrame:
        return self.live.table("bounds")


@dataclass
class Published:
    """The tables of a published generation that a search reads."""

    docs: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    blocks: DataFrame
    bounds: DataFrame


_BUILT: dict[tuple, str] = {}
REMEMBERED.append(_BUILT)


def published(spark: SparkSession, key: tuple, make) -> Published:
    """A generation over the records that make() gives, built by the first caller of this application and read by all."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _BUILT:
        path = scratch_path(spark, "index")
        write_segment(make(), f"{path}/one", "a1")
        Generations(spark, path).publish([f"{path}/one"])
        _BUILT[key] = path
    live = Generations(spark, _BUILT[key])
    return Published(*[live.table(t).drop("segment") for t in TABLES])


def broken_rules(tables: dict[str, DataFrame]) -> DataFrame:
    """IB-30: rule and number of rows that break it; all 0 in a sound segment."""
    posts, words, docs, blocks = tables["postings"], tables["dictionary"], tables["docs"], tables["blocks"]
    count = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("rule"), "rows")
    truth = index.dictionary(posts)
    mismatch = words.join(truth.select("term", F.col("doc_freq").alias("_d"), F.col("total_tf").alias("_t")), "term", "full").where("not (doc_freq <=> _d and total_tf <=> _t)")
    orphans = posts.join(docs.select("doc_id"), "doc_id", "left_anti")
    stats = docs.agg(F.avg("length").alias("_avg"))
    over = attach(posts, stats).withColumn("_s", index.saturation(F.col("tf"), F.col("length"), F.col("_avg"))).groupBy("term").agg(F.max("_s").alias("_s"))
    low = over.join(blocks.groupBy("term").agg(F.max("max_saturation").alias("_m")), "term", "left").where("_m is null or _s > _m + 1e-9")
    return count(mismatch, "dictionary").unionByName(count(orphans, "orphans")).unionByName(count(low, "bounds"))
