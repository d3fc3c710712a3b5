"""Content-addressed bodies: written once, partitioned by day and hash prefix."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def blob_key(content_hash: Column, at: Column) -> Column:
    """IO-01: yyyy/mm/dd/hh/hash.gz, hh being the first two signs of the hash."""
    digest = F.regexp_replace(content_hash, "^sha256:", "")
    return F.concat(F.date_format(at, "yyyy/MM/dd"), F.lit("/"), F.substring(digest, 1, 2), F.lit("/"), digest, F.lit(".gz"))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(data=[gzip.compress(bytes(b), mtime=0) for b in pdf["data"]])


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(data=[gzip.decompress(bytes(b)) for b in pdf["data"]])


BLOB_SCHEMA = "content_hash string, key string, size_bytes bigint, data binary, dt string, prefix string"


def write_blobs(fetches: DataFrame, path: str) -> DataFrame:
    """Store the bodies that are not there yet; content_hash, key and size of all of them.

    fetches: body, content_hash, fetched_at. Null bodies and hashes are left out; of equal hashes the earliest is stored.
    """
    spark = fetches.sparkSession
    rows = fetches.where("body is not null and content_hash is not null").select("content_hash", F.col("body").alias("data"), "fetched_at")
    first = rows.groupBy("content_hash").agg(F.min("fetched_at").alias("fetched_at"))
    known = spark.read.parquet(path).select("content_hash") if files.exists(spark, path) else None
    new = first if known is None else first.join(known, "content_hash", "left_anti")
    bodies = new.join(rows, ["content_hash", "fetched_at"]).select("content_hash", blob_key(F.col("content_hash"), F.col("fetched_at")).alias("key"), "data", F.date_format("fetched_at", "yyyy-MM-dd").alias("dt"))
    one = bodies.dropDuplicates(["content_hash"]).withColumn("size_bytes", F.octet_length("data").cast("bigint")).withColumn("prefix", F.substring("key", 12, 2))
    one.select("content_hash", "key", "size_bytes", "data", "dt", "prefix").mapInPandas(_packed, BLOB_SCHEMA).write.mode("append").partitionBy("dt").option("maxRecordsPerFile", 50_000).parquet(path)
    return spark.read.parquet(path).select("content_hash", "key", "size_bytes")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """IO-03: key and body."""
    rows = spark.read.parquet(path).select("key", "data")
    return rows.mapInPandas(_unpacked, "key string, data binary").withColumnRenamed("data", "body")


def read_blob_files(spark: SparkSession, pattern: str) -> DataFrame:
    """IO-03 over loose files: path and body, gunzipped by suffix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "body": [gzip.decompress(bytes(b)) if p.endswith(".gz") else bytes(b) for p, b in zip(pdf["path"], pdf["content"])]})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(run, "path string, body binary")


def write_archive(pages: DataFrame, path: str, records_per_file: int = 100_000) -> None:
    """IO-17: large objects by day, rows of a day spread over tasks."""
    pages.withColumn("dt", F.date_format("fetched_at", "yyyy-MM-dd")).write.mode("append").partitionBy("dt").option("maxRecordsPerFile", records_per_file).parquet(path)


def archive_index(spark: SparkSession, path: str, key: str = "url") -> DataFrame:
    """IO-17: key, day, file and row of every record of an archive: where to find it without a scan."""
    return spark.read.parquet(path).select(key, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "dt")


def expire_archive(spark: SparkSession, path: str, before: str) -> list[str]:
    """IO-17: days before a date go, folder by folder; the days that went."""
    from ..session import delete_path

    days = sorted(n[3:] for n in files.names(spark, path) if n.startswith("dt=") and n[3:] < before)
    for d in days:
        delete_path(spark, f"{path}/dt={d}")
    return days


class DocumentStore:
    """IO-19: the newest version of every document, in buckets of its key: a lookup reads the buckets of the keys it asks for."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def write(self, docs: DataFrame, key: str, at: str) -> None:
        """docs: key, at and further columns; null keys are left out, of several versions the newest stays."""
        rest = [c for c in docs.columns if c != key]
        newest = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_r")).select(key, "_r.*")
        newest.withColumn("bucket", self._bucket(key)).repartition("bucket").sortWithinPartitions(key).write.partitionBy("bucket").parquet(self.path)

    def read(self, keys: DataFrame | None = None, key: str = "url") -> DataFrame:
        stored = self.spark.read.parquet(self.path)
        if keys is None:
            return stored.drop("bucket")
        wanted = keys.select(key).distinct().withColumn("bucket", self._bucket(key))
        touched = [r[0] for r in wanted.select("bucket").distinct().collect()]  # as many as buckets
        return stored.where(F.col("bucket").isin(touched)).join(wanted.select(key), key, "left_semi").drop("bucket")
