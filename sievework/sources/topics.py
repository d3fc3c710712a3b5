"""Message topics: keyed JSON in Kafka where it is there, else in folders; and the three outputs of a parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed schemas of the messages.
FETCHED = (
    "doc_id string, url string, requested_url string, blob string, content_hash string, fetched_at timestamp, status int, outcome string, etag string, last_modified string, content_type string, "
    "size_bytes bigint, elapsed_ms bigint, redirect_target string, redirect_permanent boolean"
)
LINKS = "source_url string, target_url string, anchor_text string, context string, internal boolean, in_main_content boolean"
DISCOVERED = "url string, source_url string"


def kafka_source(spark: SparkSession, servers: str, topic: str, schema: str, per_trigger: int = 200_000) -> DataFrame:
    """IO-04: earliest first; the offsets are committed by the checkpoint after the sink has written."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load()
    return raw.select(F.col("key").cast("string").alias("message_key"), F.from_json(F.col("value").cast("string"), schema).alias("_m")).select("message_key", "_m.*")


def kafka_sink(messages: DataFrame, servers: str, topic: str, key: str, checkpoint: str):
    """IO-05: idempotent, acknowledged by all, compressed."""
    out = messages.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*messages.columns)).alias("value"))
    return (
        out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("kafka.enable.idempotence", "true")
        .option("kafka.compression.type", "zstd").option("checkpointLocation", checkpoint).start()
    )


def folder_source(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same from a folder of JSON lines; a broken line becomes a row of nulls."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def folder_sink(messages: DataFrame, path: str) -> None:
    messages.write.mode("append").json(path)


def parse_outputs(pages: DataFrame) -> dict[str, DataFrame]:
    """IO-08/09: documents (unless noindex), links (unless nofollow) and discovered addresses of parsed pages."""
    indexable = ~F.array_contains("robots_meta", "noindex")
    follows = ~F.array_contains("robots_meta", "nofollow")
    documents = pages.where(indexable).select(
        F.coalesce("canonical_url", "url").alias("url"), "title", "headings", "meta_description", "lang", F.array_sort("robots_meta").alias("robots_meta"), "published", F.size("links").alias("outlink_count")
    )
    links = pages.where(follows).select(F.col("url").alias("source_url"), F.explode("links").alias("_l")).select("source_url", "_l.*")
    return {"documents": documents, "links": links.select([c.split()[0] for c in LINKS.split(", ")]), "discovered": links.groupBy(F.col("target_url").alias("url")).agg(F.min("source_url").alias("source_url"))}


def replay(messages: DataFrame, offset: str, since) -> DataFrame:
    """IO-20: the messages from an offset on; sinks that merge by key take them again without harm."""
    return messages.where(F.col(offset) >= F.lit(since))


def collected(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """IO-06: run a stream over all that is there into a table in the driver's memory, for dry runs of aggregates."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def inspect_page(path: str, url: str, content_type: str = "text/html") -> dict:
    """IO-16: one local file through the parser, with what a person wants to know of it."""
    from ..functions.charset import decode
    from ..functions.html import parse_page

    with open(path, "rb") as f:
        body = f.read()
    text, encoding, source = decode(body, content_type)
    page = parse_page(text, url)
    return {"encoding": encoding, "encoding_source": source, "bytes": len(body), "title": page["title"], "blocks": len(page["blocks"]), "links": len(page["links"]), "lang": page["lang"], "warning": page["warning"]}
