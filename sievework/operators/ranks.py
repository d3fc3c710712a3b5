"""Ranking that never puts an unbounded group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Rows that one task orders at a time, where the order column is a dense number.
CHUNK = 1 << 16


def chunked_row_number(df: DataFrame, keys: list[str], order: list, chunk: Column, name: str) -> DataFrame:
    """row_number() - 1 over (partition by keys order by order), for a chunk that rises with the order.

    Rows are numbered within (keys, chunk); the chunks of a key are few and give the offsets.
    """
    rows = df.withColumn("_chunk", chunk)
    counts = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(*order)) - 1
    return rows.withColumn("_inner", inner).join(offsets, [*keys, "_chunk"]).withColumn(name, (F.col("_inner") + F.col("_before")).cast("bigint")).drop("_chunk", "_inner", "_before")


def global_row_number(df: DataFrame, order: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """row_number() - 1 over the whole table: range partitions, numbered inside, with offsets of as many rows as partitions."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row a partition
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return placed.withColumn("_inner", inner).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_inner") + F.col("_before")).cast("bigint")).drop("_part", "_inner", "_before")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: Column, name: str = "rank", shards: int = 32) -> DataFrame:
    """The k first rows of each group: first within shards (map side, so to say), then among the shards' winners."""
    part = Window.partitionBy(*keys, "_shard").orderBy(*order)
    local = df.withColumn("_shard", F.pmod(F.xxhash64(spread), F.lit(shards))).withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k).drop("_r", "_shard")
    return local.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def _over_cells(rows: DataFrame, keys: list[str], ends: DataFrame, value: Column, name: str) -> DataFrame:
    """rows with a value taken over the cells of their key: ends has a row a key and cell, so that window is small. Null keys are a key of their own."""
    found = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_c"), value.alias(name))
    same = F.col("_cell").eqNullSafe(F.col("_c"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(found, same, "left").drop("_c", *[f"_k{i}" for i in range(len(keys))])


def chunked_neighbour(df: DataFrame, keys: list[str], order: list[str], cell: Column, values: list[str], name: str, ahead: bool = False) -> DataFrame:
    """name: struct of the values of the row before (or ahead) within its key, where cell rises with the order.

    Rows are ordered within (keys, cell), so a hot key is spread over its cells; the neighbour of a cell's outer row is
    that of the nearest cell that has rows.
    """
    rows = df.withColumn("_cell", cell)
    turned = (lambda c: F.desc(c)) if ahead else (lambda c: F.asc(c))
    inner = F.lag(F.struct(*values)).over(Window.partitionBy(*keys, "_cell").orderBy(*map(turned, order)))
    pick = F.min_by if ahead else F.max_by
    ends = rows.groupBy(*keys, "_cell").agg(pick(F.struct(*values), F.struct(*order)).alias("_end"))
    outer = F.lag("_end").over(Window.partitionBy(*keys).orderBy(turned("_cell")))
    return _over_cells(rows.withColumn("_in", inner), keys, ends, outer, "_out").withColumn(name, F.coalesce("_in", "_out")).drop("_in", "_out", "_cell")


def chunked_last(df: DataFrame, keys: list[str], order: list[str], cell: Column, value: Column, name: str) -> DataFrame:
    """name: the last non-null value up to the row within its key, in cells as chunked_neighbour has them."""
    rows = df.withColumn("_cell", cell).withColumn("_v", value)
    inner = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy(*keys, "_cell").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_end"))
    outer = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    return _over_cells(rows.withColumn("_in", inner), keys, ends, outer, "_out").withColumn(name, F.coalesce("_in", "_out")).drop("_in", "_out", "_cell", "_v")


def chunked_sum(df: DataFrame, keys: list[str], order: list[str], cell: Column, value: Column, name: str) -> DataFrame:
    """name: the running sum up to the row within its key, in cells as chunked_neighbour has them."""
    rows = df.withColumn("_cell", cell).withColumn("_v", value)
    inner = F.sum("_v").over(Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.groupBy(*keys, "_cell").agg(F.sum("_v").alias("_end"))
    outer = F.sum("_end").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    return _over_cells(rows.withColumn("_in", inner), keys, ends, outer, "_out").withColumn(name, F.col("_in") + F.coalesce("_out", F.lit(0))).drop("_in", "_out", "_cell", "_v")
