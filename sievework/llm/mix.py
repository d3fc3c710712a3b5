"""Mixing sources to target weights with a low-discrepancy schedule.

Each source is shuffled by hash and cut into blocks of equally many tokens; a
schedule of slots is laid out whose i-th point, the golden-ratio sequence
frac((i+1)/phi), falls into the cumulative target weights and names the source
of slot i. Slots of a source are ranked and take its blocks in turn, round after
round on a ring, up to the cap of repeats. Every prefix of the mix is
close to the targets, and the whole reaches them up to one block a source.

The size of the mix is the largest at which every source that has tokens can
give its share within its cap, so one scarce source may leave much of the others
unused, as the report shows (or a given total; a source that then runs dry
leaves its slots empty, which the report shows). Targets of sources without
tokens are divided among the others in proportion.

Ranks and running sums are made in chunks with offsets, never in one group.

Defined results
* null or unlisted source: not in the mix; null or empty text: no tokens.
* null or non-positive share or cap: the source is not in the mix.
* repeated rows: each is material of its own. Ties in the shuffle order: by id.
* a document longer than a block spreads over several; a source shorter than a block fills it in several rounds.
* an empty table: an empty mix. Further columns: ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import attach, spread

TOKENIZER = os.environ.get("SIEVEWORK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 2048
#: The largest vocabulary file that is broadcast.
VOCABULARY_BYTES = 64_000_000
#: Material per shuffle bucket and slots per ranking chunk: what one task orders at a time.
BUCKET_TOKENS = 20_000_000
CHUNK_SLOTS = 65_536
INVERSE_GOLDEN = 0.6180339887498949


def with_tokens(df: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source, tokens of a public tokenizer, whose vocabulary the driver reads and ships with the job."""
    with open(tokenizer, "rb") as f:
        vocabulary = f.read(VOCABULARY_BYTES + 1)
    if len(vocabulary) > VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer} is no vocabulary file")
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")).where("source is not null")
    return spread(rows).mapInPandas(run, "doc_id bigint, source string, tokens bigint").where("tokens > 0")


def plan(sized: DataFrame, targets: DataFrame, block: int = BLOCK, total_tokens: int | None = None) -> list[dict]:
    """Per source: its share among sources with tokens, its blocks, the interval of the unit line. As many rows as sources."""
    listed = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    have = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rows = [r.asDict() for r in listed.join(have, "source", "left").orderBy("source").collect()]
    live = [r for r in rows if r["tokens"]]
    weight = sum(r["share"] for r in live)
    start = 0.0
    for r in live:
        r["weight"] = r["share"] / weight
        r["low"], start = start, start + r["weight"]
        r["high"] = start
        r["blocks"] = -(-r["tokens"] // block)
    if live:
        live[-1]["high"] = 1.0
        room = min(r["tokens"] * r["cap"] / r["weight"] for r in live)
        slots = int((room if total_tokens is None else total_tokens) // block)
        for r in live:
            r["slots"] = slots
    return rows


def _by_source(live: list[dict], name: str):
    return F.create_map(*[x for r in live for x in (F.lit(r["source"]), F.lit(r[name]).cast("bigint"))])[F.col("source")]


def schedule(spark, plan_rows: list[dict]) -> DataFrame:
    """slot, source, rank: the source of every slot and the slot's number within its source."""
    live = [r for r in plan_rows if r.get("slots")]
    if not live:
        return spark.createDataFrame([], "slot bigint, source string, rank bigint")
    n = live[0]["slots"]
    parts = max(1, min(10_000, n // CHUNK_SLOTS + 1))
    spot = F.expr(f"(slot + 1) * {INVERSE_GOLDEN!r}D")
    point = spot - F.floor(spot)
    which = F
    for r in live[:-1]:  # one branch a source, a fixed small number
        which = which.when(point < F.lit(r["high"]), F.lit(r["source"]))
    which = F.lit(live[-1]["source"]) if which is F else which.otherwise(F.lit(live[-1]["source"]))
    slots = spark.range(0, n, 1, parts).withColumnRenamed("id", "slot").withColumn("source", which).withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
    counts = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("source", "chunk", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")) - 1
    return slots.withColumn("inner", inner).join(offsets, ["source", "chunk"]).select("slot", "source", (F.col("inner") + F.col("before")).alias("rank"))


def slot_cells(slots: DataFrame, plan_rows: list[dict], block: int = BLOCK) -> DataFrame:
    """slot, source, round, place, low, high: the tokens of each slot, as ranges within the blocks that a source is cut into.

    The shuffled tokens of a source form a ring: slot number r takes tokens r * block up to (r + 1) * block of it,
    round after round, so that all slots are equally long. Beyond the cap of repeats a slot stays empty.
    """
    live = [r for r in plan_rows if r.get("slots")]
    if not live:
        return slots.select("slot", "source", F.lit(0).alias("round"), F.lit(0).cast("bigint").alias("place"), "rank", F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high"))
    length, cap = _by_source(live, "tokens"), _by_source(live, "cap")
    spans = slots.withColumns({"_t": length, "_s": F.col("rank") * block}).withColumn("_e", F.least(F.col("_s") + block, F.col("_t") * cap)).where("_e > _s")
    rounds = spans.withColumn("round", F.explode(F.expr("sequence(floor(_s / _t), floor((_e - 1) / _t))")))
    low = F.greatest(F.col("_s") - F.col("round") * F.col("_t"), F.lit(0))
    high = F.least(F.col("_e") - F.col("round") * F.col("_t"), F.col("_t"))
    ranges = rounds.withColumns({"low": low, "high": high})
    cells = ranges.withColumn("place", F.explode(F.expr(f"sequence(floor(low / {block}), floor((high - 1) / {block}))")))
    return cells.select("slot", "source", F.col("round").cast("int").alias("round"), "place", "low", "high")


def block_pieces(sized: DataFrame, plan_rows: list[dict], block: int = BLOCK, seed: int = 7) -> DataFrame:
    """source, place, doc_id, start, first, last: the shuffled documents cut into blocks; tokens first up to last of the source, the document's own from start on."""
    live = {r["source"]: r for r in plan_rows if r.get("slots")}
    if not live:
        return sized.sparkSession.createDataFrame([], "source string, place bigint, doc_id bigint, start bigint, first bigint, last bigint")
    buckets = F.floor(_by_source([*live.values()], "tokens") / BUCKET_TOKENS) + 1
    mixed = sized.where(F.col("source").isin(*live)).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_b", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), buckets))
    sums = mixed.groupBy("source", "_b").agg(F.sum("tokens").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("source", "_b", before.alias("_before"))
    inner = F.coalesce(F.sum("tokens").over(Window.partitionBy("source", "_b").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = mixed.withColumn("_in", inner).join(offsets, ["source", "_b"]).withColumn("_start", F.col("_in") + F.col("_before"))
    first, last = F.floor(F.col("_start") / block), F.floor((F.col("_start") + F.col("tokens") - 1) / block)
    pieces = placed.withColumn("place", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("_start"), F.col("place") * block)
    high = F.least(F.col("_start") + F.col("tokens"), (F.col("place") + 1) * block)
    return pieces.select("source", "place", "doc_id", F.col("_start").alias("start"), low.alias("first"), high.alias("last"))


def mixture(documents: DataFrame, targets: DataFrame, block: int = BLOCK, total_tokens: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mix (slot, source, round, doc_id, first_token, piece_tokens) and the report by source."""
    from ..session import materialise

    spark = documents.sparkSession
    sized = materialise(with_tokens(documents, tokenizer), "mix-tokens")
    rows = plan(sized, targets, block, total_tokens)
    low, high = F.greatest("low", "first"), F.least("high", "last")
    both = slot_cells(schedule(spark, rows), rows, block).join(block_pieces(sized, rows, block), ["source", "place"]).where(low < high)
    mix = both.select("slot", "source", "round", "doc_id", (low - F.col("start")).alias("first_token"), (high - low).alias("piece_tokens"))
    return mix, report(mix, rows)


def kept(mix: DataFrame, shares: DataFrame, block: int = BLOCK) -> DataFrame:
    """source, share_kept (actual within three blocks of the planned share; an empty mix keeps all), cap_kept, blocks_whole.

    Blocks are whole when all slots of a source hold a block's tokens; only the last one may end at the source's cap of repeats.
    """
    lengths = mix.groupBy("slot", "source").agg(F.sum("piece_tokens").alias("_t"))
    last = lengths.groupBy("source").agg(F.max("slot").alias("_last"))
    uneven = lengths.join(last, "source").groupBy("source").agg(F.count_if((F.col("_t") != block) & ((F.col("slot") != F.col("_last")) | (F.col("_t") > block))).alias("_u"))
    total = shares.agg(F.sum("tokens_used").alias("_all"))
    rows = attach(shares.join(uneven, "source", "left"), total)
    near = F.abs(F.coalesce("actual_share", F.lit(0.0)) - F.col("planned_share")) <= F.lit(3.0 * block) / F.col("_all") + 1e-6
    near = (F.coalesce("_all", F.lit(0)) == 0) | near
    return rows.select("source", near.alias("share_kept"), (F.col("rounds") <= F.col("max_repeats")).alias("cap_kept"), (F.coalesce("_u", F.lit(0)) == 0).alias("blocks_whole"))


def report(mix: DataFrame, plan_rows: list[dict]) -> DataFrame:
    """source, target_share, planned_share, tokens_available, tokens_used, tokens_unused (in no round), actual_share, rounds, max_repeats."""
    used = mix.groupBy("source").agg(F.sum("piece_tokens").alias("tokens_used"), F.max("round").alias("_r"))
    known = mix.sparkSession.createDataFrame(
        [(r["source"], float(r["share"]), float(r.get("weight", 0.0)), int(r["tokens"] or 0), int(r["cap"])) for r in plan_rows],
        "source string, target_share double, planned_share double, tokens_available bigint, max_repeats int",
    )
    all_used = used.agg(F.sum("tokens_used").alias("_all"))
    joined = attach(known.join(used, "source", "left"), all_used)
    share = F.round(F.coalesce(F.col("tokens_used"), F.lit(0)) / F.col("_all"), 6)
    return joined.select(
        "source", "target_share", F.round("planned_share", 6).alias("planned_share"), "tokens_available", F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.greatest(F.col("tokens_available") - F.coalesce("tokens_used", F.lit(0)), F.lit(0)).alias("tokens_unused"),
        share.alias("actual_share"), F.coalesce(F.col("_r") + 1, F.lit(0)).alias("rounds"), "max_repeats",
    )
