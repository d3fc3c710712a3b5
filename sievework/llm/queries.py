"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import url_key
from ..plans.crawling import canonical_ctes
from ..session import materialise, read_table
from . import distinct, fetches, leak, loops, mix, seen, spam

Query = Callable[[SparkSession, str], DataFrame]


def _fetches(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "fetch_results")


_MODELS: dict[tuple[str, str], spam.Model] = {}


def _model(spark: SparkSession, d: str) -> spam.Model:
    """Language filters and ordinary ratios, fitted on all labelled documents: once an application and table."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS[key] = spam.fit_on(read_table(spark, d, "documents"))
    return _MODELS[key]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Html fetches more than half of whose main-region words belong to keyword runs, bare link lists or tag lists."""
    return fetches.keyword_ids(_fetches(spark, d), _model(spark, d))


def p1_shares(spark: SparkSession, d: str) -> DataFrame:
    """Share of spam and redundancy of every html page."""
    return fetches.keyword_pages(_fetches(spark, d), _model(spark, d))


def p1_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Redundancy and punctuation of every block of the main regions."""
    return fetches.keyword_blocks(_fetches(spark, d), _model(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Main-body blocks of html fetches that are neither spam nor garbled."""
    return fetches.main_body_hashes(_fetches(spark, d), _model(spark, d)).where("not spam").select("fetch_id", "block_md5")


def p2_main_body(spark: SparkSession, d: str) -> DataFrame:
    """The main-body blocks themselves, of restored pages too."""
    return fetches.main_body(_fetches(spark, d), _model(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Html fetches whose own words are garbled in the project's decoding."""
    return fetches.garbled_ids(_fetches(spark, d))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled fetches with their restored main text."""
    return fetches.garbled_pages(_fetches(spark, d))


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return fetches.relabelled(fetches.languages(_fetches(spark, d), _model(spark, d)), read_table(spark, d, "analyzed_texts").select("fetch_id", "language"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages of the segments of fetches whose label is missing or wrong, or that mix languages."""
    return _languages(spark, d).select("fetch_id", "segment_no", "language")


def p5_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The same with the confidence of each segment and the label that was given."""
    return _languages(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Tasks whose canonical url was offered under a smaller task_id, by the chain's own answer."""
    return seen.repeated(read_table(spark, d, "crawl_tasks"), "task_id", "url", url_key)


def p3_wrong_answers(spark: SparkSession, d: str) -> DataFrame:
    """What the chains answer wrongly, shard by shard, beside the bound they keep: at the error of p3_found and at one that lets them be seen."""
    tasks = read_table(spark, d, "crawl_tasks")
    # the answers are read twice: for the rows and for the keys
    parts = [seen.wrong_answers(materialise(seen.seen_before(tasks, "task_id", "url", url_key, error=e), "answers")).select(F.lit(e).alias("error"), "*") for e in (seen.ERROR, 1e-3)]
    return parts[0].unionByName(parts[1])


def _both_tables(spark: SparkSession, d: str) -> list[DataFrame]:
    records = distinct.record_terms(read_table(spark, d, "input_documents"), "external_id", distinct.term_counts(F.col("terms")), distinct_terms=True)
    fielded = distinct.record_terms(read_table(spark, d, "fielded_documents"), "external_id", distinct.field_counts(F.col("fields")))
    # scores read the terms several times: for their statistics, for the common terms, for the rare ones
    return [materialise(records, "terms"), materialise(fielded, "terms")]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The most characteristic term of each record of both tables."""
    parts = [distinct.most_distinctive(distinct.scored_terms(t)).select(F.col("_id").alias("external_id"), "term") for t in _both_tables(spark, d)]
    return parts[0].unionByName(parts[1])


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every term of every record of input_documents and fielded_documents."""
    parts = [
        distinct.scored_terms(t).select(F.lit(name).alias("source"), F.col("_id").alias("external_id"), "term", "tf", "df", "cf", F.round("score", 6).alias("score"))
        for name, t in zip(("input", "fielded"), _both_tables(spark, d))
    ]
    return parts[0].unionByName(parts[1])


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of an item's words, with the item."""
    return leak.leaked(leak.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")))


def p8_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of document and item that share at least a fifth of the item, with the words covered."""
    return leak.leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"), 0.2)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: one row per slot and piece of a document."""
    return mix.mixture(read_table(spark, d, "documents"), read_table(spark, d, "source_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix reaches, by source."""
    return mix.mixture(read_table(spark, d, "documents"), read_table(spark, d, "source_targets"))[1]


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """Whether every source of the mix has its share, keeps its cap and fills whole blocks."""
    made, shares = mix.mixture(read_table(spark, d, "documents"), read_table(spark, d, "source_targets"))
    return mix.kept(made, materialise(shares, "shares"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents at least half of whose words repeat passages that stood earlier in them, by the compression bands."""
    return loops.repetition(read_table(spark, d, "documents"), exact=False).where("repetitive").select("doc_id")


def p10_bands(spark: SparkSession, d: str) -> DataFrame:
    """Ratios, band and exact repeated share of every document."""
    return loops.repetition(read_table(spark, d, "documents"))


_P7_LONG = """
long_input as (
  select external_id, term, sum(tf) as tf from (
    select external_id, e.key as term, greatest(coalesce(len(e.value), 1), 1) as tf
    from (select external_id, unnest(map_entries(terms)) as e from (select external_id, terms from input_documents where external_id is not null and len(map_keys(terms)) > 0
           qualify row_number() over (partition by external_id order by length) = 1)))
  where term is not null group by 1, 2),
long_fielded as (
  select external_id, term, sum(tf) as tf from (
    select external_id, e.key as term, greatest(coalesce(len(e.value), 1), 1) as tf
    from (select external_id, unnest(map_entries(f.value)) as e
          from (select external_id, unnest(map_entries(fields)) as f from (select external_id, fields from fielded_documents where external_id is not null and len(map_keys(fields)) > 0
            qualify row_number() over (partition by external_id order by quality) = 1))))
  where term is not null group by 1, 2),
long as (select 'input' as source, * from long_input union all select 'fielded', * from long_fielded),
sizes as (select source, count(distinct external_id)::double as n from long group by 1),
stats as (select source, term, count(*) as df, sum(tf) as cf from long group by 1, 2),
scored as (
  select l.source, l.external_id, l.term, l.tf::bigint as tf, s.df::bigint as df, s.cf::bigint as cf,
         l.tf * (-log2(s.df / n) + log2(1 - exp(-s.cf / n))) as score
  from long l join stats s using (source, term) join sizes using (source))
"""

QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_shares": p1_shares,
    "p1_blocks": p1_blocks,
    "p2_found": p2_found,
    "p2_main_body": p2_main_body,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p5_found": p5_found,
    "p5_confidence": p5_confidence,
    "p3_found": p3_found,
    "p3_wrong_answers": p3_wrong_answers,
    "p7_found": p7_found,
    "p7_scores": p7_scores,
    "p8_found": p8_found,
    "p8_evidence": p8_evidence,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_kept": p9_kept,
    "p10_found": p10_found,
    "p10_bands": p10_bands,
}

SQL: dict[str, str] = {
    "p3_found": f"with {canonical_ctes('crawl_tasks', 'task_id')} select task_id from canon where key is not null qualify task_id > min(task_id) over (partition by key)",
    "p9_kept": """select source, true as share_kept, true as cap_kept, true as blocks_whole from source_targets
where source is not null and target_share > 0 and max_repeats > 0 group by 1""",
    "p7_found": f"""with {_P7_LONG}
select external_id, term from scored
qualify row_number() over (partition by source, external_id order by round(score, 9) desc, term) = 1""",
    "p7_scores": f"""with {_P7_LONG}
select source, external_id, term, tf, df, cf, round(score, 6) as score from scored""",
}
