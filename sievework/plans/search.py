"""Index and ranking queries over input_documents, fielded_documents and embeddings, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codec, evaluate, index, ranking, ranks
from ..session import attach, materialise, read_table, scratch_path
from ..sources import segments

Query = Callable[[SparkSession, str], DataFrame]

SEARCHES = {"q1": ["tor", "zel"], "q2": ["fita", "rel", "lomel"], "q3": ["hul", "lo", "lo"], "q4": ["mel", "gadra", "tor", "no-such-term"]}
FIELD_SEARCHES = {"q1": ["fita", "lapri"], "q2": ["mel", "gadra", "tor"], "q3": ["zafen", "zafen", "kelri"]}


def _values(queries: dict[str, list[str]]) -> str:
    return ", ".join(f"('{q}', '{t}', {terms.count(t)})" for q, terms in queries.items() for t in dict.fromkeys(terms))


def _store(spark: SparkSession, d: str) -> segments.Published:
    """The published index over input_documents: built once an application, read by every search."""
    return segments.published(spark, ("input", d), lambda: index.records(read_table(spark, d, "input_documents")))


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _store(spark, d)
    return s.docs, s.postings


_DOCS = """
docs as (
  select external_id, terms, static_rank, length, row_number() over (order by static_rank desc, external_id) - 1 as doc_id from (
    select external_id, any_value(terms) as terms, coalesce(max(static_rank), 0) as static_rank,
           coalesce(max(length), len(list_distinct(flatten(map_values(any_value(terms))))), 0)::bigint as length
    from input_documents where external_id is not null group by 1)),
posts as (select doc_id, e.key as term, greatest(len(e.value), 1)::bigint as tf, list_sort(e.value) as positions from (select doc_id, unnest(map_entries(terms)) as e from docs)),
dict as (select term, count(*) as doc_freq, sum(tf) as total_tf from posts group by 1),
stats as (select count(*)::double as n, avg(length) as avg_length from docs)
"""

_SCORED = f"""
queries(query_id, term, qtf) as (values {_values(SEARCHES)}),
parts as (
  select q.query_id, p.doc_id, q.term, q.qtf * ln(1 + (n - d.doc_freq + 0.5) / (d.doc_freq + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * x.length / avg_length)) as part
  from queries q join posts p using (term) join dict d using (term) join docs x using (doc_id), stats),
scored as (select query_id, doc_id, sum(part) as score from parts group by 1, 2)
"""


def _top(table: str, k: int = 10, key: str = "doc_id", extra: str = "") -> str:
    return f"""select query_id, {key}, {extra}round(score, 6) as score, rank::bigint as rank from (
  select *, row_number() over (partition by query_id order by round(score, 9) desc, {key}) as rank from {table}) where rank <= {k}"""


def _out(ranked: DataFrame, key: str = "doc_id") -> DataFrame:
    return ranked.select("query_id", key, F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def dictionary_stats(spark, d):
    return _store(spark, d).dictionary


def docid_assignment(spark, d):
    return _index(spark, d)[0].select("doc_id", "external_id", "static_rank", "length")


def inverted_postings(spark, d):
    return _index(spark, d)[1].select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


def posting_blocks(spark, d):
    return _store(spark, d).blocks.withColumn("max_saturation", F.round("max_saturation", 6))


def posting_range_bounds(spark, d):
    """IB-05 by ranges of document ids."""
    return _store(spark, d).bounds.withColumn("max_saturation", F.round("max_saturation", 6))


def posting_gaps(spark, d):
    return index.posting_gaps(_index(spark, d)[1])


def front_coding(spark, d):
    return index.front_coding(index.dictionary(_index(spark, d)[1]))


def corpus_stats_merge(spark, d):
    docs = index.records(read_table(spark, d, "input_documents"))
    segments = docs.groupBy(F.substring("external_id", 3, 1).alias("segment")).agg(F.count("*").alias("doc_count"), F.avg("length").alias("avg_length"))
    return index.merge_corpus_stats(segments).select("doc_count", F.round("avg_length", 6).alias("avg_length"))


def _tombstones(docs: DataFrame) -> DataFrame:
    """Deletions of low-ranked records, some of them taken back later."""
    low = docs.where("static_rank < 0.01").select("external_id", F.lit("delete").alias("action"), F.lit(1).alias("at"))
    back = docs.where("static_rank < 0.002").select("external_id", F.lit("undelete").alias("action"), F.lit(2).alias("at"))
    return low.unionByName(back)


def segment_merge(spark, d):
    docs = index.records(read_table(spark, d, "input_documents")).withColumn("analyzer", F.lit("a1"))
    first = F.substring("external_id", 3, 1) < "8"
    merged = index.merge_segments([docs.where(first), docs.where(~first)], _tombstones(docs))
    return merged.select("doc_id", "external_id", "length")


def bm25_topk(spark, d):
    s = _store(spark, d)
    return _out(ranking.bm25_top_k(s.postings, s.docs, ranking.query_table(spark, SEARCHES), dictionary=s.dictionary))


def _pruned(spark, d):
    s = _store(spark, d)
    return ranking.bm25_pruned_top_k(s.postings, s.docs, ranking.query_table(spark, SEARCHES), bounds=s.bounds, dictionary=s.dictionary)


def bm25_pruned_topk(spark, d):
    return _out(_pruned(spark, d)[0])


def bm25_pruning_stats(spark, d):
    return _pruned(spark, d)[1].withColumn("skip_ratio", F.round("skip_ratio", 6))


def bm25_multisegment_topk(spark, d):
    """df per segment, length statistics of all: what a search over unmerged segments gives."""
    docs, posts = _index(spark, d)
    queries = ranking.query_table(spark, SEARCHES)
    segment = F.when(F.substring("external_id", 3, 1) < "8", 0).otherwise(1)
    docs = docs.withColumn("segment", segment)
    placed = ranking.matching(posts, queries).join(docs.select("doc_id", "segment"), "doc_id")
    df = placed.groupBy("segment", "term").agg(F.count_distinct("doc_id").alias("_df"))
    total = docs.agg(F.count("*").alias("_n"), F.avg("length").alias("_avg"))
    rows = attach(placed.join(F.broadcast(df), ["segment", "term"]), total)
    part = F.col("qtf") * index.idf(F.col("_df"), F.col("_n")) * index.saturation(F.col("tf"), F.col("length"), F.col("_avg"))
    scores = rows.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))
    return _out(ranking.best(scores, 10))


def bm25_with_tombstones(spark, d):
    """Deleted records still count in the statistics, but are no hits."""
    docs, posts = _index(spark, d)
    scores = ranking.scored(posts, docs, ranking.query_table(spark, SEARCHES))
    alive = index.live(docs, _tombstones(docs)).select("doc_id")
    return _out(ranking.best(scores.join(alive, "doc_id", "left_semi"), 10))


def minimum_should_match(spark, d):
    docs, posts = _index(spark, d)
    hits = ranking.matching(posts, ranking.query_table(spark, SEARCHES))
    return hits.groupBy("query_id", "doc_id").agg(F.count_distinct("term").alias("matched")).where("matched >= 2")


def phrase_match(spark, d):
    return ranking.phrase_matches(_index(spark, d)[1], "tor", "zel", slop=2)


def proximity_sdm(spark, d):
    return ranking.sequential_dependence(_index(spark, d)[1], "tor", "zel").withColumn("score", F.round("score", 6))


def search_page(spark, d):
    docs, posts = _index(spark, d)
    return _out(ranking.page_of(ranking.best(ranking.scored(posts, docs, ranking.query_table(spark, SEARCHES)), 40), 10, 20))


def suggest_terms(spark, d):
    """The five most frequent completions of each two-letter prefix."""
    words = index.dictionary(_index(spark, d)[1]).where("length(term) >= 2").select(F.substring("term", 1, 2).alias("prefix"), "term", "doc_freq")
    return ranks.top_k(words, ["prefix"], [F.desc("doc_freq"), F.asc("term")], 5, F.col("term")).select("prefix", "term", "doc_freq", F.col("rank").cast("bigint").alias("rank"))


def tier_and_shard(spark, d):
    """IB-25: tier from rank and length, shard from the document's hash."""
    docs = index.records(read_table(spark, d, "input_documents"))
    tier = F.when(F.col("static_rank") >= 0.5, 0).when((F.col("static_rank") >= 0.05) & (F.col("length") >= 50), 1).otherwise(2)
    shard = F.pmod(F.conv(F.substring(F.md5("external_id"), 1, 8), 16, 10).cast("bigint"), F.lit(16))
    return docs.groupBy(tier.alias("tier"), shard.alias("shard")).agg(F.count("*").alias("docs"), F.sum("length").alias("tokens"))


def tier_spill(spark, d):
    """RK-29: tier 0 answers; queries with fewer than 20 results there take the other tiers too."""
    docs, posts = _index(spark, d)
    scores = ranking.scored(posts, docs, ranking.query_table(spark, SEARCHES)).join(docs.select("doc_id", (F.col("static_rank") < 0.9).alias("_low")), "doc_id")
    enough = scores.where("not _low").groupBy("query_id").agg(F.count("*").alias("_n"))
    rows = scores.join(F.broadcast(enough), "query_id", "left").where("not _low or coalesce(_n, 0) < 20")
    return _out(ranking.best(rows.select("query_id", "doc_id", "score"), 10))


def _judgments(docs: DataFrame, scores: DataFrame) -> DataFrame:
    return scores.select("query_id", "doc_id").join(docs.select("doc_id", F.floor(F.col("static_rank") * 4).cast("double").alias("grade")), "doc_id").select("query_id", "doc_id", "grade")


def ndcg_eval(spark, d):
    docs, posts = _index(spark, d)
    scores = ranking.scored(posts, docs, ranking.query_table(spark, SEARCHES))
    return evaluate.ndcg(ranking.best(scores, 10), _judgments(docs, scores)).withColumn("ndcg", F.round("ndcg", 6))


def grid_search(spark, d):
    docs, posts = _index(spark, d)
    queries = ranking.query_table(spark, SEARCHES)
    judged = _judgments(docs, ranking.scored(posts, docs, queries))
    return evaluate.grid_search(posts, docs, queries, judged).withColumn("mean_ndcg", F.round("mean_ndcg", 6))


def lever_gain(spark, d):
    grid = grid_search(spark, d)
    return evaluate.lever(grid).select(*[F.round(c, 6).alias(c) for c in ("best", "worst", "gain")])


# --- binary forms ------------------------------------------------------------------------------------


def posting_codec(spark, d):
    """IB-06..08: postings through packed gaps and variable-length frequencies, and back."""
    return codec.decoded_postings(materialise(codec.encoded_postings(_store(spark, d).postings), "encoded"))


def posting_codec_sizes(spark, d):
    """IB-08: bits a gap by term, and blocks."""
    blocks = codec.encoded_postings(_store(spark, d).postings)
    return blocks.groupBy(F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int").alias("bit_width")).agg(F.count("*").alias("blocks"), F.sum("count").alias("postings"))


def bounds_rounded_up(spark, d):
    """IB-09: stored bounds as 32-bit numbers, and how many would be below the true one."""
    up = F.pandas_udf(lambda s: s.map(codec.float_up), "double")
    rows = _store(spark, d).bounds.withColumn("_up", up("max_saturation"))
    return rows.agg(F.count("*").alias("bounds"), F.count_if(F.col("_up") < F.col("max_saturation")).alias("too_low"), F.count_if(F.col("_up") > F.col("max_saturation") * (1 + 1e-6)).alias("too_high"))


def _targets(spark):
    terms = sorted({t for own in SEARCHES.values() for t in own})
    return spark.createDataFrame([(t, n) for t in terms for n in (0, 17, 150, 399)], "term string, target bigint")


def posting_advance(spark, d):
    """IB-11: the first posting of a term at or after a document."""
    s = _store(spark, d)
    return codec.advance(s.postings, s.blocks, _targets(spark)).withColumn("max_saturation", F.round("max_saturation", 6))


def hit_positions(spark, d):
    """IB-12: positions of the query terms in the ten best documents, read for them only."""
    s = _store(spark, d)
    queries = ranking.query_table(spark, SEARCHES)
    hits = ranking.bm25_top_k(s.postings, s.docs, queries, dictionary=s.dictionary).select("query_id", "doc_id")
    return ranking.matching(s.postings, queries).join(F.broadcast(hits), ["query_id", "doc_id"]).select("query_id", "doc_id", "term", F.array_join("positions", ",").alias("positions"))


def front_coded_dictionary(spark, d):
    """IB-13: the dictionary through front coding and back."""
    return codec.dictionary_rows(materialise(codec.front_coded(_store(spark, d).dictionary), "front"))


def dictionary_lookup(spark, d):
    """IB-13: some terms looked up in the front-coded dictionary."""
    blocks = codec.front_coded(_store(spark, d).dictionary)
    return codec.lookup(blocks, _targets(spark).select("term").union(spark.createDataFrame([("no-such-term",)], "term string")))


def tombstone_codec(spark, d):
    """IB-15/16: deleted documents as a set of containers, and back."""
    docs = _store(spark, d).docs
    return codec.decoded_ids(codec.encoded_ids(docs.where("static_rank < 0.3").select("doc_id"), container=64), container=64)


def tombstone_density(spark, d):
    """IB-15: containers by the form that their density asks for."""
    docs = _store(spark, d).docs
    return codec.encoded_ids(docs.where("static_rank < 0.3 and doc_id % 7 = 0 or static_rank < 0.1").select("doc_id"), container=64).select("container", F.col("count").cast("bigint").alias("count"), "kind")


def forward_index(spark, d):
    """IO-12: the forward index of a segment: id, length and rank of every document in order."""
    return _store(spark, d).docs.select("doc_id", "external_id", "length", F.col("static_rank").cast("float").cast("double").alias("rank32"))


# --- fields ------------------------------------------------------------------------------------------


def field_sidecar(spark, d):
    """IO-13: what is kept beside a fielded segment: each document's field lengths, with the field's average and weight."""
    _, posts, lengths, averages = _fields(spark, d)
    specs = spark.createDataFrame([(f, w, b) for f, (w, b) in ranking.FIELD_SPECS.items()], "field string, weight double, b double")
    path = scratch_path(spark, "sidecar")
    lengths.join(F.broadcast(averages.select("field", "avg_length")), "field").join(F.broadcast(specs), "field", "left").write.parquet(path)
    return spark.read.parquet(path).select("external_id", "field", "field_length", F.round("avg_length", 6).alias("avg_length"), "weight", "b")


def field_lookup(spark, d):
    """IB-35: postings of a term in one field."""
    posts = _fields(spark, d)[1]
    return posts.where(F.col("field").isin("title", "body") & F.col("term").isin("fita", "lapri", "mel")).select("field", "term", "external_id", "tf")


def index_counts(spark, d):
    """IB-36: documents, living documents, length."""
    docs = _store(spark, d).docs
    alive = index.live(docs, _tombstones(docs))
    return attach(index.corpus_stats(docs), alive.agg(F.count("*").alias("live_count"))).select("doc_count", "live_count", F.round("avg_length", 6).alias("avg_length"), "total_length")


def _fields(spark, d):
    docs = index.fielded_records(read_table(spark, d, "fielded_documents"))
    posts = index.field_postings(docs)
    lengths = index.field_lengths(posts)
    return docs, posts, lengths, index.field_averages(lengths)


def _field_scores(spark, d, per_field=False):
    docs, posts, lengths, averages = _fields(spark, d)
    contributions = ranking.field_contributions(posts, lengths, averages, ranking.query_table(spark, FIELD_SEARCHES))
    return docs, ranking.bm25f_scores(contributions, posts, docs.agg(F.count("*").alias("_n")), per_field=per_field)


def field_averages(spark, d):
    return _fields(spark, d)[3].withColumn("avg_length", F.round("avg_length", 6))


def bm25f_topk(spark, d):
    return _out(ranking.best(_field_scores(spark, d)[1], 10, "external_id"), "external_id")


def bm25f_per_field_topk(spark, d):
    return _out(ranking.best(_field_scores(spark, d, True)[1], 10, "external_id"), "external_id")


def bm25f_static_prior(spark, d):
    docs, scores = _field_scores(spark, d)
    return _out(ranking.best(ranking.with_prior(scores, docs), 10, "external_id"), "external_id")


def bm25f_multiplicative_prior(spark, d):
    docs, scores = _field_scores(spark, d)
    return _out(ranking.best(ranking.multiplicative_prior(scores, docs), 10, "external_id"), "external_id")


def rrf_hybrid(spark, d):
    """Two rankings of the same queries fused: BM25F and the static rank of matching records."""
    docs, scores = _field_scores(spark, d)
    lexical = ranking.best(scores, 50, "external_id")
    prior = ranking.best(scores.select("query_id", "external_id").join(docs.select("external_id", F.col("static_rank").alias("score")), "external_id"), 50, "external_id")
    return _out(ranking.reciprocal_rank_fusion([lexical, prior], "external_id", 20), "external_id")


def dense_knn(spark, d):
    """Every vector whose id is divisible by 20 against all vectors."""
    vectors = read_table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return ranking.cosine_knn(vectors, queries, 10).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        dictionary_stats, docid_assignment, inverted_postings, posting_blocks, posting_range_bounds, posting_gaps, posting_codec, posting_codec_sizes, bounds_rounded_up, posting_advance, hit_positions, front_coded_dictionary, dictionary_lookup, tombstone_codec, tombstone_density, forward_index, field_sidecar, field_lookup, index_counts, front_coding, corpus_stats_merge, segment_merge, bm25_topk, bm25_pruned_topk,
        bm25_pruning_stats, bm25_multisegment_topk, bm25_with_tombstones, minimum_should_match, phrase_match, proximity_sdm, search_page, suggest_terms, tier_and_shard, tier_spill,
        ndcg_eval, grid_search, lever_gain, field_averages, bm25f_topk, bm25f_per_field_topk, bm25f_static_prior, bm25f_multiplicative_prior, rrf_hybrid, dense_knn,
    )
}

_FIELDS = f"""
docs as (
  select external_id, arg_min(fields, array_to_string(list_transform(map_entries(fields), lambda f: f.key || ':' || array_to_string(map_keys(f.value), ',')), ';')) as fields, coalesce(max(static_rank), 0) as static_rank, coalesce(max(quality), 0) as quality, coalesce(max(pagerank), 0) as pagerank
  from fielded_documents where external_id is not null group by 1),
posts as (
  select external_id, field, e.key as term, greatest(len(e.value), 1)::bigint as tf from (
    select external_id, f.key as field, unnest(map_entries(f.value)) as e from (select external_id, unnest(map_entries(fields)) as f from docs))),
lengths as (select external_id, field, sum(tf) as field_length from posts group by 1, 2),
averages as (select field, avg(field_length) as avg_length, count(*) as docs from lengths group by 1)
"""
_SPECS = ", ".join(f"('{f}', {w}, {b})" for f, (w, b) in ranking.FIELD_SPECS.items())


def _field_sql(per_field: bool) -> str:
    inner = "weight * (c * 2.2 / (c + 1.2))" if per_field else "weight * c"
    outer = "p" if per_field else "p * 2.2 / (p + 1.2)"
    return f"""{_FIELDS},
queries(query_id, term, qtf) as (values {_values(FIELD_SEARCHES)}),
specs(field, weight, b) as (values {_SPECS}),
contributions as (
  select query_id, qtf, external_id, term, weight::double as weight, tf / (1 - b::double + b::double * field_length / avg_length) as c
  from queries join posts using (term) join lengths using (external_id, field) join averages using (field) join specs using (field)),
pseudo as (select query_id, external_id, term, any_value(qtf) as qtf, sum({inner}) as p from contributions group by 1, 2, 3),
df as (select term, count(distinct external_id) as df from posts group by 1),
scored as (
  select query_id, external_id, sum(qtf * ln(1 + ((select count(*) from docs) - df + 0.5) / (df + 0.5)) * {outer}) as score
  from pseudo join df using (term) group by 1, 2)"""


_JUDGED = """
judged as (select query_id, doc_id, floor(static_rank * 4)::double as grade from scored join docs using (doc_id)),
ideal as (select query_id, sum(grade / log2(r + 1)) as ideal from (select query_id, grade, row_number() over (partition by query_id order by grade desc, doc_id) as r from judged) where r <= 10 group by 1)
"""
_GRID = f"""with {_DOCS}, {_SCORED}, {_JUDGED},
grid as (select a.k1::double as k1, c.b::double as b from (values (0.5), (0.9), (1.2), (1.5), (2.0)) a(k1), (values (0.3), (0.5), (0.75), (1.0)) c(b)),
gparts as (
  select k1, b, q.query_id, p.doc_id, q.qtf * ln(1 + (n - d.doc_freq + 0.5) / (d.doc_freq + 0.5)) * p.tf * (k1 + 1) / (p.tf + k1 * (1 - b + b * x.length / avg_length)) as part
  from queries q join posts p using (term) join dict d using (term) join docs x using (doc_id), stats, grid),
granked as (select *, row_number() over (partition by k1, b, query_id order by round(score, 9) desc, doc_id) as rank from (select k1, b, query_id, doc_id, sum(part) as score from gparts group by 1, 2, 3, 4)),
gndcg as (select k1, b, query_id, case when any_value(ideal) > 0 then sum(grade / log2(rank + 1)) / any_value(ideal) else 0 end as ndcg
  from granked join judged using (query_id, doc_id) join ideal using (query_id) where rank <= 10 group by 1, 2, 3),
mean as (select k1, b, avg(ndcg) as mean_ndcg, count(*) as queries from gndcg group by 1, 2)"""
_TOMBS = """
gone as (select external_id from docs where static_rank < 0.01 and not static_rank < 0.002)"""

_TARGETS = ", ".join(f"('{t}', {n})" for t in sorted({t for own in SEARCHES.values() for t in own}) for n in (0, 17, 150, 399))
_FIELD_POSTS = """docs as (select external_id, arg_min(fields, array_to_string(list_transform(map_entries(fields), lambda f: f.key || ':' || array_to_string(map_keys(f.value), ',')), ';')) as fields
  from fielded_documents where external_id is not null group by 1),
posts as (select external_id, field, e.key as term, greatest(coalesce(len(e.value), 1), 1)::bigint as tf from (select external_id, f.key as field, unnest(map_entries(f.value)) as e from (select external_id, unnest(map_entries(fields)) as f from docs)))"""
_SPEC_ROWS = ", ".join(f"('{f}', {w}, {b})" for f, (w, b) in ranking.FIELD_SPECS.items())

SQL: dict[str, str] = {
    "front_coding": f"""with {_DOCS}, r as (select term, (row_number() over (order by term) - 1) // 16 as block from dict),
b as (select term, block, coalesce(lag(term) over (partition by block order by term), '') as before from r),
c as (select term, block, len(list_filter(range(1, length(term) + 1), lambda i: substr(term, 1, i) = substr(before, 1, i) and i <= length(before))) as common from b)
select block::bigint as block, count(*)::bigint as terms, sum(length(term))::bigint as plain_chars, sum(length(term) - common)::bigint as coded_chars from c group by 1""",
    "posting_codec": f"with {_DOCS} select term, doc_id::bigint as doc_id, tf from posts",
    "posting_codec_sizes": f"""with {_DOCS}, placed as (
  select term, ((row_number() over w - 1) // 128) as block, doc_id - coalesce(lag(doc_id) over w, 0) as gap from posts window w as (partition by term order by doc_id)),
blocks as (select term, block, count(*) as n, max(gap) as g from placed group by 1, 2)
select (case when g = 0 then 0 else length(bin(g::bigint)) end)::int as bit_width, count(*)::bigint as blocks, sum(n)::bigint as postings from blocks group by 1""",
    "bounds_rounded_up": f"with {_DOCS} select count(*)::bigint as bounds, 0::bigint as too_low, 0::bigint as too_high from (select distinct term, doc_id // {index.RANGE_DOCS} from posts)",
    "posting_advance": f"""with {_DOCS}, targets(term, target) as (values {_TARGETS}),
placed as (select p.*, length, ((row_number() over (partition by term order by doc_id) - 1) // 128) as block from posts p join docs using (doc_id)),
blocks as (select term, block, max(doc_id) as last_doc, round(max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) as max_saturation from placed, stats group by 1, 2),
firsts as (select t.term, t.target, min(p.doc_id) as doc_id from targets t join posts p on p.term = t.term and p.doc_id >= t.target group by 1, 2)
select f.term, f.target::bigint as target, f.doc_id::bigint as doc_id, b.block::bigint as block, b.last_doc::bigint as last_doc, b.max_saturation from firsts f join placed p on p.term = f.term and p.doc_id = f.doc_id join blocks b on b.term = f.term and b.block = p.block""",
    "hit_positions": f"""with {_DOCS}, {_SCORED}, hits as (select query_id, doc_id from scored qualify row_number() over (partition by query_id order by round(score, 9) desc, doc_id) <= 10)
select h.query_id, h.doc_id::bigint as doc_id, p.term, array_to_string(p.positions, ',') as positions from hits h join queries q using (query_id) join posts p on p.term = q.term and p.doc_id = h.doc_id""",
    "front_coded_dictionary": f"with {_DOCS} select term, doc_freq::bigint as doc_freq, total_tf::bigint as total_tf from dict",
    "dictionary_lookup": f"with {_DOCS}, targets(term, target) as (values {_TARGETS}) select term, doc_freq::bigint as doc_freq, total_tf::bigint as total_tf from dict where term in (select term from targets)",
    "tombstone_codec": f"with {_DOCS} select doc_id::bigint as doc_id from docs where static_rank < 0.3",
    "tombstone_density": f"""with {_DOCS}, c as (select doc_id // 64 as container, count(*) as count from docs where static_rank < 0.3 and doc_id % 7 = 0 or static_rank < 0.1 group by 1)
select container::bigint as container, count::bigint as count, case when count >= 0.05 * 64 then 'dense' else 'sparse' end as kind from c""",
    "forward_index": f"with {_DOCS} select doc_id::bigint as doc_id, external_id, length, static_rank::float::double as rank32 from docs",
    "field_sidecar": f"""with {_FIELD_POSTS}, lengths as (select external_id, field, sum(tf)::bigint as field_length from posts group by 1, 2), specs(field, weight, b) as (values {_SPEC_ROWS})
select external_id, l.field, field_length, round(avg(field_length) over (partition by l.field), 6) as avg_length, weight::double as weight, b::double as b from lengths l left join specs using (field)""",
    "field_lookup": f"with {_FIELD_POSTS} select field, term, external_id, tf from posts where field in ('title', 'body') and term in ('fita', 'lapri', 'mel')",
    "index_counts": f"with {_DOCS} select count(*)::bigint as doc_count, count_if(not (static_rank < 0.01 and not static_rank < 0.002))::bigint as live_count, round(avg(length), 6) as avg_length, sum(length)::bigint as total_length from docs",
    "dictionary_stats": f"with {_DOCS} select term, doc_freq::bigint as doc_freq, total_tf::bigint as total_tf from dict",
    "docid_assignment": f"with {_DOCS} select doc_id::bigint as doc_id, external_id, static_rank, length from docs",
    "inverted_postings": f"with {_DOCS} select term, doc_id::bigint as doc_id, tf, array_to_string(positions, ',') as positions from posts",
    "posting_blocks": f"""with {_DOCS}, placed as (
  select p.*, length, ((row_number() over (partition by term order by doc_id) - 1) // 128) as block from posts p join docs using (doc_id))
select term, block::bigint as block, count(*)::bigint as docs, min(doc_id)::bigint as first_doc, max(doc_id)::bigint as last_doc,
       round(max(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 6) as max_saturation from placed, stats group by 1, 2""",
    "posting_gaps": f"""with {_DOCS}, placed as (
  select term, doc_id, ((row_number() over w - 1) // 128) as block, doc_id - coalesce(lag(doc_id) over w, 0) as gap from posts window w as (partition by term order by doc_id)),
blocks as (select term, block, count(*) as docs, max(gap) as max_gap from placed group by 1, 2)
select term, block::bigint as block, docs::bigint as docs, max_gap::bigint as max_gap, (case when max_gap = 0 then 0 else length(bin(max_gap::bigint)) end)::bigint as bit_width from blocks""",
    "corpus_stats_merge": f"with {_DOCS} select count(*)::bigint as doc_count, round(avg(length), 6) as avg_length from docs",
    "segment_merge": f"""with {_DOCS}, {_TOMBS}
select (row_number() over (order by static_rank desc, external_id) - 1)::bigint as doc_id, external_id, length from docs where external_id not in (select external_id from gone)""",
    "bm25_topk": f"with {_DOCS}, {_SCORED} {_top('scored')}",
    "posting_range_bounds": f"""with {_DOCS}
select term, (doc_id // {index.RANGE_DOCS})::bigint as range, count(*)::bigint as docs, round(max(p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * x.length / avg_length))), 6) as max_saturation
from posts p join docs x using (doc_id), stats group by 1, 2""",
    "bm25_pruning_stats": f"""with {_DOCS}, {_SCORED},
maxima as (select query_id, doc_id // {index.RANGE_DOCS} as range, term, max(part) as most, count(*) as docs from parts group by 1, 2, 3),
limits as (select query_id, range, sum(most) as bound, max(docs) as docs from maxima group by 1, 2),
placed as (select *, row_number() over w as place, coalesce(sum(docs) over (partition by query_id order by bound desc, range rows between unbounded preceding and 1 preceding), 0) as ahead
           from limits window w as (partition by query_id order by bound desc, range)),
heads as (select query_id, range from placed where place <= 10 and ahead < 10),
firsts as (select s.query_id, s.score, row_number() over (partition by s.query_id order by round(s.score, 9) desc, s.doc_id) as place from scored s join heads h on h.query_id = s.query_id and h.range = s.doc_id // {index.RANGE_DOCS}),
theta as (select query_id, case when count(*) >= 10 then min(score) else 0 end as theta from firsts where place <= 10 group by 1),
kept as (select l.* from limits l join theta using (query_id) where bound >= theta - 1e-9),
a as (select query_id, count(*) as ranges_all, sum(docs) as docs_all from limits group by 1),
r as (select query_id, count(*) as ranges_read, sum(docs) as docs_read from kept group by 1),
n as (select s.query_id, count(*) as scored_docs from scored s join kept k on k.query_id = s.query_id and k.range = s.doc_id // {index.RANGE_DOCS} group by 1)
select query_id, ranges_all::bigint as ranges_all, docs_all::bigint as docs_all, ranges_read::bigint as ranges_read, docs_read::bigint as docs_read, scored_docs::bigint as scored_docs,
  round(1.0 - ranges_read / ranges_all, 6) as skip_ratio from a join r using (query_id) join n using (query_id)""",
    "bm25_pruned_topk": f"with {_DOCS}, {_SCORED} {_top('scored')}",
    "bm25_multisegment_topk": f"""with {_DOCS},
queries(query_id, term, qtf) as (values {_values(SEARCHES)}),
placed as (select p.*, length, case when substr(external_id, 3, 1) < '8' then 0 else 1 end as segment from posts p join docs using (doc_id)),
sdf as (select segment, term, count(*) as df from placed group by 1, 2),
scored as (
  select query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))) as score
  from queries join placed using (term) join sdf using (segment, term), stats group by 1, 2)
{_top("scored")}""",
    "bm25_with_tombstones": f"with {_DOCS}, {_SCORED}, {_TOMBS}, alive as (select * from scored where doc_id not in (select doc_id from docs join gone using (external_id))) {_top('alive')}",
    "minimum_should_match": f"with {_DOCS}, {_SCORED} select query_id, doc_id::bigint as doc_id, count(distinct term)::bigint as matched from parts group by 1, 2 having count(distinct term) >= 2",
    "phrase_match": f"""with {_DOCS}, pairs as (
  select a.doc_id, len(list_filter(flatten(list_transform(a.positions, lambda x: list_transform(b.positions, lambda y: y - x))), lambda z: z > 0 and z <= 3))::bigint as matches
  from posts a join posts b using (doc_id) where a.term = 'tor' and b.term = 'zel')
select doc_id::bigint as doc_id, matches from pairs where matches > 0""",
    "proximity_sdm": f"""with {_DOCS}, pairs as (
  select a.doc_id, len(a.positions) + len(b.positions) as unigrams, flatten(list_transform(a.positions, lambda x: list_transform(b.positions, lambda y: y - x))) as gaps
  from posts a join posts b using (doc_id) where a.term = 'tor' and b.term = 'zel'),
counted as (select doc_id, unigrams, len(list_filter(gaps, lambda z: z = 1)) as ordered, len(list_filter(gaps, lambda z: abs(z) < 8)) as unordered from pairs)
select doc_id::bigint as doc_id, unigrams::bigint as unigrams, ordered::bigint as ordered, unordered::bigint as unordered,
       round(0.85::double * ln(1 + unigrams) + 0.10::double * ln(1 + ordered) + 0.05::double * ln(1 + unordered), 6) as score from counted""",
    "search_page": f"with {_DOCS}, {_SCORED} select * from ({_top('scored', 30)}) where rank > 10",
    "suggest_terms": f"""with {_DOCS} select prefix, term, doc_freq::bigint as doc_freq, rank::bigint as rank from (
  select substr(term, 1, 2) as prefix, term, doc_freq, row_number() over (partition by substr(term, 1, 2) order by doc_freq desc, term) as rank from dict where length(term) >= 2) where rank <= 5""",
    "tier_and_shard": f"""with {_DOCS} select (case when static_rank >= 0.5 then 0 when static_rank >= 0.05 and length >= 50 then 1 else 2 end)::int as tier,
  (('0x' || substr(md5(external_id), 1, 8))::ubigint % 16)::bigint as shard, count(*)::bigint as docs, sum(length)::bigint as tokens from docs group by 1, 2""",
    "tier_spill": f"""with {_DOCS}, {_SCORED}, placed as (select query_id, doc_id, score, static_rank < 0.9 as low from scored join docs using (doc_id)),
enough as (select query_id from placed where not low group by 1 having count(*) >= 20),
kept as (select query_id, doc_id, score from placed where not low or query_id not in (select query_id from enough)) {_top("kept")}""",
    "ndcg_eval": f"""with {_DOCS}, {_SCORED}, {_JUDGED}, ranked as ({_top("scored")})
select i.query_id, round(case when i.ideal > 0 then coalesce(sum(grade / log2(rank + 1)), 0) / i.ideal else 0 end, 6) as ndcg
from ideal i left join ranked r using (query_id) left join judged j on j.query_id = r.query_id and j.doc_id = r.doc_id group by i.query_id, i.ideal""",
    "grid_search": f"{_GRID} select k1, b, round(mean_ndcg, 6) as mean_ndcg, queries::bigint as queries from mean",
    "lever_gain": f"{_GRID} select round(max(round(mean_ndcg, 6)), 6) as best, round(min(round(mean_ndcg, 6)), 6) as worst, round(max(round(mean_ndcg, 6)) - min(round(mean_ndcg, 6)), 6) as gain from mean",
    "field_averages": f"with {_FIELDS} select field, round(avg_length, 6) as avg_length, docs::bigint as docs from averages",
    "bm25f_topk": f"with {_field_sql(False)} {_top('scored', key='external_id')}",
    "bm25f_per_field_topk": f"with {_field_sql(True)} {_top('scored', key='external_id')}",
    "bm25f_static_prior": f"""with {_field_sql(False)}, prior as (
  select query_id, external_id, score + ln(1 + greatest(pagerank, 0)) + 0.5::double * greatest(quality, 0) as score from scored join docs using (external_id)) {_top("prior", key="external_id")}""",
    "bm25f_multiplicative_prior": f"""with {_field_sql(False)}, prior as (
  select query_id, external_id, score * (1 + ln(1 + greatest(pagerank, 0))) as score from scored join docs using (external_id)) {_top("prior", key="external_id")}""",
    "rrf_hybrid": f"""with {_field_sql(False)},
a as (select query_id, external_id, row_number() over (partition by query_id order by round(score, 9) desc, external_id) as rank from scored),
b as (select query_id, external_id, row_number() over (partition by query_id order by round(static_rank, 9) desc, external_id) as rank from scored join docs using (external_id)),
fused as (select query_id, external_id, sum(1.0::double / (60 + rank)) as score from (select * from a where rank <= 50 union all select * from b where rank <= 50) group by 1, 2) {_top("fused", 20, "external_id")}""",
    "dense_knn": """with norms as (select vec_id, embedding::double[] as v, sqrt(list_dot_product(embedding::double[], embedding::double[])) as norm from embeddings),
pairs as (select q.vec_id as query_id, x.vec_id, round(list_dot_product(q.v, x.v) / (q.norm * x.norm), 9) as similarity from norms q, norms x where q.vec_id % 20 = 0 and q.vec_id <> x.vec_id)
select query_id, vec_id, round(similarity, 6) as similarity, rank::bigint as rank from (
  select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from pairs) where rank <= 10""",
}
