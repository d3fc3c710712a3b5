"""Queries of conditional searches over documents, fields and embeddings, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..operators import crawl, graph, monitor, ranking, retrieval
from ..session import REMEMBERED, materialise, read_table
from . import crawling as c
from . import search as s
from .content import BYTES

Query = Callable[[SparkSession, str], DataFrame]

TEXT_SEARCHES = {"t1": ["library", "museum"], "t2": ["the", "harbour", "walk"], "t3": ["bibliothek", "garten"], "t4": ["recipe", "recipe", "no-such-word"]}
#: query, site suffix of the domains, lang, since, safe only
FILTERS = [("t1", None, "en", None, False), ("t2", None, "en", "2026-01-10 00:00:00", False), ("t3", None, "de", None, True), ("t4", None, None, "2026-01-05 00:00:00", True)]
CLAUSES = [("b1", "fita", "must", 0), ("b1", "lapri", "should", 0), ("b1", "zafen", "must_not", 0), ("b2", "mel", "should", 2), ("b2", "gadra", "should", 2), ("b2", "tor", "should", 2), ("b3", "zafen", "filter", 1), ("b3", "kelri", "should", 1)]
SNIPPET_TERMS = ["museum", "library", "recipe"]
DENSE_QUERIES = {"t1": 0, "t2": 20, "t3": 40, "t4": 60}

_POSTINGS: dict[tuple, DataFrame] = {}
REMEMBERED.append(_POSTINGS)


def _documents(spark, d):
    words = text.simple_words(F.col("text"))
    docs = read_table(spark, d, "documents").where("doc_id is not null and text is not null")
    return docs.select("doc_id", F.col("domain").alias("site"), "lang", F.col("fetched_at").alias("at"), (F.col("source") != "forum").alias("safe"), F.size(words).cast("bigint").alias("length"))


def _postings(spark, d):
    """Postings of the documents: written once an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _POSTINGS:
        made = retrieval.text_postings(read_table(spark, d, "documents"))
        _POSTINGS[key] = materialise(made.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), "text-postings")
    return _POSTINGS[key]


def _filters(spark):
    rows = spark.createDataFrame(FILTERS, "query_id string, site string, lang string, since string, safe_only boolean")
    return rows.withColumn("since", F.col("since").cast("timestamp_ntz"))


def filtered_search(spark, d):
    """RK-38/IB-31: searches with language, date and safety filters."""
    return s._out(retrieval.filtered_top_k(_postings(spark, d), _documents(spark, d), ranking.query_table(spark, TEXT_SEARCHES), _filters(spark)))


def rare_terms_required(spark, d):
    """TX-26."""
    parts = retrieval.weighted(_postings(spark, d), ranking.query_table(spark, TEXT_SEARCHES), _documents(spark, d))
    return s._out(ranking.best(retrieval.rare_required(parts), 10))


def _boolean(spark, d, cross):
    posts = s._fields(spark, d)[1]
    return retrieval.boolean_matches(posts, spark.createDataFrame(CLAUSES, "query_id string, term string, clause string, least int"), cross_fields=cross)


def boolean_search(spark, d):
    """RK-26, terms of a query in any fields."""
    return _boolean(spark, d, True)


def boolean_search_one_field(spark, d):
    """RK-26, all terms in one field."""
    return _boolean(spark, d, False)


def phrase_of_three(spark, d):
    """RK-25."""
    return retrieval.phrases(_postings(spark, d), ["the", "town", "library"], slop=1)


def dependence_of_three(spark, d):
    """RK-24."""
    return retrieval.dependence(_postings(spark, d), ["the", "town", "library"]).withColumn("score", F.round("score", 6))


def head_bigrams(spark, d):
    """IB-31: the pairs that a phrase index holds (a report of the 50 most frequent)."""
    return retrieval.head_bigrams(read_table(spark, d, "documents"), 50)


def ranked_snippets(spark, d):
    """RK-34."""
    docs = read_table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", retrieval.ranked_snippet(F.col("text"), SNIPPET_TERMS).alias("_s")).where("_s.score > 0").select("doc_id", "_s.sentence", "_s.score")


def hybrid_dense(spark, d):
    """RK-31: lexical and dense lists of the same queries fused; a vector belongs to the document of its number."""
    lexical = ranking.best(retrieval.weighted(_postings(spark, d), ranking.query_table(spark, TEXT_SEARCHES), _documents(spark, d)).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score")), 50)
    e = read_table(spark, d, "embeddings")
    wanted = e.where(F.col("vec_id").isin(*DENSE_QUERIES.values())).select(F.col("vec_id").alias("query_id"), "embedding")
    near = ranking.cosine_knn(e.select("vec_id", "embedding"), wanted, 50)
    names = F.create_map(*[x for q, v in DENSE_QUERIES.items() for x in (F.lit(v).cast("bigint"), F.lit(q))])
    dense = near.select(names[F.col("query_id")].alias("query_id"), F.col("vec_id").alias("doc_id"), "rank")
    return s._out(ranking.reciprocal_rank_fusion([lexical.select("query_id", "doc_id", "rank"), dense], "doc_id", 20))


def tier_holdback(spark, d):
    """RK-29: events whose query goes to all tiers (here a tenth)."""
    rows = read_table(spark, d, "events").select(F.col("user_id").cast("string").alias("q")).where("q is not null")
    return rows.groupBy(retrieval.holdback(F.col("q"), 0.1).alias("held")).agg(F.count("*").alias("queries"), F.count_distinct("q").alias("users"))


def freshness_demand(spark, d):
    """RK-41."""
    rows = read_table(spark, d, "events").select("event_type", F.floor(monitor.micros(F.col("ts")) / 86_400_000_000).cast("bigint").alias("day"))
    return retrieval.freshness_demand(rows, "event_type", "day").withColumn("demand", F.round("demand", 6))


def _attributes(spark, d):
    """The lang attribute of every body: it is ascii, so one byte a character reads it in any charset that holds ascii."""
    f = read_table(spark, d, "fetch_results").where("body is not null")
    return f.select("fetch_id", html.lang_attribute(F.decode("body", "ISO-8859-1")).alias("attribute"))


def language_cascade(spark, d):
    """HT-25: the label of the analysis (sure where its script is known), else the page's attribute."""
    a = read_table(spark, d, "analyzed_texts").join(_attributes(spark, d), "fetch_id", "left")
    model = F.nullif(F.lower(F.split_part(F.regexp_replace("language", "_", "-"), F.lit("-"), F.lit(1))), F.lit("und"))
    confidence = F.when(F.col("script").isNotNull(), 0.9).otherwise(0.4)
    return a.select("fetch_id", retrieval.choose_language(F.coalesce("length", F.lit(0)), F.col("attribute"), F.nullif(model, F.lit("")), confidence).alias("_l")).select("fetch_id", "_l.*")


def tier_by_signals(spark, d):
    """IB-25."""
    f = read_table(spark, d, "fielded_documents").where("external_id is not null").groupBy("external_id").agg(*[F.max(x).alias(x) for x in ("static_rank", "quality", "pagerank")])
    age = F.pmod(F.conv(F.substring(F.md5("external_id"), 1, 4), 16, 10).cast("bigint"), F.lit(400)).cast("double")
    return f.groupBy(retrieval.tier_of(F.col("static_rank"), F.col("quality"), F.col("pagerank") * 100, age).alias("tier")).agg(F.count("*").alias("records"))


def trust_ratio(spark, d):
    """RK-22: rank by trust of every node that has trust."""
    edges = c._word_edges(spark, d)
    trusted = graph.nodes_of(edges).where("node like 'www.%'")
    rows = graph.trust_ratio(graph.pagerank(edges, 10), graph.pagerank(edges, 10, seeds=trusted))
    return rows.select("node", F.round("rank", 9).alias("rank"), F.round("trust", 9).alias("trust"), F.round("ratio", 4).alias("ratio"))


def salsa(spark, d):
    """RK-23."""
    return graph.salsa(c._word_edges(spark, d)).withColumn("authority", F.round("authority", 9))


def warm_ranks(spark, d):
    """RK-21: three more rounds from ranks that are there."""
    edges = c._word_edges(spark, d)
    return graph.pagerank(edges, 3, start=graph.pagerank(edges, 7)).select("node", F.round("rank", 9).alias("rank"))


def parse_verdicts(spark, d):
    """HT-02/32/35: what becomes of every fetch in the parser."""
    f = read_table(spark, d, "fetch_results")
    verdict = html.parse_verdict(F.col("url"), crawl.header(F.col("headers"), "content-type"), F.col("body"), 20_000)
    return f.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("fetches"))


def indexable_pages(spark, d):
    """HT-33, CR-46: pages that neither their header nor their robots directives take out of the index, by one byte a character."""
    f = read_table(spark, d, "fetch_results").where("body is not null")
    meta = F.lower(F.regexp_extract(F.decode("body", "ISO-8859-1"), r"(?is)<meta[^>]*name\s*=\s*[\"']?robots[\"']?[^>]*content\s*=\s*[\"']([^\"']*)[\"']", 1))
    listed = F.transform(F.split(meta, ","), lambda x: F.trim(x))
    flag = html.is_indexable(F.transform(listed, lambda x: F.when(x == "none", "noindex").otherwise(x)), crawl.header(F.col("headers"), "x-robots-tag"))
    return f.groupBy(flag.alias("indexable")).agg(F.count("*").alias("pages"))


def same_site_redirects(spark, d):
    """URL-06/07: redirects that stay on their site."""
    f = read_table(spark, d, "fetch_results").where("redirect_target is not null and url is not null")
    site = lambda col: urls.domain_of_host(urls.url_host(F.col(col)))
    return f.groupBy((site("url") == site("redirect_target")).alias("same_site")).agg(F.count("*").alias("redirects"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        filtered_search, rare_terms_required, boolean_search, boolean_search_one_field, phrase_of_three, dependence_of_three, head_bigrams, ranked_snippets, hybrid_dense, tier_holdback,
        freshness_demand, language_cascade, tier_by_signals, trust_ratio, salsa, warm_ranks, parse_verdicts, indexable_pages, same_site_redirects,
    )
}

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+(?:[''’]\\p{L}+)*')"
_DOCS = f"""docs as (select doc_id, domain as site, lang, fetched_at as at_time, source <> 'forum' as safe, {_WORDS} as w, len({_WORDS}) as length, text from documents where doc_id is not null and text is not null),
posts as (select doc_id, term, length, count(*) as tf, list_sort(list(pos)) as positions from (select doc_id, length, unnest(w) as term, unnest(range(0, len(w))) as pos from docs) group by 1, 2, 3),
stats as (select count(*)::double as n, avg(length) as avg_length from docs)"""
_PARTS = f"""queries(query_id, term, qtf) as (values {s._values(TEXT_SEARCHES)}),
df as (select term, count(*) as df from posts group by 1),
parts as (select q.query_id, p.doc_id, q.term, df / n as df_share, q.qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.length / avg_length)) as part
  from queries q join posts p using (term) join df using (term), stats)"""


def _lit(x) -> str:
    return "null" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'"


_FILTER_ROWS = ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in FILTERS)
_CLAUSE_ROWS = ", ".join(f"('{q}', '{t}', '{k}', {n})" for q, t, k, n in CLAUSES)


def _boolean_sql(cross: bool) -> str:
    where = "query_id, external_id" if cross else "query_id, external_id, field"
    return f"""with docs as (select external_id, arg_min(fields, array_to_string(list_transform(map_entries(fields), lambda f: f.key || ':' || array_to_string(map_keys(f.value), ',')), ';')) as fields
  from fielded_documents where external_id is not null group by 1),
posts as (select external_id, f.key as field, unnest(map_keys(f.value)) as term from (select external_id, unnest(map_entries(fields)) as f from docs)),
clauses(query_id, term, clause, least) as (values {_CLAUSE_ROWS}),
own as (select * from posts join clauses using (term)),
per as (select {where}, count_if(clause in ('must', 'filter')) as m, count_if(clause = 'should') as sh, count_if(clause = 'must') as cm, max(least) as least from (select distinct {where}, term, clause, least from own) group by {where}),
need as (select query_id, count_if(clause in ('must', 'filter')) as need from clauses group by 1)
select query_id, external_id, max(cm + sh)::bigint as matched from per join need using (query_id) where m = need and sh >= least
  and (query_id, external_id) not in (select (query_id, external_id) from own where clause = 'must_not') group by 1, 2"""


_THREE = """p as (select doc_id, max(case when term = 'the' then positions end) as a, max(case when term = 'town' then positions end) as b, max(case when term = 'library' then positions end) as c
  from posts where term in ('the', 'town', 'library') group by 1 having count(*) = 3)"""

SQL: dict[str, str] = {
    "filtered_search": f"""with {_DOCS}, {_PARTS}, filters(query_id, site, lang, since, safe_only) as (values {_FILTER_ROWS}),
ok as (select f.query_id, d.doc_id from docs d join filters f on (f.site is null or f.site = d.site) and (f.lang is null or f.lang = d.lang) and (f.since is null or d.at_time >= f.since::timestamp) and (not f.safe_only or coalesce(d.safe, true))),
scored as (select query_id, doc_id, sum(part) as score from parts where (query_id, doc_id) in (select (query_id, doc_id) from ok) group by 1, 2) {s._top("scored")}""",
    "rare_terms_required": f"""with {_DOCS}, {_PARTS}, need as (select query_id, count(distinct term) as need from parts where df_share <= 0.1 group by 1),
per as (select query_id, doc_id, sum(part) as score, count_if(df_share <= 0.1) as have from parts group by 1, 2),
scored as (select query_id, doc_id, score from per left join need using (query_id) where have = coalesce(need, 0)) {s._top("scored")}""",
    "boolean_search": _boolean_sql(True),
    "boolean_search_one_field": _boolean_sql(False),
    "phrase_of_three": f"""with {_DOCS}, {_THREE}
select doc_id, matches from (select doc_id, len(flatten(list_transform(flatten(list_transform(a, lambda x: list_filter(b, lambda y: y > x and y <= x + 2))), lambda y: list_filter(c, lambda z: z > y and z <= y + 2))))::bigint as matches from p) where matches > 0""",
    "dependence_of_three": f"""with {_DOCS}, {_THREE}, n as (select doc_id, (len(a) + len(b) + len(c))::bigint as unigrams,
  (len(list_filter(flatten(list_transform(a, lambda x: list_transform(b, lambda y: y - x))), lambda v: v = 1)) + len(list_filter(flatten(list_transform(b, lambda x: list_transform(c, lambda y: y - x))), lambda v: v = 1)))::bigint as ordered,
  (len(list_filter(flatten(list_transform(a, lambda x: list_transform(b, lambda y: y - x))), lambda v: abs(v) < 8)) + len(list_filter(flatten(list_transform(b, lambda x: list_transform(c, lambda y: y - x))), lambda v: abs(v) < 8)))::bigint as unordered from p)
select *, round(0.85 * ln(1 + unigrams) + 0.10 * ln(1 + ordered) + 0.05 * ln(1 + unordered), 6) as score from n""",
    "head_bigrams": f"""with d as (select {_WORDS} as w from documents where text is not null),
p as (select unnest(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as pair from d where len(w) > 1)
select pair, count(*)::bigint as documents from p group by 1 order by 2 desc, 1 limit 50""",
    "ranked_snippets": f"""with sentences as (select doc_id, unnest(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0)) as s,
  unnest(range(0, len(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0)))) as i from documents where text is not null),
w as (select doc_id, s, i, {_WORDS.replace("text", "s")} as w from sentences),
p as (select doc_id, s, i, list_filter([{", ".join(f"list_position(w, '{t}')" for t in SNIPPET_TERMS)}], lambda x: x > 0) as p from w),
r as (select doc_id, s, i, case when len(p) > 0 then round(len(p) / {float(len(SNIPPET_TERMS))}::double * (len(p) / (list_max(p) - list_min(p) + 1)) / (1 + ln(1 + i)), 9) else 0 end as score from p),
best as (select *, row_number() over (partition by doc_id order by score desc, i) as n from r)
select doc_id, substr(s, 1, 160) as sentence, score from best where n = 1 and score > 0""",
    "hybrid_dense": f"""with {_DOCS}, {_PARTS}, scored as (select query_id, doc_id, sum(part) as score from parts group by 1, 2),
lexical as (select query_id, doc_id, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from scored qualify rank <= 50),
wanted(query_id, vec_id) as (values {", ".join(f"('{q}', {v})" for q, v in DENSE_QUERIES.items())}),
sims as (select w.query_id, v.vec_id as doc_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 9) as sim from wanted w join embeddings q using (vec_id), embeddings v where v.vec_id <> w.vec_id),
dense as (select query_id, doc_id, row_number() over (partition by query_id order by sim desc, doc_id) as rank from sims qualify rank <= 50),
fused as (select query_id, doc_id, sum(1.0::double / (60 + rank)) as score from (select * from lexical union all select * from dense) group by 1, 2) {s._top("fused", 20)}""",
    "tier_holdback": """select ('0x' || substr(md5(user_id::varchar), 1, 8))::ubigint % 1000000 < 100000 as held, count(*)::bigint as queries, count(distinct user_id)::bigint as users from events where user_id is not null group by 1""",
    "freshness_demand": """with e as (select event_type, (epoch_us(ts) // 86400000000)::bigint as day from events), l as (select max(day) as last, min(day) as first from e),
n as (select event_type, count_if(day > last - 7) as recent, count_if(day <= last - 7) as before, any_value(last) as last, any_value(first) as first from e, l where event_type is not null group by 1)
select event_type, recent::bigint as recent, before::bigint as before, round((recent / 7.0::double + 0.1) / (before / greatest(last - 7 - first + 1, 1)::double + 0.1), 6) as demand from n""",
    "language_cascade": r"""with p as (select fetch_id, nullif(lower(regexp_extract(BYTES, '(?i)<html[^>]*\slang\s*=\s*["'']?([a-zA-Z]{2,3})(?:[-_][^"''>\s]*)?["''\s>]', 1)), '') as attribute from fetch_results where body is not null),
a as (select t.fetch_id, coalesce(t.length, 0) as length, attribute, nullif(nullif(lower(split_part(replace(language, '_', '-'), '-', 1)), 'und'), '') as model, case when script is not null then 0.9 else 0.4 end as confidence
  from analyzed_texts t left join p using (fetch_id)),
j as (select *, length >= 40 and model is not null and confidence >= 0.55 as sure, coalesce(attribute, '') <> '' as known from a)
select fetch_id, case when sure then model when known then attribute else 'und' end as language, case when sure then confidence when known then 0.25 else 0 end::double as confidence,
  case when sure then 'model' when known then 'attribute' else 'none' end as source, sure and known and attribute <> model as disagreed from j""",
    "tier_by_signals": """with f as (select external_id, max(static_rank) as r, max(quality) as q, max(pagerank) as p from fielded_documents where external_id is not null group by 1),
s as (select 0.5 * coalesce(r, 0) + 0.2 * coalesce(q, 0) + 0.2 * least(ln(1 + coalesce(p * 100, 0)) / 5, 1.0) + 0.1 * pow(0.5, (('0x' || substr(md5(external_id), 1, 4))::ubigint % 400) / 30.0::double) as score from f)
select case when score >= 0.5 then 0 when score >= 0.2 then 1 else 2 end as tier, count(*)::bigint as records from s group by 1""",
    "trust_ratio": f"""with a as ({c._rank_sql(None)} select node, rank from r10), b as ({c._rank_sql("node like 'www.%'")} select node, rank as trust from r10)
select node, round(rank, 9) as rank, round(trust, 9) as trust, round(case when trust > 0 then rank / trust end, 4) as ratio from a join b using (node)""",
    "salsa": f"""with recursive {c._EDGES}, sides as (select 'h:' || src as x, 'a:' || dst as y from edges), ways as (select x, y from sides union select y, x from sides),
walk as (select distinct x as node, x as label from ways union select b.y, w.label from walk w join ways b on b.x = w.node where w.label < b.y),
parts as (select node, min(label) as component from walk group by 1),
own as (select 'a:' || dst as node, count(*) as indeg from edges group by 1), j as (select node, indeg, component from own join parts using (node)),
t as (select component, sum(indeg) as e, count(*) as n from j group by 1)
select substr(node, 3) as node, round(indeg / e * n / (select count(*) from j), 9) as authority from j join t using (component)""",
    "warm_ranks": c.SQL["pagerank"],
    "parse_verdicts": """with f as (select url, body, lower(coalesce(list_extract(list_filter(map_entries(headers), lambda e: lower(e.key) = 'content-type'), 1).value, 'html')) as kind from fetch_results)
select case when url is null then 'no_url' when body is null then 'no_body' when octet_length(body) = 0 then 'empty' when not contains(kind, 'html') then 'not_html' when octet_length(body) > 20000 then 'over_size' else 'ok' end as verdict,
  count(*)::bigint as fetches from f group by 1""",
    "indexable_pages": r"""with f as (select lower(regexp_extract(BYTES, '(?is)<meta[^>]*name\s*=\s*["'']?robots["'']?[^>]*content\s*=\s*["'']([^"'']*)["'']', 1)) as meta,
  lower(coalesce(list_extract(list_filter(map_entries(headers), lambda e: lower(e.key) = 'x-robots-tag'), 1).value, '')) as head from fetch_results where body is not null)
select len(list_filter(list_transform(string_split(meta, ',') , lambda x: trim(x)), lambda x: x in ('noindex', 'none'))) = 0
  and len(list_filter(list_transform(string_split(replace(head, ';', ','), ','), lambda x: trim(x)), lambda x: x in ('noindex', 'none'))) = 0 as indexable, count(*)::bigint as pages from f group by 1""",
    "same_site_redirects": f"""select {c._domain(c._host("url"))} = {c._domain(c._host("redirect_target"))} as same_site, count(*)::bigint as redirects from fetch_results where redirect_target is not null and url is not null group by 1""",
}
for _name in ("language_cascade", "indexable_pages"):
    SQL[_name] = SQL[_name].replace("BYTES", BYTES)
