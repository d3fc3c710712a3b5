"""Page and text queries over fetch_results and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..operators import crawl, index, ranks
from ..session import attach, read_table, spread

Query = Callable[[SparkSession, str], DataFrame]

#: A term in this share of the records at most, or in one, is rare.
RARE_SHARE = 0.0001


def _fetches(spark, d):
    f = read_table(spark, d, "fetch_results")
    return f.select("fetch_id", "url", F.lower(crawl.header(F.col("headers"), "content-type")).alias("content_type"), "body")


def _valid(spark, d):
    """Pages whose bytes are valid UTF-8, as text: what both engines read alike."""
    return _fetches(spark, d).where("is_valid_utf8(cast(body as string))").withColumn("html", F.expr("cast(body as string)"))


def _decoded(spark, d):
    """Every body as text, in the project's order of charsets; broken bytes become U+FFFD."""
    from ..functions.charset import decode

    def run(batches):
        for pdf in batches:
            yield pdf[["fetch_id", "url"]].assign(html=[decode(bytes(b), k)[0] for b, k in zip(pdf["body"], pdf["content_type"])])

    rows = _fetches(spark, d).where("body is not null")
    return spread(rows).mapInPandas(run, f"fetch_id {dict(rows.dtypes)['fetch_id']}, url string, html string")


def _parsed(spark, d):
    return html.parsed_pages(_fetches(spark, d))


def _titles(pages):
    return pages.select("fetch_id", html.title_of(F.col("html")).alias("title"))


def _langs(pages):
    return pages.groupBy(html.lang_attribute(F.col("html")).alias("lang")).agg(F.count("*").alias("pages"))


def _decisions(pages):
    pages = pages.where("html like '%<body%'")
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    weight = F.aggregate(scripts, F.lit(0).cast("bigint"), lambda a, s: a + F.octet_length(s)) + 8192 * F.regexp_count("html", F.lit(r"(?i)<script[^>]*\ssrc="))
    visible = F.length(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "), r"<[^>]*>", " "), r"\s+", " ")))
    audit = html.audit_sample(F.col("url"), F.lit("2026-01-31"), 0.01)
    return pages.select("fetch_id", weight.cast("bigint").alias("script_weight"), visible.cast("bigint").alias("visible_chars"), html.render_decision(visible, weight, html.framework_marker(F.col("html")), audit).alias("decision"))


def page_titles(spark, d):
    return _titles(_valid(spark, d))


def page_titles_full(spark, d):
    """HT-12 of pages in any charset, as no SQL can."""
    return _titles(_decoded(spark, d))


def lang_attributes(spark, d):
    return _langs(_valid(spark, d))


def lang_attributes_full(spark, d):
    """HT-15 of pages in any charset."""
    return _langs(_decoded(spark, d))


def render_decisions(spark, d):
    """HT-27..30 by columns: script weight, framework marker, visible text, audit sample."""
    return _decisions(_valid(spark, d))


def render_decisions_full(spark, d):
    """HT-27..30 of pages in any charset."""
    return _decisions(_decoded(spark, d))


def charset_sources(spark, d):
    """HT-03: encoding and where it was found, of every html page."""
    from ..functions.charset import detect

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = [detect(bytes(b), k) for b, k in zip(pdf["body"], pdf["content_type"])]
            yield pd.DataFrame(found, columns=["encoding", "source"])

    pages = _fetches(spark, d).where("body is not null and coalesce(content_type, 'html') like '%html%'")
    return spread(pages.select("body", "content_type")).mapInPandas(run, "encoding string, source string").groupBy("encoding", "source").agg(F.count("*").alias("pages"))


def page_fields(spark, d):
    return _parsed(spark, d).select("fetch_id", "title", F.size("headings").alias("headings"), "meta_description", "canonical_url", "lang", F.array_join("robots_meta", ",").alias("robots_meta"), "published", "script_weight", F.size("blocks").alias("blocks"), F.size("links").alias("links"), "warning")


def page_links(spark, d):
    """HT-19: edges of the link graph with anchors."""
    return _parsed(spark, d).select("fetch_id", "url", F.explode("links").alias("_l")).select("fetch_id", "url", "_l.*")


def discovered_urls(spark, d):
    """HT-23/24: distinct targets, and how many pages pass authority to them."""
    return page_links(spark, d).groupBy("target_url").agg(F.count_distinct("url").alias("pages"), F.count_if(F.col("rel") == "follow").alias("follow_links"), F.count_if("in_main_content").alias("main_links"))


def _blocks(spark, d):
    return _parsed(spark, d).select("fetch_id", urls.url_host(F.col("url")).alias("host"), F.posexplode("blocks").alias("block_no", "_b")).select("fetch_id", "host", "block_no", "_b.*")


def block_classes(spark, d):
    rows = html.classify_blocks(_blocks(spark, d).where("not chrome"))
    return rows.groupBy("reason", "is_content").agg(F.count("*").alias("blocks"), F.sum("num_words").alias("words"))


def template_texts(spark, d):
    return html.template_texts(_blocks(spark, d).where("host is not null")).select("host", "text", "pages")


def extracted_text(spark, d):
    """HT-11: kept text by page; where little is kept of much, blocks of a dozen words and few links instead."""
    blocks = _blocks(spark, d)
    chars = blocks.groupBy("fetch_id").agg(F.sum(F.length("text")).alias("visible"))
    rows = html.classify_blocks(blocks.where("not chrome")).select("fetch_id", "block_no", "is_content").join(blocks, ["fetch_id", "block_no"], "right")
    kept, fallback = F.coalesce(F.col("is_content"), F.lit(False)), (F.col("num_words") >= 12) & (F.col("link_words") <= html.DENSITY * F.col("num_words"))
    joined = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("block_no", "text")))), lambda x: x["text"]), "\n")
    both = rows.groupBy("fetch_id").agg(joined(kept).alias("_k"), joined(fallback).alias("_f")).join(chars, "fetch_id")
    thin = (F.col("visible") >= 140) & (F.length("_k") < 140) & (F.length("_k") / F.col("visible") < 0.04)
    body = F.when(thin, F.col("_f")).otherwise(F.col("_k"))
    return both.select("fetch_id", body.alias("body"), F.round(F.length(body) / F.col("visible"), 4).alias("retained_ratio"))


def word_counts(spark, d):
    words = read_table(spark, d, "documents").where("text is not null").select(F.explode(text.simple_words(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def word_positions(spark, d):
    """IB-03 over texts: tokens, distinct terms and length of each document."""
    docs = read_table(spark, d, "documents").where("text is not null").select("doc_id", text.simple_words(F.col("text")).alias("_w"))
    return docs.select("doc_id", F.size("_w").cast("bigint").alias("length"), F.size(F.array_distinct("_w")).cast("bigint").alias("terms"))


def char_bigrams(spark, d):
    rows = read_table(spark, d, "documents").where("lang = 'ja'").select(F.explode(text.native_bigrams(F.col("text"))).alias("pair"))
    return rows.groupBy("pair").agg(F.count("*").alias("n"))


def char_bigrams_full(spark, d):
    """TX-07 over all documents: pairs within runs of Chinese and Japanese characters, whatever the label."""
    ranges = "".join(f"{chr(low)}-{chr(high)}" for low, high, script in text.SCRIPT_RANGES if script == "cjk")
    runs = F.regexp_extract_all(F.regexp_replace("text", r"\s+", ""), F.lit(rf"([{ranges}&&[\p{{L}}\p{{N}}]]+)"), F.lit(1))
    rows = read_table(spark, d, "documents").select(F.explode(runs).alias("run")).select(F.explode(text.native_bigrams(F.col("run"))).alias("pair"))
    return rows.groupBy("pair").agg(F.count("*").alias("n"))


def analyzed_terms(spark, d):
    """TX-01: terms of all documents by kind."""
    return text.analyzed(read_table(spark, d, "documents")).groupBy("term", "kind").agg(F.count("*").alias("n"), F.approx_count_distinct("doc_id").alias("docs"))


def analyzed_lengths(spark, d):
    tokens = text.analyzed(read_table(spark, d, "documents"))
    return tokens.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.count_distinct("position").alias("length"))


def spelling_candidates(spark, d):
    """Rare words of the indexed terms, by their share of the records, and their frequent neighbours within two edits."""
    docs = index.records(read_table(spark, d, "input_documents"))
    limit = docs.agg(F.greatest(F.lit(1), F.floor(F.count("*") * RARE_SHARE)).alias("_most"))
    words = attach(index.dictionary(index.postings(docs, "external_id")), limit)
    rare = words.where("doc_freq <= _most").select(F.col("term").alias("word"))
    near = text.edit_candidates(rare, words.where("doc_freq > _most"))
    return ranks.top_k(near, ["word"], [F.asc("distance"), F.desc("doc_freq"), F.asc("candidate")], 3, F.col("candidate")).select("word", "candidate", "distance", "doc_freq")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        page_titles, page_titles_full, lang_attributes, lang_attributes_full, render_decisions, render_decisions_full, charset_sources, page_fields, page_links, discovered_urls, block_classes, template_texts, extracted_text,
        word_counts, word_positions, char_bigrams, char_bigrams_full, analyzed_terms, analyzed_lengths, spelling_candidates,
    )
}

_PAGES = "pages as (select * from (select fetch_id, url, try(decode(body)) as html from fetch_results where body is not null) where html is not null)"
_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+(?:[''’]\\p{L}+)*')"
#: A blob as text, one byte a character; the engine escapes all but plain ascii, quotes and white space among it.
BYTES = "body::varchar"
for _code, _char in (("22", '"'), ("27", "''"), ("0A", " "), ("0D", " "), ("09", " ")):
    BYTES = f"replace({BYTES}, '\\x{_code}', '{_char}')"
_MARKERS = ", ".join("'" + m.replace("'", "''") + "'" for m in html.FRAMEWORK_MARKERS)

SQL: dict[str, str] = {
    "page_titles": f"with {_PAGES} select fetch_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) as title from pages",
    "lang_attributes": f"""with {_PAGES} select nullif(lower(regexp_extract(html, '(?i)<html[^>]*\\slang\\s*=\\s*["'']?([a-zA-Z]{{2,3}})(?:[-_][^"''>\\s]*)?["''\\s>]', 1)), '') as lang, count(*)::bigint as pages from pages group by 1""",
    "render_decisions": f"""with {_PAGES}, m as (
  select fetch_id, url, html,
    (coalesce(list_sum(list_transform(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), lambda s: strlen(s))), 0) + 8192 * len(regexp_extract_all(html, '(?i)<script[^>]*\\ssrc=')))::bigint as script_weight,
    length(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')))::bigint as visible_chars
  from pages where html like '%<body%')
select fetch_id, script_weight, visible_chars,
  case when len(list_filter([{_MARKERS}], lambda k: contains(html, k))) > 0 then 'render_framework' when visible_chars < 200 and script_weight > 20480 then 'render_thin'
       when ('0x' || substr(md5(url || '|2026-01-31'), 1, 8))::ubigint % 1000000 < 10000 then 'render_audit' else 'static' end as decision from m""",
    "word_counts": f"select word, count(*)::bigint as n from (select unnest({_WORDS}) as word from documents where text is not null) group by 1",
    "word_positions": f"select doc_id, len({_WORDS})::bigint as length, len(list_distinct({_WORDS}))::bigint as terms from documents where text is not null",
    "char_bigrams": """with t as (select regexp_replace(text, '\\s+', '', 'g') as t from documents where lang = 'ja'),
p as (select unnest(case when length(t) = 1 then [t] else list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) end) as pair from t)
select pair, count(*)::bigint as n from p group by 1""",
    "spelling_candidates": f"""with docs as (select external_id, any_value(terms) as terms from input_documents where external_id is not null group by 1),
dict as (select term, count(*) as doc_freq from (select external_id, unnest(map_keys(terms)) as term from docs) group by 1), lim as (select greatest(1, floor(count(*) * {RARE_SHARE})) as most from docs),
near as (select r.term as word, c.term as candidate, levenshtein(r.term, c.term) as distance, c.doc_freq from dict r, dict c, lim where r.doc_freq <= most and c.doc_freq > most and abs(length(r.term) - length(c.term)) <= 2 and levenshtein(r.term, c.term) <= 2)
select word, candidate, distance::int as distance, doc_freq::bigint as doc_freq from near qualify row_number() over (partition by word order by distance, doc_freq desc, candidate) <= 3""",
}
SQL["char_bigrams_full"] = r"""with t as (select unnest(regexp_extract_all(regexp_replace(text, '\s+', '', 'g'), '[\x{3041}-\x{3096}\x{309D}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]+')) as t from documents where text is not null),
p as (select unnest(case when length(t) = 1 then [t] else list_transform(range(1, length(t)), lambda i: substr(t, i, 2)) end) as pair from t)
select pair, count(*)::bigint as n from p group by 1"""
