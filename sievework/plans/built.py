"""Pages built from table rows and parsed again: what the supplied pages lack (canonical addresses, robots, dates, link kinds, titles by cascade), with SQL that says what must come out.

Every document gives one page; the SQL states its fields from the row, so the parser makes an exact round trip.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, urls
from ..session import read_table
from ..sources import topics

Query = Callable[[SparkSession, str], DataFrame]

LANGS, LANG_CODES = ("en-GB", "de", "fr_CA", ""), ("en", "de", "fr", None)
ROBOTS, ROBOTS_OUT = ("index, follow", "noindex", "none, noarchive", "NOFOLLOW"), ("", "noindex", "noarchive,nofollow,noindex,none", "nofollow")
RELS, KINDS = ("", "nofollow", "ugc nofollow", "sponsored ugc"), ("follow", "nofollow", "ugc", "sponsored")
CHARSETS = ("utf-8", "iso-8859-1", "koi8-r", "shift_jis")


def _pick(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """fetch_id, url, content_type, body."""
    n, s = F.col("doc_id"), F.col("doc_id").cast("string")
    third = F.pmod(n, F.lit(3))
    title = F.when(F.pmod(n, F.lit(2)) == 0, F.concat(F.lit("<title>  Title\n of "), s, F.lit(" </title>"))).otherwise(F.concat(F.lit("<meta property='og:title' content='Graph "), s, F.lit("'>")))
    canonical = F.when(third == 0, F.concat(F.lit("/c/"), s, F.lit("?utm_source=x"))).when(third == 1, "https://other.example/c").otherwise("http://[bad")
    date = F.concat(F.lit("2026-0"), (F.pmod(n, F.lit(9)) + 1).cast("string"), F.lit("-11"))
    dated = F.when(third == 0, F.concat(F.lit('<script type="application/ld+json">[{"datePublished": "'), date, F.lit('"}, 7]</script><script type="application/ld+json">{broken</script>'))).when(
        third == 1, F.concat(F.lit("<meta property='article:published_time' content=' "), date, F.lit("'>"))
    ).otherwise(F.lit(""))
    clock = F.when(third == 2, F.concat(F.lit("<time datetime='"), date, F.lit("'>on a day</time>"))).otherwise(F.lit(""))
    link = F.concat(F.lit("<a href='https://other"), F.pmod(n, F.lit(7)).cast("string"), F.lit(".example/x?b=2&amp;a=1#f' rel='"), _pick(RELS, n), F.lit("'>anchor "), s, F.lit("</a>"))
    page = F.concat(
        F.lit("<!doctype html><html lang='"), _pick(LANGS, n), F.lit("'><head>"), title, F.lit("<meta name=description content=' About "), s, F.lit(" '><meta name='robots' content='"), _pick(ROBOTS, n),
        F.lit("'><link rel='canonical' href='"), canonical, F.lit("'>"), dated, F.when(F.pmod(n, F.lit(5)) == 0, F.lit("<script src='/s.js'></script>")).otherwise(F.lit("")),
        F.lit("</head><body><nav><a href='/home'>Home page here</a> <a href='mailto:a@b.example'>mail</a></nav><main><h1>Heading of page "), s, F.lit("</h1><p>Text before "), link, F.lit(" and "), link,
        F.lit(" after it</p><p>Go up to <a href='../up'>upper page</a> from here, or to <a href=''>this</a> one<p>An unclosed paragraph of plain words and no links &amp; some signs"), clock,
        F.lit("</main><footer>All rights are reserved</footer></body></html>"),
    )
    url = F.concat(F.lit("https://www.site"), F.pmod(n, F.lit(50)).cast("string"), F.lit(".example/p/q/"), s)
    rows = read_table(spark, d, "documents").where("doc_id is not null").select(n.alias("fetch_id"), url.alias("url"), F.lit("text/html; charset=utf-8").alias("content_type"), F.encode(page, "utf-8").alias("body"))
    return rows


def _parsed(spark, d):
    return html.parsed_pages(pages(spark, d))


def built_page_fields(spark, d):
    """HT-12, 14..18, 26, 31; URL-14: fields of built pages."""
    p = _parsed(spark, d)
    return p.select("fetch_id", "title", F.array_join("headings", "|").alias("headings"), "meta_description", "canonical_url", "lang", F.array_join("robots_meta", ",").alias("robots_meta"), "published", "structured", "script_weight", F.size("links").alias("links"), "warning")


def built_page_links(spark, d):
    """HT-19..22; URL-13/15: links of built pages."""
    return _parsed(spark, d).select("fetch_id", F.explode("links").alias("_l")).select("fetch_id", "_l.*")


def built_blocks(spark, d):
    """HT-06/07: blocks of built pages."""
    return _parsed(spark, d).select("fetch_id", F.posexplode("blocks").alias("block_no", "_b")).select("fetch_id", "block_no", "_b.text", "_b.tag", "_b.num_words", "_b.link_words", "_b.chrome")


def built_block_classes(spark, d):
    """HT-08/09: what the classifier makes of the blocks of built pages."""
    return html.classify_blocks(built_blocks(spark, d).where("not chrome")).select("fetch_id", "block_no", "reason", "is_content")


def built_templates(spark, d):
    """HT-10: texts that stand on most pages of a host."""
    blocks = _parsed(spark, d).select("fetch_id", urls.url_host(F.col("url")).alias("host"), F.explode("blocks").alias("_b")).select("fetch_id", "host", "_b.text")
    return html.template_texts(blocks).select("host", "text", "pages")


def built_discovered(spark, d):
    """HT-23/24: addresses that built pages lead to, and what passes authority."""
    return built_page_links(spark, d).groupBy("target_url").agg(F.count("*").alias("links"), F.count_if(F.col("rel") == "follow").alias("follow"), F.count_if("in_main_content").alias("main"))


def parse_documents(spark, d):
    """IO-08/09: document events of built pages that may be indexed."""
    return topics.parse_outputs(_parsed(spark, d))["documents"].select("url", "title", F.array_join("robots_meta", ",").alias("robots_meta"), "published", "outlink_count")


def parse_links(spark, d):
    """IO-09: link events of built pages whose links may be followed."""
    return topics.parse_outputs(_parsed(spark, d))["links"].groupBy("target_url", "internal").agg(F.count("*").alias("links"))


def parse_discovered(spark, d):
    """IO-09: addresses for the frontier."""
    return topics.parse_outputs(_parsed(spark, d))["discovered"]


def charset_labels(spark, d):
    """HT-03/04/05: built bodies in several charsets, declared in header or page, decoded again."""
    from ..functions.charset import decode

    n = F.col("doc_id")
    word = F.element_at(F.array(*[F.lit(w) for w in ("naïve € “x”", "café é", "привет", "日本語")]), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    rows = read_table(spark, d, "documents").where("doc_id is not null").select("doc_id", word.alias("word"), F.pmod(n, F.lit(4)).cast("int").alias("kind"), (F.pmod(n, F.lit(3)) == 0).alias("in_header"))

    def run(batches):
        for pdf in batches:
            out = []
            for i, w, k, head in zip(pdf["doc_id"], pdf["word"], pdf["kind"], pdf["in_header"]):
                name = CHARSETS[k]
                body = ("" if head else f"<meta charset='{name.upper()}'>").encode() + w.encode(name)
                text, encoding, source = decode(body, f"text/html; charset=\"{name}\"" if head else "text/html")
                out.append((i, encoding, source, text.endswith(w)))
            yield type(pdf)(out, columns=["doc_id", "encoding", "source", "restored"])

    return rows.mapInPandas(run, "doc_id bigint, encoding string, source string, restored boolean")


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (built_page_fields, built_page_links, built_blocks, built_block_classes, built_templates, built_discovered, parse_documents, parse_links, parse_discovered, charset_labels)
}


def _case(values: tuple) -> str:
    return "case n % " + str(len(values)) + " " + " ".join(f"when {k} then " + ("null" if v is None else f"'{v}'") for k, v in enumerate(values)) + " end"


_ROWS = f"""d as (select doc_id as n, doc_id::varchar as s, 'https://www.site' || (doc_id % 50) || '.example' as site from documents where doc_id is not null),
f as (select n as fetch_id, n, s, site, site || '/p/q/' || s as url, case when n % 2 = 0 then 'Title of ' || s else 'Graph ' || s end as title, 'Heading of page ' || s as headings, 'About ' || s as meta_description,
  case when n % 3 = 0 then site || '/c/' || s end as canonical_url, {_case(LANG_CODES)} as lang, {_case(ROBOTS_OUT)} as robots_meta, '2026-0' || (n % 9 + 1) || '-11' as published,
  case when n % 3 = 0 then 1 else 0 end as structured, (case when n % 3 = 0 then length('[{{"datePublished": "2026-01-11"}}, 7]') + length('{{broken') else 0 end + case when n % 5 = 0 then 8192 else 0 end)::bigint as script_weight,
  3 as links, case n % 3 when 1 then 'canonical_cross_site' when 2 then 'canonical_invalid' end as warning from d),
p as (select *, 'Text before anchor ' || s || ' and anchor ' || s || ' after it' as para, 'Go up to upper page from here, or to this one' as up from f),
l as (
  select fetch_id, n, robots_meta, url as source_url, site || '/home' as target_url, 'Home page here' as anchor_text, 'Home page here mail' as context, 'follow' as rel, true as internal, false as in_main_content from p
  union all select fetch_id, n, robots_meta, url, 'https://other' || (n % 7) || '.example/x?a=1&b=2', 'anchor ' || s, para, {_case(KINDS)}, false, true from p
  union all select fetch_id, n, robots_meta, url, site || '/p/up', 'upper page', up, 'follow', true, true from p),
b as (
  select fetch_id, 0 as block_no, 'Home page here mail' as text, 'nav' as tag, 4 as num_words, 4 as link_words, true as chrome from p
  union all select fetch_id, 1, headings, 'h1', 4, 0, false from p
  union all select fetch_id, 2, para, 'p', 9, 4, false from p
  union all select fetch_id, 3, up, 'p', 11, 3, false from p
  union all select fetch_id, 4, 'An unclosed paragraph of plain words and no links & some signs' || case when n % 3 = 2 then 'on a day' else '' end, 'p', case when n % 3 = 2 then 13 else 11 end, 0, false from p
  union all select fetch_id, 5, 'All rights are reserved', 'footer', 4, 0, true from p)"""
_INDEXED, _FOLLOWED = "not contains(robots_meta, 'noindex')", "not contains(robots_meta, 'nofollow')"

SQL: dict[str, str] = {
    "built_page_fields": f"with {_ROWS} select fetch_id, title, headings, meta_description, canonical_url, lang, robots_meta, published, structured, script_weight, links, warning from f",
    "built_page_links": f"with {_ROWS} select fetch_id, target_url, anchor_text, context, rel, internal, in_main_content from l",
    "built_blocks": f"with {_ROWS} select fetch_id, block_no, text, tag, num_words, link_words, chrome from b",
    "built_block_classes": f"""with {_ROWS}, x as (select *, link_words / num_words as density from b where not chrome),
w as (select *, lag(num_words, 1, 1000000) over v as before, lead(num_words, 1, 1000000) over v as after, coalesce(lag(density) over v, 0) as before_density from x window v as (partition by fetch_id order by block_no)),
r as (select fetch_id, block_no, case when density > 0.333 then 'link_density' when tag in ('h1', 'h2', 'h3', 'h4') then 'heading'
  when before_density <= 0.555 then case when num_words > 16 then 'long' when after <= 15 and before <= 4 then 'short_isolated' else 'short_in_context' end
  when num_words <= 40 and after <= 17 then 'after_links' else 'long_after_links' end as reason from w)
select *, reason not in ('link_density', 'short_isolated', 'after_links') as is_content from r""",
    "built_templates": f"""with {_ROWS}, x as (select 'www.site' || (fetch_id % 50) || '.example' as host, text, fetch_id from b), t as (select host, count(distinct fetch_id) as n from x group by 1)
select host, text, count(distinct fetch_id)::bigint as pages from x join t using (host) group by host, text, t.n having t.n >= 4 and count(distinct fetch_id) / t.n >= 0.6""",
    "built_discovered": f"with {_ROWS} select target_url, count(*)::bigint as links, count_if(rel = 'follow')::bigint as follow, count_if(in_main_content)::bigint as main from l group by 1",
    "parse_documents": f"with {_ROWS} select coalesce(canonical_url, url) as url, title, robots_meta, published, 3 as outlink_count from f where {_INDEXED}",
    "parse_links": f"with {_ROWS} select target_url, internal, count(*)::bigint as links from l where {_FOLLOWED} group by 1, 2",
    "parse_discovered": f"with {_ROWS} select target_url as url, min(source_url) as source_url from l where {_FOLLOWED} group by 1",
    "charset_labels": """select doc_id, case doc_id % 4 when 0 then 'utf-8' when 1 then 'windows-1252' when 2 then 'koi8-r' else 'shift_jis' end as encoding, case when doc_id % 3 = 0 then 'header' else 'meta' end as source, true as restored from documents where doc_id is not null""",
}
