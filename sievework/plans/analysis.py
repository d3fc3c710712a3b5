"""Texts built from table rows and analyzed: identifiers, folding, pairs, affixes and positions, with SQL that says what must come out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..session import read_table

Query = Callable[[SparkSession, str], DataFrame]

PLAIN = text.Config(stems=False)
LANGS = ("en", "de", "ja", "ar", "ko")


def _texts(spark, d):
    n, s = F.col("doc_id"), F.col("doc_id").cast("string")
    kinds = [
        F.concat(F.lit("Running COVID-"), s, F.lit(" in C++ at 192.168.0."), F.pmod(n, F.lit(250)).cast("string"), F.lit(" for a"), s, F.lit("@x.test")),
        F.concat(F.lit("Schön, Straße Über"), s), F.concat(F.lit("日本語 "), s), F.concat(F.lit("والكتاب "), s), F.concat(F.lit("텍스트를 "), s),
    ]
    at = (F.pmod(n, F.lit(len(LANGS))) + 1).cast("int")
    return read_table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.element_at(F.array(*kinds), at).alias("text"), F.element_at(F.array(*map(F.lit, LANGS)), at).alias("lang"))


def built_tokens(spark, d):
    """TX-01..12, 14, 17: every token with its position and kind."""
    t = _texts(spark, d)
    english = text.analyzed(t.where("lang = 'en'"))
    others = text.analyzed(t.where("lang <> 'en'"), config=PLAIN)
    return english.unionByName(others).select("doc_id", "term", "position", "kind")


def built_lengths(spark, d):
    """TX-16: positions of each text."""
    return built_tokens(spark, d).groupBy("doc_id").agg(F.count_distinct("position").alias("length"))


def built_terms(spark, d):
    """TX-15/19: terms of two fields with a gap between them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n in pdf["doc_id"]:
                terms, length = text.document_terms([f"New York {n} new", None, "Times"], "en", PLAIN)
                rows += [(n, t, ",".join(map(str, p)), length) for t, p in terms.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "term", "positions", "length"])

    return read_table(spark, d, "documents").where("doc_id is not null").select("doc_id").mapInPandas(run, "doc_id bigint, term string, positions string, length int")


def built_views(spark, d):
    """TX-20, 23, 25: surface words, words with an expansion, and what is one identifier."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for n in pdf["doc_id"]:
                tokens, _ = text.analyze(f"cars at v1.{n}", "en")
                more = text.expand(tokens, lambda t: ["vehicle"] if t == "cars" else [])
                rows.append((n, " ".join(text.surface_terms(tokens)), sum(k == "expansion" for *_, k in more), text.is_identifier(f"v1.{n}"), text.is_identifier(f"cars {n}"), text.expand(tokens) == tokens))
            yield pd.DataFrame(rows, columns=["doc_id", "surface", "added", "one", "two", "same"])

    return read_table(spark, d, "documents").where("doc_id is not null").select("doc_id").mapInPandas(run, "doc_id bigint, surface string, added int, one boolean, two boolean, same boolean")


QUERIES: dict[str, Query] = {f.__name__: f for f in (built_tokens, built_lengths, built_terms, built_views)}

_TOKENS = {
    0: [("'running'", 0, "surface"), ("'run'", 0, "stem"), ("'covid-' || s", 1, "whole"), ("'covid'", 1, "part"), ("s", 2, "part"), ("'in'", 3, "surface"), ("'c++'", 4, "whole"), ("'at'", 5, "surface"),
        ("'192.168.0.' || n % 250", 6, "whole"), ("'for'", 7, "surface"), ("'a' || s || '@x.test'", 8, "whole"), ("'a' || s", 8, "part"), ("'x'", 9, "part"), ("'test'", 10, "part")],
    1: [("'schön'", 0, "surface"), ("'schoen'", 0, "folded"), ("'strasse'", 1, "surface"), ("'über' || s", 2, "whole")],
    2: [("'日本'", 0, "ngram"), ("'本語'", 1, "ngram"), ("s", 2, "surface")],
    3: [("'والكتاب'", 0, "surface"), ("'كتاب'", 0, "stem"), ("s", 1, "surface")],
    4: [("'텍스트를'", 0, "surface"), ("'텍스트'", 0, "stem"), ("s", 1, "surface")],
}
_D = "d as (select doc_id as n, doc_id::varchar as s from documents where doc_id is not null)"
_T = "t as (" + " union all ".join(f"select n as doc_id, {term} as term, {p} as position, '{kind}' as kind from d where n % 5 = {k}" for k, own in _TOKENS.items() for term, p, kind in own) + ")"

SQL: dict[str, str] = {
    "built_tokens": f"with {_D}, {_T} select doc_id, term, position, kind from t",
    "built_lengths": f"with {_D}, {_T} select doc_id, count(distinct position)::bigint as length from t group by 1",
    "built_terms": f"""with {_D} select n as doc_id, 'new' as term, '0,3' as positions, 5 as length from d union all select n, 'york', '1', 5 from d union all select n, s, '2', 5 from d union all select n, 'times', '{4 + text.FIELD_GAP}', 5 from d""",
    "built_views": f"with {_D} select n as doc_id, 'cars at v1.' || s as surface, 1 as added, true as one, false as two, true as same from d",
}
