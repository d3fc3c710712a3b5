"""The page operators over fetch_results: one pass over the bodies, no shuffle, whole pages.

Every operator reads fetch_id, the content-type header (names in any case) and
body, and nothing else, so further columns may have any name.

Defined results
* null or empty body, or a body that is not html: no row.
* null headers: the page's own declaration decides, else UTF-8.
* null fetch_id: the row is kept with a null id. Repeated rows give rows each.
* an empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import encoding, langid, mainbody, pages, spam


@dataclass(slots=True)
class Reading:
    """A page as it was read: decoded in the project's order, then restored where that garbled it."""

    text: str
    encoding: str
    declared_by: str
    page: pages.Page
    main: list[pages.Block]
    garbled: bool
    restored_encoding: str
    layers: int

    def main_text(self) -> str:
        return "\n".join(b.text for b in self.main)


def read(body: bytes | None, content_type: str | None, restore: bool = True) -> Reading | None:
    """None where the body is no html page."""
    if not pages.is_html(body, content_type):
        return None
    text, name, where = pages.decode(body, content_type)
    page = pages.parse(text)
    main = mainbody.main_blocks(page)
    bad = encoding.page_is_garbled(body, name, "\n".join(b.text for b in main), text)
    fitting, layers = name, 0
    if bad and restore:
        text, fitting = encoding.redecode(body, name, text)
        text, layers = encoding.repair_text(encoding.without_high_entities(text))
        page = pages.parse(text)
        main = mainbody.main_blocks(page)
    return Reading(text, name, where, page, main, bad, fitting, layers)


def judged(r: Reading, model: spam.Model) -> list[spam.Judged]:
    """The blocks of the main region; none of a page whose words are lost, of which nothing can be said."""
    if r.garbled and encoding.mostly_garbled(r.main_text()):
        return []
    return spam.judge([b.text for b in spam.own_region(r.page)], model)


def spam_of(r: Reading, model: spam.Model) -> tuple[float, float]:
    """Share and redundancy."""
    if r.garbled and encoding.mostly_garbled(r.main_text()):
        return 0.0, 1.0
    return spam.page_spam(r.page, model)


def is_spam(r: Reading, model: spam.Model) -> bool:
    return not (r.garbled and encoding.mostly_garbled(r.main_text())) and spam.is_spam(r.page, model)


def per_page(fetches: DataFrame, rows_of: Callable[[Reading], Iterable[tuple]], schema: str, restore: bool = True) -> DataFrame:
    """fetch_id and the rows that rows_of gives for each html page."""
    kind = "content-type"
    header = F.element_at(F.map_values(F.map_filter("headers", lambda k, v: F.lower(k) == kind)), 1) if dict(fetches.dtypes).get("headers", "").startswith("map") else F.col("headers").cast("string")
    has = F.size(F.map_filter("headers", lambda k, v: F.lower(k) == kind)) > 0 if dict(fetches.dtypes).get("headers", "").startswith("map") else F.lit(True)
    source = fetches.where("body is not null").select(F.col("fetch_id").cast("bigint").alias("fetch_id"), F.when(has, header).alias("_type"), F.col("body").cast("binary").alias("_body"))
    columns = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], [[] for _ in columns]
            for n, kind_of, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                r = read(body.as_py(), kind_of, restore)
                if r is None:
                    continue
                for row in rows_of(r):
                    ids.append(n)
                    for c, v in zip(out, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, t) for c, t in zip(out, types)]], ["fetch_id", *columns])

    arrow = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_(), "bigint": pa.int64()}
    types = [arrow[x.strip().split()[1]] for x in schema.split(",")] if schema else []
    if not schema:
        columns = []
    return spread(source).mapInArrow(run, "fetch_id bigint" + (", " + schema if schema else ""))


def keyword_pages(fetches: DataFrame, model: spam.Model = spam.NO_MODEL) -> DataFrame:
    """Problem 1: fetch_id, spam_share, redundancy (lowest normalised ratio) of every html page."""
    shared = fetches.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def rows(r: Reading):
        share, least = spam_of(r, shared.value)
        yield round(share, 4), round(least, 4)

    return per_page(fetches, rows, "spam_share double, redundancy double")


def keyword_ids(fetches: DataFrame, model: spam.Model = spam.NO_MODEL) -> DataFrame:
    """Problem 1: fetch_id of the html pages that keyword_pages gives a share of more than a half."""
    shared = fetches.sparkSession.sparkContext.broadcast(model)
    return per_page(fetches, lambda r: [(True,)] if is_spam(r, shared.value) else [], "spam boolean").select("fetch_id")


def keyword_blocks(fetches: DataFrame, model: spam.Model = spam.NO_MODEL) -> DataFrame:
    """Problem 1 block by block: fetch_id, block_no, kind, words, redundancy, punctuation (sentence ends a word), spam."""
    shared = fetches.sparkSession.sparkContext.broadcast(model)

    def rows(r: Reading):
        for k, b in enumerate(judged(r, shared.value)):
            yield k, b.kind, b.words, round(b.redundancy, 4), round(b.density, 4), b.spam

    return per_page(fetches, rows, "block_no int, kind string, words double, redundancy double, punctuation double, spam boolean")


def main_body(fetches: DataFrame, model: spam.Model = spam.NO_MODEL) -> DataFrame:
    """Problem 2: fetch_id, block_no, block, block_md5, garbled, spam: the main-body blocks of every html page."""
    shared = fetches.sparkSession.sparkContext.broadcast(model)

    def rows(r: Reading):
        bad = is_spam(r, shared.value)
        for k, b in enumerate(r.main):
            yield k, b.text, hashlib.md5(b.text.encode("utf-8", "replace")).hexdigest(), r.garbled, bad

    return per_page(fetches, rows, "block_no int, block string, block_md5 string, garbled boolean, spam boolean")


def main_body_hashes(fetches: DataFrame, model: spam.Model = spam.NO_MODEL) -> DataFrame:
    """fetch_id, block_md5, spam: distinct block hashes of the pages that are not garbled; repeats within a page give one row. Who wants no spam pages filters them."""
    shared = fetches.sparkSession.sparkContext.broadcast(model)

    def rows(r: Reading):
        if r.garbled:
            return
        bad = is_spam(r, shared.value)
        for h in dict.fromkeys(hashlib.md5(b.text.encode("utf-8", "replace")).hexdigest() for b in r.main):
            yield h, bad

    return per_page(fetches, rows, "block_md5 string, spam boolean", restore=False)


def garbled_pages(fetches: DataFrame) -> DataFrame:
    """Problem 4: the garbled html pages, with the encoding that fits, the nested layers taken off and the restored main text (null beyond repair)."""

    def rows(r: Reading):
        if r.garbled:
            text = r.main_text()
            yield r.encoding, r.declared_by, r.restored_encoding, r.layers, None if encoding.is_garbled(text) else text

    return per_page(fetches, rows, "declared string, declared_by string, fitting string, layers int, restored string")


def garbled_ids(fetches: DataFrame) -> DataFrame:
    return per_page(fetches, lambda r: [(True,)] if r.garbled else [], "garbled boolean", restore=False).select("fetch_id")


def languages(fetches: DataFrame, model: spam.Model) -> DataFrame:
    """Problem 5: fetch_id, segment_no, language, confidence, segments, main_language, excluded (spam or garbled)."""
    shared = fetches.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def rows(r: Reading):
        found = langid.segments(shared.value.filters, [b.text for b in r.main])
        if not found:
            return
        size: dict[str, int] = {}
        for lang, _, own in found:
            size[lang] = size.get(lang, 0) + sum(map(len, own))
        main = max(sorted(size), key=lambda x: size[x])
        bad = r.garbled or is_spam(r, shared.value)
        for k, (lang, confidence, _) in enumerate(found, 1):
            yield k, lang, confidence, len(found), main, bad

    return per_page(fetches, rows, "segment_no int, language string, confidence double, segments int, main_language string, excluded boolean")


def relabelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Segments of the fetches whose label is missing or wrong, or whose body mixes languages. labels: fetch_id, language. Segments that no language explains are left out."""
    primary = F.lower(F.split_part(F.regexp_replace(F.trim("language"), "_", "-"), F.lit("-"), F.lit(1)))
    known = labels.where("fetch_id is not null").select(F.col("fetch_id").cast("bigint").alias("fetch_id"), primary.alias("_label")).dropDuplicates(["fetch_id"])
    both = found.where(~F.col("excluded") & (F.col("confidence") >= langid.VERDICT)).join(known, "fetch_id")
    wrong = F.col("_label").isNull() | F.col("_label").isin("", "und") | (F.col("_label") != F.col("main_language"))
    return both.where(wrong | (F.col("segments") > 1)).select("fetch_id", "segment_no", "language", "confidence", F.col("_label").alias("label"))
