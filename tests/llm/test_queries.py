import pytest

from sievework.llm import queries

from ..conftest import DATA, plain


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    queries.QUERIES[name](spark, DATA).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize(("name", "columns"), {"p1_found": ["fetch_id"], "p2_found": ["fetch_id", "block_md5"], "p3_found": ["task_id"], "p4_found": ["fetch_id"], "p5_found": ["fetch_id", "segment_no", "language"], "p7_found": ["external_id", "term"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id"]}.items())
def test_columns(spark, name, columns):
    assert queries.QUERIES[name](spark, DATA).columns == columns


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[2]
    for f in (root / "sievework").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"\bllm\b", f.read_text())


def _rows(spark, name):
    return {tuple(r) for r in queries.QUERIES[name](spark, DATA).collect()}


def test_queries_agree(spark):
    """The found rows are those of the reports beside them."""
    shares = {r.fetch_id: r.spam_share for r in queries.p1_shares(spark, DATA).collect()}
    spam_ids = {x[0] for x in _rows(spark, "p1_found")}
    assert spam_ids == {i for i, share in shares.items() if share > 0.5}
    blocks = {}
    for r in queries.p1_blocks(spark, DATA).collect():
        words, bad = blocks.get(r.fetch_id, (0.0, 0.0))
        blocks[r.fetch_id] = words + r.words, bad + r.words * r.spam
    assert {i for i, (words, bad) in blocks.items() if bad > 0.5 * words} == spam_ids
    garbled = {x[0] for x in _rows(spark, "p4_found")}
    assert garbled == {r.fetch_id for r in queries.p4_restored(spark, DATA).collect()}
    bodies = _rows(spark, "p2_found")
    assert not {i for i, _ in bodies} & (spam_ids | garbled)
    assert bodies == {(r.fetch_id, r.block_md5) for r in queries.p2_main_body(spark, DATA).collect() if not r.spam and not r.garbled}
    spoken = queries.p5_confidence(spark, DATA).collect()
    assert _rows(spark, "p5_found") == {(r.fetch_id, r.segment_no, r.language) for r in spoken} and all(r.confidence >= 0.4 for r in spoken)
    assert not {r.fetch_id for r in spoken} & (spam_ids | garbled)
    by_page = {}
    for r in spoken:
        by_page.setdefault(r.fetch_id, {})[r.segment_no] = r.language
    assert all(sorted(own) == list(range(1, len(own) + 1)) and all(own[k] != own[k + 1] for k in range(1, len(own))) for own in by_page.values())


def test_leaks_and_bands_agree(spark):
    evidence = queries.p8_evidence(spark, DATA).collect()
    assert _rows(spark, "p8_found") == {(r.doc_id, r.item_id) for r in evidence if 2 * r.words_found >= r.words_in_item}
    bands = queries.p10_bands(spark, DATA).collect()
    assert {x[0] for x in _rows(spark, "p10_found")} == {r.doc_id for r in bands if r.repetitive}
    assert all(r.repetitive == (r.repeated_share >= 0.5) for r in bands), "bands and exact share differ"
    made, shares = queries.p9_mix(spark, DATA).collect(), {r.source: r for r in queries.p9_shares(spark, DATA).collect()}
    assert {r.source for r in made} <= set(shares) and sum(r.piece_tokens for r in made) == sum(r.tokens_used for r in shares.values())
    answers = queries.p3_wrong_answers(spark, DATA).collect()
    assert all(r.missed == 0 and r.rate_measured <= max(r.bound, 5 / r.distinct_keys) for r in answers)
