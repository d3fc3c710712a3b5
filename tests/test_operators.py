import math

import pytest
from pyspark.sql import functions as F

from sievework.operators import crawl, dedup, delivery, evaluate, graph, index, monitor, ranking, ranks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- delivery ----------------------------------------------------------------------------------------

MESSAGE = "delivery_id long, url string, blob string, fetched_at timestamp, msg_key int, part string"


def messages(spark, data):
    return spark.createDataFrame([(n, u, b, t, 7, "clash") for n, u, b, t in data], MESSAGE)


def test_delivery_keeps_the_first_of_each(spark):
    from datetime import datetime

    t, u = datetime(2026, 1, 1), datetime(2026, 1, 9)
    first = messages(spark, [(3, "a", "2026/01/01/x.gz", t), (4, "a", "s3://here/2026/01/01/x.gz", u), (5, None, "2026/01/01/x.gz", t), (6, "b", None, t), (7, "b", None, u)])
    second = messages(spark, [(1, "a", "2026/01/01/x.gz", u), (8, "b", "", t), (9, "c", "2026/01/02/y.gz", t), (9, "c", "2026/01/02/y.gz", t), (10, "d", None, None), (11, "d", None, None)])
    store = delivery.DeliveryStore(spark)
    touched = store.merge(first)
    assert touched == ["2026-01-01", "2026-01-09"]
    before = store.manifest()["parts"]
    store.merge(second)
    assert sorted(r.delivery_id for r in store.winners().collect()) == [1, 6, 7, 9, 10]
    assert store.manifest()["parts"]["2026-01-09"] == before["2026-01-09"], "a partition that nothing touched was rewritten"
    assert rows(delivery.repeated_deliveries(store, first.union(second))) == [(11,), (3,), (4,), (8,), (9,)], "9 came twice under one id: one copy is a repeat"
    again = store.winners().count()
    store.merge(second)
    assert store.winners().count() == again


def test_equal_and_null_delivery_ids(spark):
    m = messages(spark, [(5, "a", "x", None), (5, "a", "x", None), (5, "a", "x", None), (7, "a", "x", None), (None, "b", "y", None), (None, "b", "y", None), (None, "c", "z", None), (4, "c", "z", None), (None, "d", "q", None)])
    store = delivery.replay(delivery.DeliveryStore(spark), m)
    assert sorted((r[0] is None, r[0]) for r in delivery.repeated_deliveries(store, m).collect()) == [(False, 5), (False, 5), (False, 7), (True, None), (True, None)]
    assert store.winners().count() == 4


def test_an_open_reader_keeps_its_files(spark):
    from datetime import datetime

    store = delivery.DeliveryStore(spark)
    one = messages(spark, [(3, "a", None, datetime(2026, 1, 1)), (4, "b", None, datetime(2026, 1, 1))])
    store.merge(one)
    reader = store.winners()
    store.merge(messages(spark, [(1, "a", None, datetime(2026, 1, 1))]))
    assert sorted(r.delivery_id for r in reader.collect()) == [3, 4], "the version a reader had planned on is gone"
    assert sorted(r.delivery_id for r in store.winners().collect()) == [1, 4]


def test_two_writers(spark, monkeypatch):
    """The second of two that start from one manifest merges anew; nothing is lost."""
    from datetime import datetime

    store, other = delivery.DeliveryStore(spark), None
    other = delivery.DeliveryStore(spark, store.path)
    at = datetime(2026, 1, 1)
    store.merge(messages(spark, [(10, "a", None, at)]))
    publish, between = delivery.DeliveryStore._publish, []

    def late(self, old, new):
        if self is store and not between:
            between.append(other.merge(messages(spark, [(2, "a", None, at), (11, "c", None, at)])))
        return publish(self, old, new)

    monkeypatch.setattr(delivery.DeliveryStore, "_publish", late)
    store.merge(messages(spark, [(5, "a", None, at), (6, "b", None, at)]))
    assert between and sorted(r.delivery_id for r in store.winners().collect()) == [2, 6, 11]
    assert store.index().count() == 3 and store.manifest()["number"] == 3


def test_index_is_cut_and_compacted(spark, monkeypatch):
    from datetime import datetime

    monkeypatch.setattr(delivery, "FILE_ROWS", 10)
    monkeypatch.setattr(delivery, "PIECES", 2)
    store = delivery.DeliveryStore(spark)
    for k in range(6):
        store.merge(messages(spark, [(100 * k + i, f"u{(k * 7 + i) % 90}", None, datetime(2026, 1, 1 + i % 2)) for i in range(25)]))
    seen = {(k * 7 + i) % 90: 0 for k in range(6) for i in range(25)}
    m = store.manifest()
    assert m["buckets"] > 1 and all(len(x) <= 3 for x in m["index"].values())
    assert store.index().select("msg").distinct().count() == store.index().count() == m["rows"] == store.winners().count()
    # a message of url and day: u and its two days
    assert m["rows"] == len({((k * 7 + i) % 90, i % 2) for k in range(6) for i in range(25)}) and len(seen) <= m["rows"]


def test_delivery_of_nothing(spark):
    store = delivery.replay(delivery.DeliveryStore(spark), messages(spark, []))
    assert store.winners().count() == 0


# --- ranking helpers ---------------------------------------------------------------------------------


def test_numbering_and_top_k(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))))
    got = ranks.chunked_row_number(df, ["g"], ["id"], F.floor(F.col("id") / 50), "n")
    want = df.selectExpr("id", "g", "row_number() over (partition by g order by id) - 1 as n")
    assert rows(got.select("id", "g", "n")) == rows(want)
    got = ranks.global_row_number(df, [F.desc("id")], "n", 5)
    assert all(r.id + r.n == 999 for r in got.collect())
    top = ranks.top_k(df, ["g"], [F.desc("id")], 2, F.col("id"))
    assert {(r.g, r.id) for r in top.where("g = 'hot'").collect()} == {("hot", 999), ("hot", 996)}


# --- scoring -----------------------------------------------------------------------------------------


def corpus(spark, n=60):
    words = ["w%d" % i for i in range(8)]
    data = []
    for i in range(n):
        terms = {}
        for p in range(5 + i % 13):
            terms.setdefault(words[(i * 7 + p * p) % 8 if p % 3 else 0], []).append(p)
        data.append((f"doc-{i:03d}", terms, (i * 37 % 100) / 100, None))
    return spark.createDataFrame(data, "external_id string, terms map<string,array<int>>, static_rank double, length int")


def test_bm25_pruned_equals_exhaustive_and_formula(spark, monkeypatch):
    docs = index.assign_doc_ids(index.records(corpus(spark)))
    posts = index.postings(docs)
    q = ranking.query_table(spark, {"a": ["w1", "w3"], "b": ["w0", "w0", "w5"], "none": ["zzz"]})
    full = ranking.bm25_top_k(posts, docs, q, 5)
    for size in (2, 8, 128):
        monkeypatch.setattr(index, "RANGE_DOCS", size)
        cut, stats = ranking.bm25_pruned_top_k(posts, docs, q, 5)
        assert [(r[0], r[1], round(r[2], 9)) for r in rows(cut.select("query_id", "doc_id", "score"))] == [(r[0], r[1], round(r[2], 9)) for r in rows(full.select("query_id", "doc_id", "score"))]
    assert stats.count() == 2
    one = {r["doc_id"]: r for r in docs.collect()}
    avg = sum(r["length"] for r in one.values()) / len(one)
    df = sum("w1" in r["terms"] for r in one.values()), sum("w3" in r["terms"] for r in one.values())
    best = full.where("query_id = 'a' and rank = 1").first()
    d = one[best.doc_id]
    want = sum(math.log(1 + (60 - n + 0.5) / (n + 0.5)) * (tf := len(d["terms"].get(t, []))) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * d["length"] / avg)) for t, n in zip(("w1", "w3"), df) if t in d["terms"])
    assert best.score == pytest.approx(want)


def test_index_edges(spark):
    data = [("a", {"x": [0, 2]}, None, None), ("a", {"x": [0, 2]}, None, None), (None, {"x": [1]}, 1.0, 1), ("b", None, 0.5, None), ("c", {}, 0.5, 9)]
    df = spark.createDataFrame(data, "external_id string, terms map<string,array<int>>, static_rank double, length int")
    docs = index.assign_doc_ids(index.records(df))
    assert rows(docs.select("doc_id", "external_id", "length")) == [(0, "b", 0), (1, "c", 9), (2, "a", 2)]
    assert rows(index.postings(docs).select("doc_id", "term", "tf")) == [(2, "x", 2)]
    empty = index.assign_doc_ids(index.records(df.limit(0)))
    assert empty.count() == 0 and index.dictionary(index.postings(empty)).count() == 0
    with pytest.raises(ValueError):
        index.merge_segments([docs.drop("doc_id").withColumn("analyzer", F.lit(a)) for a in ("x", "y")])
    assert index.should_merge(9, 0, 1) and index.should_merge(1, 3, 10) and not index.should_merge(8, 1, 4)


def test_segment_files(spark):
    from sievework.session import scratch_path
    from sievework.sources import segments

    base = scratch_path(spark, "t")
    recs = index.records(corpus(spark))
    segments.write_segment(recs, base + "/s1", "a1")
    segments.write_segment(recs, base + "/s2", "a2")
    g = segments.Generations(spark, base)
    one = g.publish([base + "/s1"])
    with pytest.raises(ValueError):
        g.publish([base + "/s1", base + "/s2"])
    two = g.publish([base + "/s2"])
    assert two["parent"] == one["id"] and g.rollback()["id"] == one["id"]
    with pytest.raises(FileNotFoundError):
        segments.open_segment(spark, base + "/none")
    segments.write_segment(recs, base + "/s3", "a1", hashes=True)
    assert segments.open_segment(spark, base + "/s3", rows=True)[0]["doc_count"] == recs.count()
    with pytest.raises(ValueError):
        segments.open_segment(spark, base + "/s1", rows=True)
    spark.read.parquet(base + "/s1/dictionary").limit(1).write.mode("append").parquet(base + "/s1/dictionary")
    with pytest.raises(ValueError):
        segments.open_segment(spark, base + "/s1")


def test_index_that_grows(spark):
    """IB-20: add, delete, undelete, replace, merge, publish; what is not published is not searched."""
    from sievework.session import scratch_path
    from sievework.sources import segments

    recs = index.records(corpus(spark))
    ids = lambda x: {r.external_id for r in x.select("external_id").collect()}
    every = ids(recs)
    old, new = recs.where("external_id < 'doc-030'"), recs.where("external_id >= 'doc-030'")
    s = segments.SearchIndex(spark, scratch_path(spark, "grow"), "a1")
    assert not s.maintain()
    s.add(old)
    s.publish()
    s.add(new)
    assert ids(s.docs()) == ids(old), "nothing more is served before it is published"
    s.delete(recs.where("external_id in ('doc-001', 'doc-002', 'doc-040')"))
    s.undelete(recs.where("external_id = 'doc-002'"))
    s.add(recs.where("external_id = 'doc-005'").withColumn("static_rank", F.lit(0.999)))
    s.publish()
    assert ids(s.alive()) == every - {"doc-001", "doc-040"}
    assert s.alive().where("external_id = 'doc-005'").count() == 1 and s.docs().where("external_id = 'doc-005'").count() == 2
    assert s.docs().select("doc_id").distinct().count() == 61
    q = ranking.query_table(spark, {"a": ["w1", "w3"]})
    scores = ranking.scored(s.postings(), s.docs(), q)
    hits = ranking.best(scores.join(s.alive().select("doc_id"), "doc_id", "left_semi"), 5)
    cut = ranking.bm25_pruned_top_k(s.postings(), s.docs(), q, 5)[0]
    assert hits.count() == 5 and rows(cut.select("doc_id")) == rows(ranking.best(scores, 5).select("doc_id"))
    reopened = segments.SearchIndex(spark, s.path, "a1")
    assert not reopened.maintain() and ids(reopened.alive()) == every - {"doc-001", "doc-040"}
    reopened.delete(recs.where("external_id < 'doc-020'"))
    assert reopened.maintain() and len(reopened.segments) == 1
    reopened.publish()
    assert ids(reopened.docs()) == ids(reopened.alive()) == {x for x in every if x >= "doc-020"} - {"doc-040"}


def test_fields_saturate_once(spark):
    stuffed = {f: {"block": [0]} for f in ("title", "headings", "body", "anchors", "url_text")}
    honest = {"body": {"block": [0, 5, 9], "other": [1, 2]}}
    filler = [(f"f{i}", {"body": {"filler": list(range(10))}, "title": {"x": [0]}}) for i in range(30)]
    df = spark.createDataFrame([("stuffed", stuffed), ("honest", honest), *filler], "external_id string, fields map<string,map<string,array<int>>>")
    docs = index.fielded_records(df.withColumns({"static_rank": F.lit(None).cast("double"), "quality": F.lit(None).cast("double"), "pagerank": F.lit(1.0)}))
    posts = index.field_postings(docs)
    lengths = index.field_lengths(posts)
    c = ranking.field_contributions(posts, lengths, index.field_averages(lengths), ranking.query_table(spark, {"q": ["block"]}))
    total = docs.agg(F.count("*").alias("_n"))
    right = {r.external_id: r.score for r in ranking.bm25f_scores(c, posts, total).collect()}
    wrong = {r.external_id: r.score for r in ranking.bm25f_scores(c, posts, total, per_field=True).collect()}
    assert right["stuffed"] / right["honest"] < 2 < wrong["stuffed"] / wrong["honest"]
    boosted = {r.external_id: r.score for r in ranking.with_prior(ranking.bm25f_scores(c, posts, total), docs).collect()}
    assert boosted["honest"] == pytest.approx(right["honest"] + math.log(2))


def test_anchors(spark):
    data = [("t1", "a", "x")] * 500 + [("t2", f"d{i}", "x") for i in range(50)] + [("t3", "a", "x"), ("t3", "a", "x"), ("t3", "b", "x"), ("t3", "b", "y")]
    df = spark.createDataFrame(data, "target string, source_domain string, term string")
    assert rows(ranking.aggregate_anchors(df, 1, 1).select("target", "term", "weight")) == [("t1", "x", 1), ("t2", "x", 50), ("t3", "x", 2), ("t3", "y", 1)]


def test_ndcg(spark):
    ranked = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("r", 9, 1)], "query_id string, doc_id long, rank int")
    judged = spark.createDataFrame([("q", 1, 3.0), ("q", 2, 1.0), ("s", 5, 2.0)], "query_id string, doc_id long, grade double")
    assert {r.query_id: r.ndcg for r in evaluate.ndcg(ranked, judged).collect()} == {"q": 1.0, "r": 0.0, "s": 0.0}


# --- graph -------------------------------------------------------------------------------------------


def test_pagerank_and_components(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c"), ("x", "y"), ("a", "a"), (None, "a")], "s string, t string")
    e = graph.edges_of(edges, "s", "t")
    pr = {r.node: r["rank"] for r in graph.pagerank(e, 30).collect()}
    assert sum(pr.values()) == pytest.approx(1) and max(pr, key=pr.get) == "c"
    trust = {r.node: r["rank"] for r in graph.pagerank(e, 20, seeds=spark.createDataFrame([("x",)], "node string")).collect()}
    assert trust["a"] == 0 and trust["y"] > 0
    cc = {r.node: r.component for r in graph.connected_components(e).collect()}
    assert cc == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    chain = spark.range(200).selectExpr("id as src", "id + 1 as dst")
    assert {r.component for r in graph.connected_components(chain).collect()} == {0}


# --- duplicates --------------------------------------------------------------------------------------


def test_near_duplicates_equal_brute_force(spark):
    import itertools
    import random

    rng = random.Random(1)
    base = [[f"w{rng.randrange(400)}" for _ in range(150)] for _ in range(12)]
    texts = [(n, " ".join(w)) for n, w in enumerate(base)]
    for n, w in enumerate(base):
        v = list(w)
        v[3] = "changed"
        texts += [(100 + n, " ".join(v)), (200 + n, " ".join(w))]
    texts += [(900, None), (901, ""), (902, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    h = {n: dedup.simhash64(t) for n, t in texts}
    got = {r.doc_id: (r.class_id, r.links) for r in dedup.near_duplicate_classes(df, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    near = lambda a, b: h[a] is not None and h[b] is not None and bin((h[a] ^ h[b]) & (2**64 - 1)).count("1") <= 3
    for a, b in itertools.combinations(got, 2):
        if near(a, b):
            assert got[a][0] == got[b][0]
    one = spark.createDataFrame([(n, x) for n, x in {v: k for k, v in h.items() if v is not None}.items()], "simhash long, doc_id long")
    pairs = {(r.a, r.b) for r in dedup.near_pairs(one, "doc_id").collect()}
    ids = sorted(r.doc_id for r in one.collect())
    assert pairs == {(a, b) for a, b in itertools.combinations(ids, 2) if near(a, b)}


def test_wide_bands_lose_no_pair(spark):
    import itertools
    import random

    rng = random.Random(3)
    centre = rng.getrandbits(48)
    hashes = {n: ((centre ^ sum(1 << rng.randrange(48) for _ in range(rng.randrange(5)))) << 16 | 0xBEEF) for n in range(150)}
    hashes = {n: v for n, v in {v: k for k, v in hashes.items()}.items()}
    df = spark.createDataFrame([(n, v - 2**64 if v >= 2**63 else v) for v, n in hashes.items()], "doc_id long, simhash long")
    got = {(r.a, r.b) for r in dedup.near_pairs(df, "doc_id").collect()}
    by = {n: v for v, n in hashes.items()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(by), 2) if bin(by[a] ^ by[b]).count("1") <= 3}


def test_election(spark):
    df = spark.createDataFrame([(1, 1, 10.0, True), (1, 2, 11.0, False), (2, 3, 10.0, True), (2, 4, 12.0, False), (3, 5, 1.0, False), (3, 6, 1.0, False)], "c long, id long, score double, held boolean")
    assert rows(dedup.elect(df, "c", "id", "score", "held")) == [(1, 1), (2, 4), (3, 5)]


# --- crawl -------------------------------------------------------------------------------------------


def test_seen_filter_and_budget(spark):
    offers = spark.createDataFrame([("k1", 1, "d"), ("k1", 2, "d"), ("k2", 3, "d"), (None, 4, "d"), ("k3", 5, "e")], "key string, ord long, domain string")
    seen = spark.createDataFrame([("k2",), (None,)], "key string")
    assert rows(crawl.filter_new(offers, seen)) == [("k1", 1, 2), ("k3", 5, 1)]
    budgets = spark.createDataFrame([("d", 2), ("e", -1)], "domain string, left long")
    assert sorted(r.ord for r in crawl.admit_within_budget(offers, budgets).collect()) == [1, 2]
    assert spark.range(1).select(crawl.budget_limit(F.lit(0.0))).first()[0] == 346
    bits, k = crawl.bloom_params(1000, 0.01)
    assert 9 < bits / 1000 < 10 and k == 7


def test_traps(spark):
    bad = [(f"https://t.test/calendar/{i}", "same") for i in range(120)]
    good = [(f"https://g.test/posts/{i}", f"h{i}") for i in range(120)]
    df = spark.createDataFrame(bad + good + [(None, "x"), ("https://t.test/a", None)], "url string, content_hash string")
    traps = crawl.trap_prefixes(df, 50)
    assert {r.prefix for r in traps.collect()} == {"t.test/calendar", "t.test/calendar/*"}
    assert {r.prefix for r in crawl.shallowest_trap(df.where("url is not null"), traps).collect()} == {"t.test/calendar"}


def test_folds(spark):
    data = [("d", i, "ok") for i in range(10)] + [("d", 10, "err"), ("d", 11, "slow"), ("e", 0, "none"), (None, 1, "ok")]
    got = {(r.domain, r.ord): r.rate for r in crawl.aimd_fold(spark.createDataFrame(data, "domain string, ord long, signal string")).collect()}
    assert got["d", 9] == 1.25 and got["d", 10] == 0.625 and got["d", 11] == pytest.approx(0.46875) and got["e", 0] == 1.0 and len(got) == 13
    req = spark.createDataFrame([("d", 1, 0), ("d", 2, 0), ("d", 3, 0), ("d", 4, 1000)], "domain string, ord long, at_ms long")
    got = {r.ord: (r.allowed, r.wait_ms) for r in crawl.token_bucket_fold(req).collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (False, 1000), 4: (True, 0)}


def test_outcomes(spark):
    data = [(200, 10, "fetched"), (200, 1 << 30, "too_large"), (304, 0, "not_modified"), (429, 0, "throttled"), (410, 0, "gone"), (403, 0, "client_error"), (500, 0, "server_error"), (301, 0, "redirected"), (None, 0, None)]
    df = spark.createDataFrame(data, "status int, size long, want string")
    assert all(r.got == r.want for r in df.withColumn("got", crawl.classify_status(F.col("status"), F.col("size"))).collect())
    step = lambda o, n, ra=None: spark.range(1).select(crawl.next_step(F.lit(o), F.lit(n), F.lit(ra).cast("double"), F.lit(False)).alias("s")).first().s
    assert tuple(step("server_error", 2)) == ("requeue", 120.0) and tuple(step("server_error", 3)) == ("give_up", None)
    assert tuple(step("throttled", 0, 9999.0)) == ("requeue", 300.0) and tuple(step("timeout", 1)) == ("requeue", 60.0)
    df = spark.createDataFrame([("120",), ("Wed, 21 Oct 2026 07:28:10 GMT",), ("soon",), (None,)], "v string")
    got = [r[0] for r in df.select(crawl.retry_after_seconds(F.col("v"), F.lit("2026-10-21 07:28:00").cast("timestamp"))).collect()]
    assert got == [120.0, 10.0, None, None]


def test_redirects(spark):
    data = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("s", "s"), (None, "a"), ("n", None)] + [(f"l{i}", f"l{i + 1}") for i in range(9)]
    got = {r.url: (r.final_url, r.outcome) for r in crawl.follow_redirects(spark.createDataFrame(data, "url string, target string")).collect()}
    assert got["a"] == ("c", "resolved") and got["b"] == ("c", "resolved") and got["x"][1] == "loop" and got["s"][1] == "loop" and got["l0"][1] == "too_many" and got["l6"] == ("l9", "resolved")


def test_monitor(spark):
    df = spark.createDataFrame([("r1", "start", 1), ("r1", "finish", 2), ("r2", "start", 2), ("r3", "start", 9)], "request_id string, kind string, ts int")
    assert [r.request_id for r in monitor.in_flight_at(df, 5).collect()] == ["r2"]
    got = spark.createDataFrame([(0.5,), (0.75,), (0.85,), (0.92,), (0.99,)], "u double").select(monitor.ladder_rung(F.col("u"))).collect()
    assert [r[0] for r in got] == [0, 1, 2, 3, 4]


def test_knn_equals_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(200, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "vec_id long, embedding array<float>")
    q = df.where("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")
    got = {}
    for r in ranking.cosine_knn(df, q, 5).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for n, found in got.items():
        order = np.argsort(-(u @ u[n]))
        assert found == set(order[1:6])


def test_clicks_and_queries():
    assert ranking.validate_query("a b") == ["a", "b"]
    for bad in ("x" * 513, " ".join("abc" * 20), "*a"):
        with pytest.raises(ValueError):
            ranking.validate_query(bad if bad != " ".join("abc" * 20) else "a " * 33)


def test_cells_equal_windows(spark):
    import random

    from pyspark.sql import Window

    rng = random.Random(4)
    data = [(i, rng.choice(["hot", "hot", "a", None]), rng.randrange(5000), rng.choice([None, 1, 2, 3])) for i in range(900)]
    df = spark.createDataFrame(data, "event_id long, k string, ts long, v int")
    cell = F.floor(F.col("ts") / 100)
    w = Window.partitionBy("k").orderBy("ts", "event_id")
    for ahead, want in ((False, F.lag("event_id").over(w)), (True, F.lead("event_id").over(w))):
        got = ranks.chunked_neighbour(df, ["k"], ["ts", "event_id"], cell, ["event_id"], "n", ahead).select("event_id", F.col("n.event_id").alias("n"))
        assert rows(got.na.fill(-1)) == rows(df.select("event_id", want.alias("n")).na.fill(-1))
    got = ranks.chunked_last(df, ["k"], ["ts", "event_id"], cell, F.col("v"), "n").select("event_id", "n")
    assert rows(got.na.fill(-1)) == rows(df.select("event_id", F.last("v", ignorenulls=True).over(w).alias("n")).na.fill(-1))
    got = ranks.chunked_sum(df, ["k"], ["ts", "event_id"], cell, F.coalesce("v", F.lit(0)), "n").select("event_id", "n")
    assert rows(got) == rows(df.select("event_id", F.sum(F.coalesce("v", F.lit(0))).over(w).alias("n")))


def test_rates_in_cuts_equal_one_fold(spark):
    import random

    rng = random.Random(11)
    data = [(rng.choice(["hot", "hot", "hot", "a", "b"]), i, rng.choice(["ok"] * 12 + ["slow", "err", "none"])) for i in range(2500)] + [(None, 9999, "ok")]
    df = spark.createDataFrame(data, "domain string, ord long, signal string")
    whole, cut = crawl.aimd_fold(df), crawl.aimd_fold(df, chunk=64)
    state, want = {}, []
    for d, o, s in data[:-1]:
        state[d] = crawl.aimd_step(*state.get(d, (1.0, 0)), s, **{k: crawl.AIMD[k] for k in ("low", "high", "add", "times", "streak")})
        want.append((d, o, *state[d]))
    for made in (whole, cut):
        got = sorted(map(tuple, made.select("domain", "ord", "rate", "streak").collect()))
        assert len(got) == 2500 and all(a[:2] == b[:2] and a[3] == b[3] and abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, sorted(want)))


# --- frontier ----------------------------------------------------------------------------------------


def test_frontier_admission(spark):
    from sievework.operators import frontier

    offers = spark.createDataFrame(
        [("k1", "a", "https://a.test/x/1", 1), ("k1", "a", "https://a.test/x/1", 2), ("k2", "a", "https://a.test/x/2", 3), ("k3", "a", "https://a.test/bad/3", 4), ("k4", "a", "https://a.test/x/4", 5), ("k5", "b", "https://b.test/q", 6), (None, "b", "x", 7), ("k6", None, "x", 8), ("k7", "b", "https://b.test/r", 9), ("k8", "c", "https://c.test/r", 10)],
        "key string, domain string, url string, ord bigint",
    )
    traps = spark.createDataFrame([("a.test/bad",), ("b.test/r",)], "prefix string")
    free = spark.createDataFrame([("b.test/r",)], "prefix string")
    budgets = spark.createDataFrame([("a", 3), ("b", 9), ("c", -2)], "domain string, left bigint")
    seen = spark.createDataFrame([("k5",)], "key string")
    held = frontier.demoted(traps, spark.createDataFrame([("c.test/none",)], "prefix string"), free)
    assert rows(held) == [("a.test/bad",), ("c.test/none",)]
    got = frontier.add_many(offers, held, budgets, seen)
    assert rows(got) == [("a", "k1", 1, 0), ("a", "k2", 3, 1), ("b", "k7", 9, 0)], "k4 is the fourth claim on a budget of three"
    assert rows(frontier.add_many(offers, held, budgets, seen, spark.createDataFrame([("k1",)], "key string"), cap=1)) == [("a", "k2", 3, 0), ("b", "k7", 9, 0)]
    assert rows(frontier.spend(got)) == [("a", 2), ("b", 1)]
    assert frontier.add_one(spark, "https://a.test/new", "kn", "a", held, budgets, seen) and not frontier.add_one(spark, "https://a.test/bad/n", "kn", "a", held, budgets, seen)
    assert frontier.add_many(offers.limit(0), held, budgets, seen).count() == 0
    with pytest.raises(ValueError):
        frontier.valid_agent("bot/1.0")
    assert frontier.valid_agent("bot/1.0 (+https://x.test/bot)")


def test_pauses_and_paired_buckets(spark):
    from sievework.operators import frontier

    f = spark.createDataFrame(
        [("a", 1, 0, "throttled", 10.0), ("a", 2, 4000, "fetched", None), ("a", 3, 10_000, "fetched", None), ("a", 4, 299_000, "throttled", 900.0), ("a", 5, 598_000, "fetched", None), ("b", 6, 5000, "fetched", None), (None, 7, 1, "throttled", None), ("c", 8, 0, "throttled", None), ("c", 9, 59_999, "fetched", None)],
        "domain string, ord bigint, at_ms bigint, outcome string, retry_after_s double",
    )
    assert {r.ord: r.paused_ms for r in frontier.paused(f).collect() if r.paused_ms} == {2: 6000, 5: 1000, 9: 1}
    reqs = [("ip", d, n, t, 0) for n, (d, t) in enumerate([("a", 0), ("a", 0), ("a", 0), ("b", 0), ("b", 0), ("c", 0), ("c", 0), ("d", 0), ("a", 1000)])] + [("ip", "e", 50, 1000, 7)]
    df = spark.createDataFrame(reqs, "address string, domain string, ord bigint, at_ms bigint, paused_ms bigint")
    got = {r.ord: (r.allowed, r.wait_ms, r.reason) for r in frontier.paired_buckets(df).collect()}
    # two of a domain, six of an address
    assert got[2] == (False, 1000, "domain") and got[7] == (False, 334, "ip") and got[8] == (True, 0, "") and got[50] == (False, 7, "paused")
    assert [got[n][0] for n in (0, 1, 3, 4, 5, 6)] == [True] * 6


# --- rules and stores --------------------------------------------------------------------------------


def test_bloom_table(spark):
    from sievework.operators import bloom

    seen = spark.createDataFrame([(f"k{i}",) for i in range(300)] + [(None,)], "key string")
    offers = spark.createDataFrame([(f"k{i}",) for i in range(200, 900)] * 2 + [(None,)], "key string")
    r = bloom.seen_stats(offers, seen, error=0.05).first()
    assert (r.checked, r.unique_keys, r.already_seen) == (1400, 700, 100) and r.bloom_skipped + r.exact_consulted == 700 and 0 <= r.false_positives < 80
    assert {x[0] for x in bloom.new_keys(offers, seen).collect()} == {f"k{i}" for i in range(300, 900)}
    assert bloom.seen_stats(offers, seen.limit(0)).first().already_seen == 0 and bloom.new_keys(offers.limit(0), seen).count() == 0


def test_document_store_and_archive(spark):
    from datetime import datetime

    from sievework.session import scratch_path
    from sievework.sources import blobs

    store = blobs.DocumentStore(spark, scratch_path(spark, "d"), buckets=4)
    docs = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x"), (None, 1, "y")], "url string, at int, text string")
    store.write(docs, "url", "at")
    assert rows(store.read().select("url", "text")) == [("a", "new"), ("b", "x")]
    assert rows(store.read(spark.createDataFrame([("a",), ("zz",)], "url string")).select("text")) == [("new",)]
    path = scratch_path(spark, "arch")
    blobs.write_archive(spark.createDataFrame([(i, datetime(2026, 1, 1 + i % 3)) for i in range(30)], "n int, fetched_at timestamp"), path, 4)
    assert blobs.expire_archive(spark, path, "2026-01-02") == ["2026-01-01"]
    index_ = blobs.archive_index(spark, path, "n")
    assert index_.count() == 20 and index_.select("dt", "file", "row").distinct().count() == 20


def test_conditional_searches(spark):
    from sievework.operators import retrieval

    docs = spark.createDataFrame([(1, "The old town library is open. A museum! Nothing here."), (2, "library town the old"), (3, None), (4, ""), (5, "museum " * 40 + "library")], "doc_id long, text string")
    posts = retrieval.text_postings(docs)
    assert rows(retrieval.phrases(posts, ["the", "old", "town", "library"])) == [(1, 1)]
    assert rows(retrieval.phrases(posts, ["the", "library"], slop=2)) == [(1, 1)] and retrieval.phrases(posts, ["the", "nowhere"]).count() == 0
    d = retrieval.dependence(posts, ["old", "town", "library"]).collect()
    assert {r.doc_id: (r.unigrams, r.ordered, r.unordered) for r in d} == {1: (3, 2, 2), 2: (3, 0, 2)}
    got = {r.doc_id: (r.s.sentence, r.s.score) for r in docs.select("doc_id", retrieval.ranked_snippet(F.col("text"), ["library", "museum"]).alias("s")).collect() if r.s}
    assert got[1][0] == "The old town library is open." and got[1][1] == 0.5
    fields = spark.createDataFrame([("x", "One two", " "), ("y", None, "two two")], "id string, title string, body string")
    made = {(r.id, r.field): r.terms for r in retrieval.fielded_texts(fields, "id", ["title", "body"]).collect()}
    assert made == {("x", "title"): {"one": [0], "two": [1]}, ("y", "body"): {"two": [0, 1]}}
    lang = spark.createDataFrame([(10, "en", "de", 0.9), (50, "en", "de", 0.9), (50, "en", "de", 0.5), (50, None, None, None), (50, "de", "de", 0.7)], "n int, a string, m string, c double")
    got = [tuple(r[0]) for r in lang.select(retrieval.choose_language(F.col("n"), F.col("a"), F.col("m"), F.col("c"))).collect()]
    assert got == [("en", 0.25, "attribute", False), ("de", 0.9, "model", True), ("en", 0.25, "attribute", False), ("und", 0.0, "none", False), ("de", 0.7, "model", False)]


def test_page_inspection(tmp_path, spark):
    from sievework.sources import topics

    (tmp_path / "p.html").write_text("<html lang=en><title>Ti</title><body><p>some words of text</p><a href=/x>link here</a>")
    seen = topics.inspect_page(str(tmp_path / "p.html"), "https://a.test/")
    assert seen["title"] == "Ti" and seen["links"] == 1 and seen["encoding"] == "utf-8" and seen["warning"] is None


def test_scratch_is_released():
    """On a stand-in: paths of one application only."""
    from types import SimpleNamespace

    from sievework import session

    gone, context = [], SimpleNamespace(applicationId="app-x")
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: "file:///tmp/none"))
    keep, session.delete_path = session.delete_path, lambda spark, path: gone.append(path)
    try:
        made = [session.scratch_path(fake, "a"), session.scratch_path(fake, "b")]
        assert session.release_scratch(fake) == 2 and gone == made and session.release_scratch(fake) == 0
    finally:
        session.delete_path = keep


def test_a_cluster_names_its_folder():
    from types import SimpleNamespace

    from sievework import session

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master="spark://x:7077", applicationId="a", getConf=lambda: SimpleNamespace(get=lambda k: None)))
    with pytest.raises(RuntimeError):
        session.shared_dir(fake)
