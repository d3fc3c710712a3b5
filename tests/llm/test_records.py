"""Problems 3, 7, 8, 9 and 10 on small tables."""

import math
import random
import string
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.functions.urls import url_key
from sievework.llm import distinct, leak, loops, mix, seen


def ids(df, c):
    return sorted(r[c] for r in df.collect())


# --- 3 -----------------------------------------------------------------------------------------------


def offers(spark, data):
    return spark.createDataFrame([(i, k, 5, "clash", True) for i, k in data], "task_id long, url string, _id int, _key string, _seen boolean")


def brute(data, key_of=lambda x: x):
    first, out = {}, []
    for i, k in sorted((x for x in data if x[0] is not None), key=lambda x: x[0]):
        key = None if k is None else key_of(k)
        if key is None:
            continue
        if key in first and first[key] < i:
            out.append(i)
        first.setdefault(key, i)
    return sorted(out)


@pytest.mark.parametrize("capacity", [8, 1 << 14])
def test_seen_equals_brute_force(spark, capacity):
    rng = random.Random(2)
    data = [(i, f"k{rng.randrange(700)}" if i % 3 else "hot") for i in range(3000)]
    rng.shuffle(data)
    data += [(None, "hot"), (5000, None), (5001, None), (5002, "")]
    df = offers(spark, data).repartition(5)
    assert ids(seen.repeated(df, "task_id", "url", capacity=capacity), "task_id") == brute(data)
    assert ids(seen.confirmed(seen.seen_before(df, "task_id", "url", capacity=capacity)), "_id") == brute(data)


@pytest.fixture
def small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "100")
    yield
    spark.conf.unset(name)


def test_the_chain_answers(spark, small_batches):
    """Its wrong answers are in the rows, are counted, and only the exact check takes them out; nothing is missed."""
    data = [(i, f"k{i if i % 4 else i - 7}") for i in range(4000)]
    df = offers(spark, data)
    answers = seen.seen_before(df, "task_id", "url", shards=2, capacity=64, error=0.05, growth=2)
    got, want = set(ids(answers.where("_seen"), "_id")), set(brute(data))
    wrong = got - want
    assert want <= got and 0 < len(wrong) < 0.1 * 4000
    assert ids(seen.confirmed(answers), "_id") == brute(data)
    report = seen.wrong_answers(answers).collect()
    assert sum(r.wrongly_seen for r in report) == len(wrong) and sum(r.missed for r in report) == 0
    assert sum(r.distinct_keys for r in report) == len({k for _, k in data}) and {r.shard for r in report} == {0, 1}
    assert all(r.layers > 3 and r.bound == 0.1 and r.rate_measured <= r.bound for r in report)


def test_without_memory_nothing_is_seen():
    class Forgetful(seen.BloomChain):
        def add(self, h1, h2):
            pass

    assert not Forgetful().pass_batch(np.arange(9, dtype=np.uint64), np.ones(9, np.uint64)).any()


def test_hot_keys_stop_before_the_shuffle(spark):
    """A key that gets hot late does so too."""
    data = [(i, f"pair{i // 2}") for i in range(40_000)] + [(i, "hot" if i % 2 else f"k{i}") for i in range(40_000, 80_000)]
    df = offers(spark, data).coalesce(1)
    sent = seen.seen_before(df, "task_id", "url", shards=3).where("not _known")
    assert sent.groupBy("_h1").count().agg(F.max("count")).first()[0] < 100
    assert ids(seen.repeated(df, "task_id", "url", shards=3), "task_id") == brute(data)


def test_frequent_table():
    t = seen.Frequent(size=8)
    h = np.arange(1, 7, dtype=np.uint64)
    t.take(h, h + np.uint64(100), np.arange(6), np.array([2, 9, 2, 9, 2, 9]))
    assert list(t.find(np.array([2, 2, 99], np.uint64), np.array([102, 7, 1], np.uint64))) == [1, -1, -1]
    t.take(h + np.uint64(50), h, np.arange(6), np.full(6, 5))
    assert len(t.h1) == 4 and set(t.h1[t.count == 4]) == {2, 4, 6}


def test_seen_addresses(spark):
    data = [(1, "http://a.test/x?b=2&a=1"), (2, "http://A.test:80/x?a=1&b=2#f"), (3, "http://[bad"), (4, "http://[bad"), (5, "https://a.test/x?a=1&b=2"), (6, None), (2, "http://a.test/x?a=1&b=2")]
    assert ids(seen.repeated(offers(spark, data), "task_id", "url", url_key), "task_id") == [2, 2]
    assert seen.repeated(offers(spark, []), "task_id", "url").count() == 0
    big = [(i, "u" * 100_000 + str(i % 2)) for i in range(4)]
    assert ids(seen.repeated(offers(spark, big), "task_id", "url"), "task_id") == [2, 3]


def test_chain_keeps_its_bound():
    chain = seen.BloomChain(capacity=500, error=0.01, growth=2, tightening=0.5)
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, (2, 20_000)).astype(np.uint64)
    for a in range(0, 20_000, 1000):
        chain.pass_batch(h[0, a : a + 1000], h[1, a : a + 1000] | np.uint64(1))
    assert len(chain.layers) > 4 and chain.wrong_rate() <= chain.bound() == 0.02
    assert chain.contains(h[0], h[1] | np.uint64(1)).all(), "a key was forgotten"
    other = rng.integers(0, 2**63, (2, 50_000)).astype(np.uint64)
    assert chain.contains(other[0], other[1] | np.uint64(1)).mean() < 0.03


# --- 7 -----------------------------------------------------------------------------------------------


def test_distinctive_terms(spark):
    data = [(f"d{i}", {"the": list(range(5)), "mid": [1] if i % 2 else [1, 2], f"own{i}": [3]}) for i in range(40)]
    data[7][1]["rare"] = [1, 2, 3, 4, 5, 6]
    data[8][1]["rare"] = [9]
    data += [data[7], (None, {"x": [1, 2]}), ("none", None), ("empty", {}), ("odd", {"solo": None, "pair": [1, 1, 1]})]
    df = spark.createDataFrame([(*r, 1, 0.5) for r in data], "external_id string, terms map<string,array<int>>, tf int, score double")
    terms = distinct.record_terms(df, "external_id", distinct.term_counts(F.col("terms")))
    scored = {(r["_id"], r.term): r for r in distinct.scored_terms(terms).collect()}
    docs = {i: Counter({t: max(1, len(p or [])) for t, p in m.items()}) for i, m in data if i and m}
    n, df_, cf = len(docs), Counter(), Counter()
    for c in docs.values():
        df_.update(c.keys())
        cf.update(c)
    assert len(scored) == sum(map(len, docs.values()))
    for (i, t), r in scored.items():
        want = docs[i][t] * (-math.log2(df_[t] / n) + math.log2(-math.expm1(-cf[t] / n)))
        assert r.score == pytest.approx(want) and r.df == df_[t] and r.cf == cf[t]
    best = {r["_id"]: r.term for r in distinct.most_distinctive(distinct.scored_terms(terms)).collect()}
    assert best["d7"] == "rare" and best["odd"] == "pair" and "none" not in best and "empty" not in best
    two = distinct.most_distinctive(distinct.scored_terms(terms), 2)
    assert two.groupBy("_id").count().agg(F.max("count")).first()[0] == 2


def test_distinctive_fields_and_nothing(spark):
    df = spark.createDataFrame([("a", {"title": {"x": [1]}, "body": {"x": [1, 2], "y": [3]}, "none": None}), ("b", {}), ("c", None)], "external_id string, fields map<string,map<string,array<int>>>")
    got = {(r["_id"], r.term): r.tf for r in distinct.record_terms(df, "external_id", distinct.field_counts(F.col("fields"))).collect()}
    assert got == {("a", "x"): 3, ("a", "y"): 1}
    assert distinct.scored_terms(distinct.record_terms(df.limit(0), "external_id", distinct.field_counts(F.col("fields")))).count() == 0


def test_ties_go_to_the_smaller_term(spark):
    df = spark.createDataFrame([("a", {"q": [1, 2], "p": [1, 2]}), ("b", {"r": [1]})], "external_id string, terms map<string,array<int>>")
    best = distinct.most_distinctive(distinct.scored_terms(distinct.record_terms(df, "external_id", distinct.term_counts(F.col("terms")))))
    assert {r["_id"]: r.term for r in best.collect()}["a"] == "p"


# --- 8 -----------------------------------------------------------------------------------------------


def words_of(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(2, 9))) for _ in range(n)]


FRAME = "Read the passage and answer the question that follows."


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, f"{FRAME}\n\n{' '.join(words_of(1, 50))}"), (2, f"{FRAME} {' '.join(words_of(2, 40))}"), (3, " ".join(words_of(3, 60))), (4, None), (5, ""), (None, "x y z"), (6, "two words"), (3, " ".join(words_of(3, 60)))]
    return spark.createDataFrame([(i, t, "doc", 1) for i, t in rows], "item_id long, text string, _doc string, doc_id int")


def test_leaks(spark, items):
    w1, w3, fill = words_of(1, 50), words_of(3, 60), words_of(9, 300)
    changed = [x if i % 9 else "changed" for i, x in enumerate(w3)]
    rows = {
        10: " ".join(fill[:40] + w1 + fill[40:90]),
        11: " ".join(x.upper() for x in w1).replace(" ", ",  <b>") + "</b>",
        12: " ".join(fill[:20] + w1[:28] + fill[30:60]),
        13: " ".join(fill[:20] + w1[:18] + fill[30:60]),
        14: " ".join(fill[:5] + changed + fill[5:9]),
        15: " ".join(w3[:20] + fill[:30] + w3[25:45]),
        16: FRAME + " " + " ".join(fill),
        17: " ".join(random.Random(4).sample(w1, 50)),
        18: None,
        19: "",
        20: " ".join(fill * 300 + w3),
        21: " ".join(w3[40:] + fill[:40] + w3[:15]),
    }
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows.items()] + [(10, rows[10], 1, "x"), (None, rows[10], 1, "x")], "doc_id long, text string, _item int, _words string")
    got = {(r.doc_id, r.item_id) for r in leak.leaked(leak.leaks(docs, items)).collect()}
    assert got == {(10, 1), (11, 1), (12, 1), (14, 3), (15, 3), (20, 3)}
    none = leak.leaks(docs.limit(0), items)
    assert none.count() == 0 and leak.leaks(docs, items.limit(0)).count() == 0


def test_winnowing_guarantee():
    rng = random.Random(5)
    for _ in range(200):
        span = [rng.randrange(2**60) for _ in range(leak.GRAM + leak.WINDOW - 1)]
        a = [rng.randrange(2**60) for _ in range(rng.randrange(20))] + span + [rng.randrange(2**60) for _ in range(rng.randrange(20))]
        b = span + [rng.randrange(2**60) for _ in range(rng.randrange(9))]
        prints = []
        for x in (a, b):
            g = leak.gram_hashes(np.array(x, np.uint64))
            prints.append({int(v) for v in g[leak.winnow(g)]})
        assert prints[0] & prints[1]


def test_blocks_of_items(spark, items, monkeypatch):
    monkeypatch.setattr(leak, "BLOCK_WORDS", 40)
    docs = spark.createDataFrame([(1, " ".join(words_of(1, 50))), (2, " ".join(words_of(3, 60)))], "doc_id long, text string")
    assert sorted(tuple(r) for r in leak.leaked(leak.leaks(docs, items)).collect()) == [(1, 1), (2, 3)]


def test_repeated_common_and_short_items(spark):
    w, fill = words_of(21, 40), words_of(22, 200)
    items = [(i, " ".join(w)) for i in range(5)]  # the same item five times
    items += [(10 + i, " ".join(w[:30] + words_of(30 + i, 10))) for i in range(6)]  # a passage that eleven items carry
    items += [(50, "zwei worte"), (51, "einzig"), (52, " ".join(w[35:39])), (53, "drei kurze worte")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = {1: " ".join(fill[:50] + w + fill[50:]), 2: " ".join(fill[:9] + w[:30]), 3: " ".join(fill[:60] + ["Zwei", "Worte"] + fill[60:]), 4: "worte zwei", 5: "das ist einzig", 6: " ".join(fill[:31] + w[35:39] + fill[31:77]), 7: "a drei kurze worte b"}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leak.leaked(leak.leaks(docs, table)).collect()}
    carried = {*range(5), *range(10, 16)}
    want = {(1, i) for i in carried} | {(2, i) for i in carried} | {(1, 52), (3, 50), (5, 51), (6, 52), (7, 53)}
    assert got == want


def covered_brute(pieces):
    """Best chain over all subsets of (a, b, c, d, places)."""
    best = 0
    for mask in range(1 << len(pieces)):
        own = sorted((p for k, p in enumerate(pieces) if mask >> k & 1), key=lambda p: (p[2], p[0]))
        if all(x[3] <= y[2] and x[1] <= y[0] for x, y in zip(own, own[1:])):
            best = max(best, sum(len(p[4]) for p in own))
    return best


def test_chain_of_pieces():
    rng = random.Random(3)
    item = list(range(100, 140))
    for _ in range(60):
        parts = [(a, min(40, a + rng.randrange(4, 12))) for a in (rng.randrange(36) for _ in range(rng.randrange(1, 6)))]
        doc, hits, at = [], [], []
        for a, b in parts:
            doc += [1000 + len(doc) + k for k in range(20)]
            at.append((a, b, len(doc), len(doc) + b - a, list(range(a, b))))
            hits.append((a, len(doc)))
            doc += item[a:b]
        got = leak.covered_words(item, doc, hits)
        assert covered_brute(at) <= got <= 40
    many = (item + [7] * 20) * 2000
    assert leak.covered_words(item, many, [(0, 60 * k) for k in range(2000)]) == 40


# --- 9 -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sources(spark):
    rng = random.Random(8)
    rows = []
    for n in range(900):
        s = "big" if n % 3 else ("mid" if n % 2 else "small" if n % 5 == 0 else "unlisted")
        rows.append((n, " ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(1, 60))), s))
    rows += [(2000, None, "big"), (2001, "", "big"), (2002, "lost", None), (None, "no id", "big"), (5, "repeated", "big")]
    docs = spark.createDataFrame([(*r, 7, 1) for r in rows], "doc_id long, text string, source string, tokens int, slot int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 3), ("absent", 0.1, 2), ("null", None, 1), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_mix(spark, sources):
    docs, targets = sources
    block = 64
    made, report = mix.mixture(docs, targets, block)
    rows = made.collect()
    per_slot = Counter()
    for r in rows:
        per_slot[r.slot] += r.piece_tokens
    assert set(per_slot.values()) == {block}
    r = {x.source: x for x in report.collect()}
    slots = len(per_slot)
    for s in ("big", "mid", "small"):
        assert abs(r[s].actual_share - r[s].planned_share) <= 3 / slots and r[s].rounds <= r[s].max_repeats
    assert r["absent"].tokens_used == 0 and r["big"].planned_share == pytest.approx(0.5 / 0.9, abs=1e-6)
    # no token of a document is used more often than its source may be repeated
    used = Counter()
    for x in rows:
        for t in range(x.first_token, x.first_token + x.piece_tokens):
            used[x.source, x.doc_id, t] += 1
    caps = {"big": 1, "mid": 2, "small": 3}
    assert all(n <= caps[s] + (s == "big" and d in (None, 5)) for (s, d, _), n in used.items())
    # every prefix is near the targets
    order = {x.slot: x.source for x in rows}
    for upto in range(20, slots, 7):
        assert abs(sum(order[k] == "big" for k in range(upto)) / upto - 0.5 / 0.9) < 0.1


def test_kept_finds_what_is_not(spark):
    shares = spark.createDataFrame([("a", 0.5, 0.9, 100, 3, 2), ("b", 0.5, 0.5, 100, 1, 1)], "source string, planned_share double, actual_share double, tokens_used bigint, rounds int, max_repeats int")
    made = spark.createDataFrame([(0, "a", 7), (1, "a", 8), (2, "b", 5), (2, "b", 3), (3, "b", 4)], "slot bigint, source string, piece_tokens bigint")
    got = {r.source: (r.share_kept, r.cap_kept, r.blocks_whole) for r in mix.kept(made, shares, 8).collect()}
    assert got == {"a": (False, False, False), "b": (True, True, True)}


def test_mix_of_nothing_and_too_much(spark, sources):
    docs, targets = sources
    made, report = mix.mixture(docs.limit(0), targets)
    assert made.count() == 0 and report.count() == 4
    made, report = mix.mixture(docs, targets, 64, total_tokens=10**6)
    assert all(x.rounds <= x.max_repeats for x in report.collect())


# --- 10 ----------------------------------------------------------------------------------------------


def share(text):
    tokens, run, _ = loops.units(text)
    seen_, hit = set(), [False] * len(tokens)
    for i in range(len(tokens) - run + 1):
        g = tuple(tokens[i : i + run])
        if g in seen_:
            hit[i : i + run] = [True] * run
        seen_.add(g)
    return sum(hit) / len(tokens) if tokens else 0.0


def test_repeated_share():
    rng = random.Random(6)
    for _ in range(100):
        w = [rng.choice("abcdefg") for _ in range(rng.randrange(60))]
        assert loops.repeated_share(w, 5) == pytest.approx(share(" ".join(w)))
    assert loops.repeated_share(["a"] * 10, 5) == 0.9 and loops.repeated_share([], 5) == 0 and loops.repeated_share(["a"] * 5, 5) == 0


def loop_rows():
    rng = random.Random(7)
    rows = []
    for n in range(300):
        fresh = words_of(n, rng.randrange(20, 400))
        kind = n % 4
        if kind == 0:
            text = " ".join(fresh)
        elif kind == 1:
            text = " ".join(fresh * rng.randrange(3, 6))
        elif kind == 2:
            k = rng.randrange(6, 12)
            text = ". ".join(" ".join(fresh[:k]) + f" {i}" for i in range(rng.randrange(8, 40)))
        else:
            text = " ".join(fresh + fresh[: len(fresh) // 4])
        rows.append((n, text))
    return rows


#: The words of words_of are drawn letter by letter: no vocabulary, hardly compressible.
RANDOM_WORDS = ((80, 0.75), (1000, 0.66), (10000, 0.62))


def test_bands_decide(spark):
    ja = "今日は天気がとても良いので公園へ行きました。"
    rows = loop_rows()
    edge = [(900, ja * 6), (901, ja + "明日は雨が降るでしょうから家で本を読みます。"), (902, None), (903, ""), (904, "12 34 !!"), (905, "one two three four five"), (906, " ".join(words_of(1, 30) * 2000)), (907, "ab cd ef gh ij " * 3), (None, "x")]
    df = spark.createDataFrame([(*r, 1.0, "b") for r in rows + edge], "doc_id long, text string, zstd_ratio double, band string")
    got = {r.doc_id: r for r in loops.repetition(df, ordinary=RANDOM_WORDS).collect()}
    assert len(got) == len(rows) + len(edge)
    for n, text in rows:
        want = share(text)
        assert want < 0.45 or want > 0.55
        assert got[n].repeated_share == pytest.approx(want) and got[n].repetitive == (want > 0.5), (n, got[n])
    assert got[900].repetitive and not got[901].repetitive and got[902].band == "short" and got[906].repetitive and got[907].band == "short" and got[907].repetitive
    assert not any(got[n].repetitive for n in (902, 903, 904, 905, None))
    # other limits give other rows: nothing but the bands decides
    shut = {r.doc_id for r in loops.repetition(df, ordinary=((80, 0.05), (10000, 0.01)), exact=False).where("repetitive").collect()}
    assert shut == {906, 907}  # 60,000 words of which 30 differ; the short one has no band
    assert loops.repetition(df.limit(0)).count() == 0


def test_chunks_and_noise():
    c, bands = loops.zstandard.ZstdCompressor(level=loops.LEVEL), loops.Bands()
    rng = random.Random(9)
    noise = "".join(rng.choice(string.ascii_lowercase + string.digits) for _ in range(6000)).encode()
    assert loops.verdict(noise, bands, c)[2] == "incompressible"
    looping = (" ".join(words_of(5, 12)) + " ").encode() * 120
    assert loops.verdict(noise[:3000] + looping, bands, c)[2] == "repetitive"
    assert [bands.ordinary(n) for n in (65, 10_000)] == pytest.approx([0.90, 0.21]) and 0 < bands.ordinary(10**7) < bands.ordinary(10**5) < 0.21


def test_ordinary_ratios(spark):
    df = spark.createDataFrame([(t, 1) for _, t in loop_rows()] + [(None, 1), ("short", 1)], "text string, bytes int")
    found = {r.bytes: r.ratio for r in loops.ordinary_ratios(df).where("texts >= 5").collect()}
    assert found and all(0 < r < 1 for r in found.values())
    assert loops.ordinary_ratios(df.limit(0)).count() == 0
