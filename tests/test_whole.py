"""Queries that do what no SQL here can, against brute force on small fixtures."""

import pytest

from sievework import plans
from sievework.functions import urls


def write(spark, base, **tables):
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{base}/{name}.parquet")
    return str(base)


# --- canonical keys ----------------------------------------------------------------------------------

OFFERS = [
    (1, "x.test", "https://x.test/a/../seen"), (2, "x.test", "https://x.test/%7Eme"), (3, "x.test", "https://X.test/~me"), (4, "x.test", "https://x.test/b/./c"),
    (5, "x.test", "https://x.test/b/c"), (6, "x.test", "https://x.test/f.html/"), (7, "x.test", "https://x.test/f.html"), (8, "x.test", "http://x.test:443/p"),
    (9, "x.test", "http://x.test/p"), (10, "m.test", "https://m\u00fcnchen.test/"), (11, "m.test", "https://xn--mnchen-3ya.test/"), (12, "x.test", " https://x.test/b/c"),
    (13, "x.test", "http://[bad"), (14, None, "https://x.test/new"), (15, "x.test", None), (16, "x.test", "mailto:a@b.test"),
]
SEEN = [("https://x.test/seen?utm_source=a",), ("https://x.test/%7eme",), (None,), ("http://[bad",)]


@pytest.fixture(scope="module")
def crawled(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("crawled"), crawl_tasks=(OFFERS, "task_id long, domain string, url string"), fetch_results=(SEEN, "url string"))


def test_other_spellings_of_a_page_are_one_key(spark, crawled):
    keyed = [(urls.url_key(u), n, d) for n, d, u in OFFERS if urls.url_key(u)]
    seen = {urls.url_key(u) for (u,) in SEEN}
    new = {}
    for k, n, _ in keyed:
        if k not in seen:
            new[k] = (min(n, new.get(k, (n, 0))[0]), new.get(k, (n, 0))[1] + 1)
    assert new["https://x.test/b/c"] == (4, 3) and len(new) == 6 and "http://x.test:443/p" in new
    q = plans.queries()
    assert {r.key: (r.ord, r.offers) for r in q["seen_url_filter_full"](spark, crawled).collect()} == new
    assert tuple(q["seen_stats_full"](spark, crawled).first()) == (13, 8, 2, round(1 - 6 / 13, 6))
    assert sorted((r.domain, r.ord) for r in q["frontier_enqueue_full"](spark, crawled).collect()) == [("m.test", 10), ("x.test", 1), ("x.test", 2), ("x.test", 4), ("x.test", 6), ("x.test", 8), ("x.test", 9)]
    assert {r.domain: (r.offers, r.addresses) for r in q["refresh_split_full"](spark, crawled).collect()} == {"m.test": (2, 1), "x.test": (10, 6)}


# --- production limits -------------------------------------------------------------------------------


def test_limits_cut_where_production_does(spark, tmp_path):
    import math

    tasks = [(n, "hot.test", f"https://hot.test/{n}", f"https://s.test/{n}", 0) for n in range(10_005)] + [(20_000, "cold.test", "https://cold.test/a", "https://s.test/a", 500)]
    fetched = [("https://hot.test/x",)] * 3
    d = write(spark, tmp_path / "limits", crawl_tasks=(tasks, "task_id long, domain string, url string, source_url string, priority int"), fetch_results=(fetched, "url string"))
    q = plans.queries()
    queued = q["frontier_enqueue_full"](spark, d).collect()
    assert sorted(r.ord for r in queued) == [*range(10_000), 20_000] and max(r.place for r in queued) == 9_999
    assert {r.target: r.anchors for r in q["anchor_shuffle_full"](spark, d).collect()} == {"hot.test": 1000, "cold.test": 1}
    hot, cold = math.floor(500 * math.log(2)), math.floor(500 * math.log(502))
    assert {tuple(r) for r in q["site_budgets_full"](spark, d).collect()} == {("hot.test", hot, hot - 3), ("cold.test", cold, cold)}
    assert sorted(r.task_id for r in q["site_budget_admission_full"](spark, d).collect()) == [*range(hot - 3), 20_000]


# --- charsets ----------------------------------------------------------------------------------------


def test_pages_in_any_charset(spark, tmp_path):
    page = '<html lang="ru"><head><title>%s</title></head><body>x</body></html>'
    pages = {
        1: ("\u041f\u0440\u0438\u0432\u0435\u0442", "windows-1251", "text/html; charset=windows-1251"), 2: ("caf\u00e9", "windows-1252", "text/html"),
        3: ("\u65e5\u672c", "shift_jis", "text/html; charset=Shift_JIS"), 4: ("na\u00efve", "utf-8", None), 5: ("\u0414\u0430", "utf-16", "text/html"),
    }
    fetches = [(n, f"https://x.test/{n}", {} if kind is None else {"Content-Type": kind}, bytearray((page % title).encode(cs))) for n, (title, cs, kind) in pages.items()]
    fetches += [(6, "https://x.test/6", {"content-type": "text/html; charset=utf-8"}, bytearray(b"<html><title>a\xffb</title><body>" + b"react" + b"</body>")), (7, "https://x.test/7", {}, None)]
    d = write(spark, tmp_path / "pages", fetch_results=(fetches, "fetch_id long, url string, headers map<string,string>, body binary"))
    q = plans.queries()
    assert {r.fetch_id: r.title for r in q["page_titles_full"](spark, d).collect()} == {n: t for n, (t, _, _) in pages.items()} | {6: "a\u00ffb"}
    assert {r.lang: r.pages for r in q["lang_attributes_full"](spark, d).collect()} == {"ru": 5, None: 1}
    assert {r.fetch_id for r in q["render_decisions_full"](spark, d).collect()} == {1, 2, 3, 4, 5, 6}


# --- near duplicates ---------------------------------------------------------------------------------


def test_jaccard_classes_equal_brute_force(spark):
    import itertools
    import random
    import re

    from sievework.operators import dedup

    rng = random.Random(5)
    shared = [f"s{i}" for i in range(30)]  # a passage that many texts hold
    texts, n = {}, 0
    for _ in range(15):
        words = shared + [f"w{rng.randrange(300)}" for _ in range(rng.choice([40, 90, 150]))]
        for changes in (0, 1, 2, 3, 4, 6):
            v = list(words)
            for at in rng.sample(range(len(v)), changes):
                v[at] = f"c{rng.randrange(10_000)}"
            texts[n] = " ".join(v)
            n += 1
    texts |= {500: texts[0], 501: texts[0].upper() + "!", 502: "a b c", 503: "A, b c", 504: None, 505: "", 506: "..."}
    words = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in texts.items()}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    key = {i: " ".join((t or "").lower().split()) for i, t in texts.items()}
    near = lambda a, b: bool(sets[a] and sets[b]) and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))
    links = {i: len({key[j] for j in texts if key[j] != key[i] and near(i, j)}) for i in texts}
    label = {i: i for i in texts}
    for _ in texts:
        for a, b in itertools.combinations(texts, 2):
            if near(a, b):
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.links) for r in dedup.near_duplicate_classes(df, "doc_id", "text").collect()}
    assert got == {i: (label[i], links[i]) for i in texts}
    old = {r.doc_id: r.class_id for r in dedup.simhash_classes(df, "doc_id", "text").collect()}
    assert sum(links.values()) > 50 and any(old[i] != label[i] for i in texts)


def test_links_count_texts_behind_a_hash(spark):
    from sievework.operators import dedup

    base = [f"w{i}" for i in range(400)]
    near = next(t for i in range(400) if 0 < bin((dedup.simhash64(t := " ".join(base[:i] + ["changed"] + base[i + 1 :])) ^ dedup.simhash64(" ".join(base))) & (2**64 - 1)).count("1") <= 3)
    text = " ".join(base)
    data = [(1, text), (2, text.upper()), (3, text + "!"), (4, text.replace(" ", ", ")), (5, near), (6, near + "."), (7, "far away from all of these"), (8, None)]
    got = {r.doc_id: (r.class_id, r.links) for r in dedup.simhash_classes(spark.createDataFrame(data, "doc_id long, text string"), "doc_id", "text").collect()}
    # three texts (case is no difference) with one hash, two with the other
    assert got == {**{i: (1, 4) for i in range(1, 7)}, 7: (7, 0), 8: (8, 0)}


# --- spelling ----------------------------------------------------------------------------------------


def test_short_words_and_two_edits_are_asked(spark, tmp_path):
    often = [(f"d{i}", {"house": [0], "market": [1], "tree": [2]}, 0.5, 3) for i in range(5)]
    rare = [("r1", {"hose": [0], "mrakte": [1], "zzzzzzzz": [2]}, 0.5, 3)]
    d = write(spark, tmp_path / "spelling", input_documents=(often + rare, "external_id string, terms map<string,array<int>>, static_rank double, length int"))
    got = {(r.word, r.candidate, r.distance, r.doc_freq) for r in plans.queries()["spelling_candidates"](spark, d).collect()}
    assert {("hose", "house", 1, 5)} <= got and not any(w == "zzzzzzzz" for w, *_ in got)
    typo = [("r1", {"markte": [0], "markat": [1], "mrket": [2]}, 0.5, 3)]
    d = write(spark, tmp_path / "spelling2", input_documents=(often + typo, "external_id string, terms map<string,array<int>>, static_rank double, length int"))
    got = {(r.word, r.candidate, r.distance) for r in plans.queries()["spelling_candidates"](spark, d).collect()}
    assert got == {("markte", "market", 2), ("markat", "market", 1), ("mrket", "market", 1)}


# --- labels ------------------------------------------------------------------------------------------


def test_labels_choose_no_documents(spark, tmp_path):
    from collections import Counter

    texts = [(1, "ja", "日本 語。カー"), (2, None, "日本"), (3, "en", "He said 東京 x 語, twice. A museum."), (4, "de", "Nothing. The library is open."), (5, "zh", None)]
    d = write(spark, tmp_path / "labels", documents=(texts, "doc_id long, lang string, text string"))
    got = {r.pair: r.n for r in plans.queries()["char_bigrams_full"](spark, d).collect()}
    assert got == Counter(["日本", "本語", "カー", "日本", "東京", "語"])
    found = {r.doc_id: r.snippet for r in plans.queries()["snippets"](spark, d).collect()}
    assert set(found) == {1, 2, 3, 4, 5} and found[4] == "The [library] is open." and found[3] == "A [museum]."
