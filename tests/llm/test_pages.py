"""Problems 1, 2, 4 and 5 on small pages."""

import hashlib
import random

import pytest

from sievework.llm import encoding, fetches, langid, mainbody, pages, spam

SENTENCES = {
    "en": ["The garden shed follows the town library without much effort.", "About twenty visitors noticed that the museum hall needs the old forum.", "It is not the harbour walk that covers the kitchen table, but the paper map.", "In practice the repair guide stores the news archive at the weekend.", "When the bicycle frame changes the winter coat, the bread oven keeps the sitemap."],
    "fr": ["Le jardin d’été suit la bibliothèque sans trop d’effort.", "Près de vingt visiteurs ont remarqué que le musée explique le vieux forum.", "La salle des serveurs décrit la carte routière depuis le printemps.", "Quand la forêt répète le théâtre, le résumé précède aussi la recette.", "En règle générale, l’école du village améliore le manteau."],
    "ru": ["Городской музей проверяет архив новостей без особого труда.", "Около двадцати гостей заметили, что старый индекс меняет рецепт.", "Когда вокзал хранит справочник, тогда тёплый плащ дополняет рецепт.", "Напротив, зимний сад улучшает хлебный дом в течение ночи.", "До недавнего времени главный сервер описывал кухонный стол."],
}
FURNITURE = '<div class="x1"><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li><li><a href="/c">Contact</a></li></ul></div>'
FOOT = "<div class=x9><p>© 2014 Site</p><p>All rights reserved. No part may be reproduced.</p></div>"


def body(main, head="<meta charset=utf-8>"):
    return f"<!doctype html><html><head>{head}<title>t</title><style>.a{{b:c}}</style></head><body>{FURNITURE}<div class=x2>{main}</div>{FOOT}<script>x('<p>')</script></body></html>"


def article(lang="en"):
    s = SENTENCES[lang]
    return f"<h1>{s[0].rstrip('.')}</h1><p><small>Name, 1.2.2026</small></p><p>{s[1]} {s[2]}</p><ul><li>{s[3]}<li>{s[4]}</ul><p>{s[0]}<br>{s[3]}</p>"


def texts_of(html):
    return [b.text for b in mainbody.main_blocks(pages.parse(html))]


# --- 2 -----------------------------------------------------------------------------------------------


def test_main_body():
    s = SENTENCES["en"]
    want = [s[0].rstrip("."), f"{s[1]} {s[2]}", s[3], s[4], f"{s[0]} {s[3]}"]
    assert texts_of(body(article())) == want
    extra = article() + '<div>We use cookies. <button>OK</button></div><div>Share this page: <a href="/s">Here</a> <a href="/t">There</a></div><h3>Related articles</h3><ul><li><a href="/r">One</a></li><li><a href="/q">Two</a></li></ul><div class="comments"><p>Ann: I like the paper map.</p></div>'
    assert texts_of(body('<div><a href="/">Site</a> &gt; <a href="/x">Part</a></div>' + extra)) == want


def test_leaf_divs_and_layout_tables():
    s = SENTENCES["en"]
    divs = f"<h1>A headline here</h1><div>{s[1]}<br><br>{s[2]}</div><div>{s[3]}</div>"
    assert texts_of(body(divs)) == ["A headline here", f"{s[1]} {s[2]}", s[3]]
    table = f"<body><table><tr><td><a href=/a>Home</a><br><a href=/b>News</a></td><td><h1>A headline here</h1><p>{s[1]}</p><table><tr><td>Weight</td><td>5 kg</td></tr></table></td><td><h4>Most read</h4><p>{s[4]}</p></td></tr></table>"
    assert texts_of(table) == ["A headline here", s[1], "Weight", "5 kg"]


def test_inline_and_entities():
    got = texts_of("<body><div><h1>H</h1><p>a<b>b</b>&amp;c&nbsp;d <a href='x>y'>e</a>\n f</p><p>  </p><!-- <p>no</p> --></div>")
    assert got == ["H", "ab&c d e f"]


def test_links_with_words_stay():
    s = SENTENCES["en"]
    got = texts_of(body(f"<h1>News of the day</h1><ul><li><a href=/1>First</a> – {s[0]}</li><li><a href=/2>Second</a> – {s[1]}</li></ul>"))
    assert got == ["News of the day", f"First – {s[0]}", f"Second – {s[1]}"]


@pytest.mark.parametrize("html", ["", " ", "<", "<div>" * 3000, "</p></div>", "<p>x", "no tags at all", "<body>" + "<p>word word.</p>" * 3000, "<table><li><td><p><h1>x"])
def test_any_markup(html):
    page = pages.parse(html)
    mainbody.main_blocks(page)
    spam.page_spam(pages.parse(html))


# --- 1 -----------------------------------------------------------------------------------------------

WORDS = ["cheap boots", "loan quick", "buy online", "hotel deals", "zelgor", "free shipping", "lotra"]


def stuffed(n=80, joint=" "):
    return joint.join(WORDS[(i * i + i // 3) % len(WORDS)] for i in range(n))


@pytest.mark.parametrize(
    "main",
    [
        f"<h1>cheap boots</h1><p>{stuffed()}</p>",
        f"<h1>cheap boots</h1><p>{stuffed(90, ', ')}</p>",
        "<h1>cheap boots</h1><ul>" + "".join(f"<li><a href='http://x.test/{i}'>{WORDS[i * i % 7]}</a></li>" for i in range(60)) + "</ul>",
        "<h1>cheap boots</h1><table>" + "".join(f"<tr><td>{WORDS[i * i % 7]}</td><td>{WORDS[(i + 2) * i % 7]}</td></tr>" for i in range(40)) + "</table>",
        f"<h1>A headline</h1><p>{SENTENCES['en'][0]}</p><div style='left:-999em'>{stuffed(120)}</div>",
        "<h1>cheap boots</h1><p>" + " ".join(stuffed(4 + i % 3, " ").capitalize() + "." for i in range(40)) + "</p>",
    ],
)
def test_spam(main):
    assert spam.page_spam(pages.parse(body(main)))[0] > 0.5


@pytest.mark.parametrize("lang", SENTENCES)
def test_no_spam(lang):
    assert spam.page_spam(pages.parse(body(article(lang))))[0] < 0.5
    rows = "<table>" + "".join(f"<tr><td>{w}</td><td>{i * 37 % 900} kg</td></tr>" for i, w in enumerate(("The parser", "The snippet", "Anchor text", "The cache"))) + "</table>"
    assert spam.page_spam(pages.parse(body(article(lang) + rows)))[0] < 0.5


def test_spam_below_half_is_none():
    long = "".join(f"<p>{a} {b}</p>" for a in SENTENCES["en"] for b in SENTENCES["en"])
    assert spam.page_spam(pages.parse(body(f"<h1>A headline</h1>{long}<p>{stuffed(60)}</p>")))[0] < 0.5


def test_language_factors(filters):
    """The same text is more or less redundant by what its language's ordinary text compresses to."""
    rows = [(x, " ".join(own[(i + k) % 5] for k in range(5))) for x, own in SENTENCES.items() for i in range(40)]
    model = spam.fit(rows)
    assert set(model.factors) == {"en", "fr", "ru"} and model.factors["ru"] < model.factors["en"]
    text = " ".join(SENTENCES["ru"])
    assert model.language(text) == "ru" and spam.redundancy(text, model.factors["ru"]) > spam.redundancy(text) * 1.02
    assert spam.NO_MODEL.factor("anything") == 1.0 and spam.fit([]).highest == 1.0


def test_blocks():
    blocks = spam.judge([SENTENCES["en"][0], SENTENCES["en"][1], "Heading", "cell one", "cell two", stuffed()])
    kinds = {b.kind: b for b in blocks}
    assert kinds["stretch"].spam and kinds["stretch"].density == 0 and not kinds["sentences"].spam
    assert spam.judge([]) == [] and not any(b.spam for b in spam.judge(["x y"]))
    # many short runs are judged together
    short = [x for k in range(30) for x in ("cheap boots loan", SENTENCES["en"][k % 5])]
    assert {b.kind: b for b in spam.judge(short)}["short"].spam


# --- 4 -----------------------------------------------------------------------------------------------


def garble(text, wrong="cp1252", times=1):
    for _ in range(times):
        text = "".join(bytes([b]).decode(wrong) if wrong != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())
    return text


@pytest.mark.parametrize("lang", ["fr", "ru"])
@pytest.mark.parametrize("wrong", ["cp1252", "latin-1"])
@pytest.mark.parametrize("times", [1, 2])
def test_round_trip(lang, wrong, times):
    for s in SENTENCES[lang]:
        bad = garble(s, wrong, times)
        if bad != s:
            assert encoding.is_garbled(bad)
            assert encoding.repair_text(bad) == (s, times)


@pytest.mark.parametrize("times", [5, 6])
def test_many_layers(times):
    assert encoding.repair_text(garble("Près de l’été", "latin-1", times)) == ("Près de l’été", times)


@pytest.mark.parametrize("wrong", ["cp1251", "koi8-r", "iso8859-2"])
def test_every_legacy_encoding(wrong):
    text = "Près du café «été» à Noël"
    bad = text.encode().decode(wrong, "strict") if wrong != "cp1251" else "".join(bytes([b]).decode(wrong) if b != 0x98 else "\x98" for b in text.encode())
    assert encoding.repair_text(bad) == (text, 1)


def test_html_is_found_late():
    assert pages.is_html(b" " * 3000 + b"<p>x", None) and pages.is_html(b"x" * 3000 + b"<!DOCTYPE  html>", None) and not pages.is_html(b"x" * 3000, None)


def test_sound_text_is_left_alone():
    for s in (*(x for own in SENTENCES.values() for x in own), "日本語の文章です。", "مرحبا بالعالم", "«CAFÉ»", "NÃO É AQUI", "Główna żółć", "“É—” ½ × 3", "", "plain"):
        assert not encoding.is_garbled(s), s
        assert encoding.repair_text(s) == (s, 0)
    for s in ("Whoever sees Ã© instead of é should check.", "the sign â€™ stood for ’ there", "It shows � at times."):
        assert not encoding.is_garbled(s), s


def test_partly_garbled_and_beyond_repair():
    assert encoding.is_garbled("A sound line. The cafÃ© in town.") and encoding.repair_text("A sound é line. The cafÃ© in town.")[0] == "A sound é line. The café in town."
    assert encoding.is_garbled("The caf� in town") and encoding.is_garbled("x��y")


def read(html, data=None, kind="text/html"):
    return fetches.read(data if data is not None else html.encode(), kind)


def test_declared_wrongly():
    fr = body(article("fr"), "")
    assert not read(fr).garbled
    assert read(fr, kind="text/html; charset=windows-1252").garbled
    assert not read(fr, "﻿".encode() + fr.encode(), "text/html; charset=iso-8859-1").garbled
    assert read(fr, fr.encode("cp1252"), "text/html; charset=utf-8").garbled
    assert not read(fr, fr.encode("cp1252"), 'text/html; Charset="ISO-8859-1"').garbled
    ru = body(article("ru"), "")
    assert not read(ru, ru.replace("©", "").encode("koi8-r"), "text/html; charset=koi8-r").garbled
    for real, said in (("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "utf-8"), ("cp1251", "iso-8859-1")):
        r = read(ru, ru.replace("©", "").encode(real), f"text/html; charset={said}")
        assert r.garbled and SENTENCES["ru"][1] in r.main_text(), (real, said)
    assert not read(fr.replace("©", "Ã©Ã©Ã©")).garbled, "furniture alone"
    assert read(fr, kind="text/html; charset=no-such").encoding == "utf-8"


# --- 5 -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def filters():
    rows = []
    for lang, own in SENTENCES.items():
        for i in range(20):
            rows.append((lang, " ".join(own[(i + k) % 5] for k in range(4))))
    rows += [("fr", " ".join(SENTENCES["en"])), ("de", "zu wenig"), (None, "x"), ("en", None), ("en-US", SENTENCES["en"][0])]
    return langid.fit(rows)


def test_languages(filters):
    assert filters.languages == ["en", "fr", "ru"]
    wrong = [("zh", " ".join(SENTENCES["ru"][i % 5 :])) for i in range(14)]
    right = [(x, " ".join(own[i % 5 :] + own[: i % 5])) for x, own in SENTENCES.items() for i in range(60)]
    assert langid.fit(right + wrong).languages == ["en", "fr", "ru"], "a wrong label became a language"
    for lang, own in SENTENCES.items():
        found = langid.segments(filters, own)
        assert [x[0] for x in found] == [lang] and found[0][1] > 0.5


def test_segments(filters):
    en, fr, ru = (SENTENCES[x] for x in ("en", "fr", "ru"))
    found = langid.segments(filters, [en[0] + " " + en[1], "120 g zelgor", "GET /melka/cesel 200 8985", fr[1] + " " + fr[2], ru[0], fr[3]])
    assert [x[0] for x in found] == ["en", "fr", "ru", "fr"] and sum(len(x[2]) for x in found) == 8
    assert [x[0] for x in langid.segments(filters, [en[0][:-1] + " (“le jardin”).", en[1]])] == ["en"]
    assert langid.segments(filters, []) == [] and langid.segments(filters, ["", "12 + 3"]) == []


def test_weak_runs_join_their_neighbours(filters):
    en, fr = SENTENCES["en"], SENTENCES["fr"]
    log = ["GET /melka/cesel 200 8985", "GET /lenda/vorika 200 11", "120 g zelgor", "35 g finora lesoir"]
    for blocks in ([*en, *log, *en], [*log, *en], [*en, *log], [*fr[:2], *log, *fr[2:]]):
        assert len(langid.segments(filters, blocks)) == 1, blocks
    assert [x[0] for x in langid.segments(filters, [*en, *log, *fr])] == ["en", "fr"]
    assert all(x[1] >= langid.FLOOR for x in langid.segments(filters, [*en, *log, *fr, *log, *en]))


def test_more_languages_than_a_word_holds():
    # forty alphabets of their own
    def text(k, seed):
        rng = random.Random(seed)
        letters = [chr(0x4E00 + 40 * k + i) for i in range(12)]
        return " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))

    rows = [(f"l{k:02}", text(k, 100 * k + n)) for k in range(40) for n in range(langid.LEAST_DOCS + 2)]
    made = langid.fit(rows)
    assert len(made.languages) == 40 and len(made.tables) == 2
    for k in (0, 31, 32, 39):
        assert [x[0] for x in langid.segments(made, [text(k, 9999)])] == [f"l{k:02}"]


def test_fit_on_counts_all_rows(spark):
    rows = [(f"  {x.upper()}-x", " ".join(own[(i + k) % 5] for k in range(4))) for x, own in SENTENCES.items() for i in range(40)]
    rows += [("rare", "one row alone " * 9), (None, "x" * 99), ("und", "y" * 99), ("en", None), ("en", ""), ("", "z" * 99)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, text string, _label int, _n int")
    assert langid.fit_on(df).languages == ["en", "fr", "ru"]


def test_no_training_rows():
    assert langid.segments(langid.fit([]), ["some text here."]) == []


# --- frames ------------------------------------------------------------------------------------------

SCHEMA = "fetch_id long, headers map<string,string>, body binary, garbled string, spam int, _type int, _body int"


@pytest.fixture(scope="module")
def table(spark):
    utf = {"CONTENT-type": "text/html; charset=utf-8"}
    rows = [
        (1, utf, body(article("fr")).encode()),
        (2, {"content-type": "text/html; charset=windows-1252"}, body(article("fr")).encode()),
        (3, utf, body(f"<h1>cheap boots</h1><p>{stuffed()}</p>").encode()),
        (4, None, body(article("en")).encode()),
        (5, {}, body(article("ru")).encode()),
        (6, {"content-type": "application/json"}, b'{"a": "<p>x</p>"}'),
        (7, utf, None),
        (8, utf, b""),
        (None, utf, body(article("en")).encode()),
        (4, None, body(article("en")).encode()),
        (9, {"content-type": None}, body("<h1>Long page</h1>" + "".join(f"<p>{a} {b}</p>" for a in SENTENCES["en"] for b in SENTENCES["en"]) * 200).encode()),
    ]
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def ids(df, c="fetch_id"):
    return sorted((r[c] for r in df.collect()), key=str)


def test_frames(table):
    assert ids(fetches.keyword_pages(table).where("spam_share > 0.5")) == [3]
    assert ids(fetches.garbled_ids(table)) == [2]
    restored = fetches.garbled_pages(table).first()
    assert SENTENCES["fr"][1] in restored.restored and restored.fitting == "utf-8"
    hashes = fetches.main_body_hashes(table).where("not spam and fetch_id = 1").collect()
    assert {r.block_md5 for r in hashes} >= {hashlib.md5(SENTENCES["fr"][3].encode()).hexdigest()} and len(hashes) == 5
    got = ids(fetches.main_body_hashes(table).where("not spam").select("fetch_id").distinct())
    assert got == [1, 4, 5, 9, None]
    assert len(fetches.main_body(table).where("fetch_id = 9").select("block").distinct().collect()) == 26


def test_labels(spark, table, filters):
    labels = spark.createDataFrame([(1, "FR-ca", 0), (2, None, 0), (3, None, 0), (4, "ru", 0), (5, "und", 0), (9, "en", 0), (None, "en", 0), (77, "", 0), (4, "ru", 0)], "fetch_id long, language string, segments int")
    got = fetches.relabelled(fetches.languages(table, spam.Model(filters, {})), labels)
    assert sorted({(r.fetch_id, r.segment_no, r.language) for r in got.collect()}) == [(4, 1, "en"), (5, 1, "ru")]


def test_empty_table(spark, table, filters):
    none = table.limit(0)
    for df in (fetches.keyword_pages(none), fetches.main_body(none), fetches.main_body_hashes(none), fetches.garbled_pages(none), fetches.garbled_ids(none), fetches.languages(none, spam.Model(filters, {})), fetches.keyword_blocks(none)):
        assert df.count() == 0
    assert langid.fit_on(spark.createDataFrame([], "lang string, text string")).languages == []
