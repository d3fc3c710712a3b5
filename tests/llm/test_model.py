"""The model of problem 1 rests on every labelled row, read whole."""

from collections import Counter

import numpy as np
import pytest

from sievework.llm import langid, spam

SOUNDS = {"aa": ("bedo", "kima", "lusa", "nepo", "rovi", "tagu"), "bb": ("шорек", "виндал", "груши", "мостик", "палуб", "тянет")}


def text(lang, k, words):
    own = SOUNDS[lang]
    return " ".join(own[(k * 7 + i * i) % 6] + own[(k // 6 + i) % 6] for i in range(words)) + "."


@pytest.fixture(scope="module")
def rows():
    made = [(x, text(x, k, 12 + k % 40)) for x in SOUNDS for k in range(900)]
    made += [("aa", "zyqwu " + text("aa", k, 9)) for k in range(13)]  # a word of 13 texts in 1,020
    made += [("aa", text("aa", k, 2)) for k in range(100)]  # short
    made += [("aa", text("aa", k, 9) + " \n" + "vexhu " * 5_000) for k in range(7)]  # long: over 20,000 characters
    return made


@pytest.fixture(scope="module")
def frame(spark, rows):
    other = [(None, "unlabelled text"), ("und", "text of unknown language"), ("aa", None), ("bb", "")]
    return spark.createDataFrame([(f"{label}-XY" if i % 2 else label, t, i) for i, (label, t) in enumerate(rows)] + [(a, b, 0) for a, b in other], "lang string, text string, other int").repartition(5)


def test_factors_are_medians_of_all_rows(frame, rows):
    model = spam.fit_on(frame)
    want = {x: float(np.median([spam.redundancy(t) for label, t in rows if label == x])) for x in SOUNDS}
    assert set(model.factors) == set(want) and all(abs(model.factors[x] - want[x]) < 2e-6 for x in want)


def test_filters_count_all_rows(frame, rows):
    """Spark's counts, those of one process that passes its counts on often, and those taken text by text give the same filters."""
    found = langid.fit_on(frame)
    low = (1 << langid.GRAM_BITS) - 1
    for x in SOUNDS:
        own = [t for label, t in rows if label == x]
        counts = Counter(h for t in own for h in {int(h) & low for h in langid.grams([t.replace("\n", " ")])[0]})
        member = np.array([h for h, n in counts.items() if n >= langid.ABSOLUTE * len(own)], np.uint64)
        bit = np.uint32(1 << found.languages.index(x))
        assert (found.masks(member)[0] & bit).all()
        assert found.tables[0][found.tables[0] & bit > 0].size <= 2 * len(member)
    assert found.masks(langid.grams(["zyqwu"])[0])[0].all(), "a word of 13 texts in 1,020 belongs to its language"
    assert not found.masks(langid.grams(["vexhu"])[0])[0].all(), "one of 7 doesn't"
    same = langid.fit(rows)
    assert same.languages == found.languages and all((a == b).all() for a, b in zip(same.tables, found.tables))
    batches = [([0] * len(own), own) for k in range(0, 300, 50) if (own := [t for _, t in rows[k : k + 50]])]
    parts = list(langid.gram_counts(batches, 50))
    assert len(parts) > 2
    total = Counter()
    for key, n in parts:
        total.update(dict(zip(key.tolist(), n.tolist())))
    key, n = next(langid.gram_counts(batches, None))
    assert total == dict(zip(key.tolist(), n.tolist()))


def test_long_texts_in_pieces(monkeypatch):
    texts = ["", "12 + 3", "a", "Один два, three four - five. " * 30, "été " * 40 + "\nfin", "日本語の文章" * 20, "word. " * 3, "ends with a letter " * 9 + "z"]
    whole = langid.distinct_grams(texts)
    alone = [np.unique(langid.grams([t.replace("\n", " ")])[0] << np.uint64(langid.PLACE_BITS)) | np.uint64(i) for i, t in enumerate(texts)]
    assert (np.sort(np.concatenate(alone)) == whole).all()
    monkeypatch.setattr(langid, "PIECE", 20)
    assert len(list(langid.pieces(texts[3]))) > 20 and (langid.distinct_grams(texts) == whole).all()
    assert langid.distinct_grams([]).size == 0


def test_no_labelled_rows(spark):
    model = spam.fit_on(spark.createDataFrame([(None, "x"), ("en", "few rows")], "lang string, text string"))
    assert model.factors == {} and model.filters.languages == []
