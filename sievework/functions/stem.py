"""Stemmers: English by the published Porter2 rules, light suffix rules for other languages (approximate, and said to be)."""

from __future__ import annotations

import re
from functools import lru_cache

# Fixed values of the Porter2 algorithm.
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_STOP_AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = (
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"),
    ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"),
    ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
)
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

# Light suffixes, longest first.
_LIGHT = {
    "de": ("ungen", "heiten", "keiten", "ern", "em", "en", "er", "es", "e", "s", "n"),
    "fr": ("issements", "issement", "atrices", "ateurs", "ations", "ements", "ement", "euses", "ation", "ités", "aux", "ité", "ées", "és", "ée", "er", "es", "é", "e", "s"),
    "es": ("aciones", "imiento", "amiento", "mente", "ación", "idades", "idad", "iendo", "ando", "ados", "adas", "idos", "idas", "ado", "ada", "ido", "ida", "es", "as", "os", "ar", "er", "ir", "a", "o", "e", "s"),
    "it": ("azioni", "azione", "amente", "mente", "ità", "ando", "endo", "ato", "ata", "ati", "ate", "are", "ere", "ire", "i", "e", "a", "o"),
    "pt": ("ações", "amento", "mente", "ação", "idade", "ando", "endo", "ados", "adas", "ado", "ada", "ido", "ida", "es", "as", "os", "ar", "er", "ir", "a", "o", "e", "s"),
    "nl": ("heden", "ingen", "heid", "ing", "en", "je", "e", "s"),
    "ru": ("иями", "ями", "ами", "ией", "иям", "ием", "иях", "ого", "ему", "ому", "ыми", "ими", "ее", "ие", "ые", "ое", "ей", "ий", "ый", "ой", "ем", "им", "ым", "ом", "их", "ых", "ую", "юю", "ая", "яя", "ах", "ях", "ию", "ью", "ия", "ья", "а", "е", "и", "й", "о", "у", "ы", "ь", "ю", "я"),
    "sv": ("heterna", "heten", "arna", "erna", "orna", "ande", "aren", "ades", "ast", "ade", "ern", "ens", "het", "ar", "er", "or", "en", "at", "a", "e", "s"),
}
_LIGHT_MIN = 3


def _r1(word: str) -> int:
    for head in ("gener", "commun", "arsen"):
        if word.startswith(head):
            return len(head)
    m = re.search("[aeiouy][^aeiouy]", word)
    return m.end() if m else len(word)


def _r2(word: str, r1: int) -> int:
    m = re.search("[aeiouy][^aeiouy]", word[r1:])
    return r1 + m.end() if m else len(word)


def _short(word: str, r1: int) -> bool:
    return r1 >= len(word) and bool(re.search("(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$", word))


def _english(word: str) -> str:
    if len(word) < 3:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.lstrip("'")
    w = re.sub("(^y|(?<=[aeiouy])y)", "Y", w)
    r1 = _r1(w)
    r2 = _r2(w, r1)
    w = re.sub("('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _STOP_AFTER_1A:
        return w
    # 1b
    m = re.search("(eedly|eed|ingly|edly|ing|ed)$", w)
    if m:
        if m[0].startswith("eed"):
            if m.start() >= r1:
                w = w[: m.start()] + "ee"
        elif re.search("[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(_DOUBLES):
                w = w[:-1]
            elif _short(w, r1):
                w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2
    for end, new in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    # 3
    for end, new in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    # 4
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1], r1))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(maxsize=200_000)
def stem(word: str, lang: str | None) -> str | None:
    """The stem where it differs from the word; None otherwise and for languages without rules."""
    base = (lang or "").lower().split("-")[0]
    if base == "en":
        out = _english(word)
    elif base in _LIGHT:
        out = next((word[: -len(s)] for s in _LIGHT[base] if word.endswith(s) and len(word) - len(s) >= _LIGHT_MIN), word)
    else:
        return None
    return out if out and out != word else None
