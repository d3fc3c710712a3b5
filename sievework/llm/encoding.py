"""Garbled text from wrong character encoding: find it and restore it by round trips.

A text is searched for traces of a wrong decoding: sequences that, re-encoded
under a legacy encoding, are strictly valid UTF-8 of a plausible character;
replacement signs; control characters of the C1 range; words of accented capitals
or of mixed scripts. The traces that are attached to words add up to a garbling
cost. Repair re-encodes under each candidate, decodes strictly as the intended
encoding, repeats for nested layers, and is accepted when the cost drops. A sign
that stands alone, as when a page talks about such signs, costs nothing.

Defined results
* null or empty body, or a body that is no html: no row.
* null headers: the order of decoding goes on with the page's own declaration.
* unknown charset labels: skipped. Very long pages: read whole.
* repeated rows give a row each; an empty table none. Further columns: ignored.
"""

from __future__ import annotations

import codecs
import html
import re
from functools import lru_cache

#: Encodings under which UTF-8 is taken to have been misread, in the order of trial.
LEGACY = ("cp1252", "latin-1", "cp1251", "cp1250", "iso8859-2", "koi8-r", "cp1256", "cp1254")
#: Encodings that the bytes of a page are tried under where the declared one does not fit.
FITS = ("utf-8", "cp1252", "cp1250", "cp1251", "iso8859-2", "koi8-r", "cp1256", "shift_jis", "euc_jp", "euc_kr", "gbk", "big5")

_RUN = re.compile("[^\x00-\x7f\\s\ufffd]{2,}")
_LATIN_RUN = re.compile("[\x80-\u017f\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{2,}")
#: What the two bytes of a Cyrillic letter show as when read as cp1251, a lost no-break space among them.
_CYRILLIC_PAIR = re.compile("[\u0420\u0421](?:[ \xa0](?=\\S)|[\u0402-\u040f\u0452-\u045f\xa4-\xbb\u2013-\u2122])")
_BROKEN = re.compile("[\ufffd\x80-\x9f\ue000-\uf8ff]+")
_LOST_SPACE = re.compile("(?<=[a-z\xdf-\xff])[\xc2\xc3](?=\\s|$)")
_CYRILLIC_AS_LATIN = re.compile("[\xc0-\xd6\xd8-\xf6\xf8-\xff]{4,}")
_SHIFTED_CASE = re.compile("[\u0430-\u0451][\u0410-\u042f\u0401]")
_MIXED_SCRIPT = re.compile("[A-Za-z\xc0-\xff](?=[\u0400-\u04ff\u0600-\u06ff])|[\u0400-\u04ff\u0600-\u06ff](?=[A-Za-z\xc0-\xff])")
_INNER_SIGN = re.compile("(?<=[^\\W\\d_])[\xa1-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\xd7\xf7\u2500-\u259f\u02c7\u02d8-\u02dd\uff66-\uff9f\u201a\u201e\u2020\u2021\u2030\u2039\u203a\u0192](?=[^\\W\\d_])")


def _second_signs() -> str:
    """What the second byte of a two-byte UTF-8 character shows as under the encodings of LEGACY; letters of other scripts and closing quotes left out."""
    found = {bytes([n]).decode(name, "replace") for name in LEGACY for n in range(0x80, 0xC0)} | {chr(n) for n in range(0x80, 0xA0)}
    other = {c for c in found if "\u0400" <= c <= "\u04ff" or "\u0600" <= c <= "\u06ff"}
    closing = set("\u201d\xbb\u2019\u201c\u2014\u2013\u2026\xab\u201e\u2018\u201a\ufffd\xa0")
    return "".join(sorted(re.escape(c) for c in found - other - closing))


#: A letter beyond ascii before such a sign: only texts that show one are looked at run by run.
_HINT = re.compile("[^\x00-\x7f\\W\\d_][" + _second_signs() + "]|\xe2\u20ac|\xe2\x80")


def _plausible(ch: str) -> bool:
    n = ord(ch)
    return 0xA0 <= n <= 0x17F or 0x2010 <= n <= 0x2044 or n in (0x20AC, 0x2116, 0x2122) or 0x400 <= n <= 0x52F or 0x5D0 <= n <= 0x6FF or 0x3000 <= n <= 0x30FF or 0x4E00 <= n <= 0x9FFF or 0xAC00 <= n <= 0xD7A3 or 0xFF00 <= n <= 0xFFEF or n == 0xFFFD


def _controls_as_bytes(e: UnicodeError):
    if isinstance(e, UnicodeEncodeError):
        run = e.object[e.start : e.end]
        if all("\x80" <= c <= "\x9f" for c in run):
            return bytes(map(ord, run)), e.end
    raise e


codecs.register_error("controls-as-bytes", _controls_as_bytes)
_HOLED = frozenset(("cp1252", "cp1250", "cp1251", "cp1256", "cp1254"))


def encode_loosely(text: str, name: str) -> bytes | None:
    """Strict, but for C1 controls, which stand for the bytes that an encoding leaves undefined."""
    try:
        return text.encode(name, "controls-as-bytes" if name in _HOLED else "strict")
    except UnicodeEncodeError:
        return None


@lru_cache(maxsize=100_000)
def run_trace(run: str) -> tuple[str, str, int] | None:
    """(encoding, text restored by one round trip, restored characters) of a run of non-ascii characters that is garbled; None for others.

    A sign at either end may be a sound one that stands beside the garbled ones.
    """
    for head, tail in ((0, 0), (1, 0), (0, 1), (1, 1)):
        core = run[head : len(run) - tail]
        if len(core) < 2:
            break
        for name in LEGACY:
            data = encode_loosely(core, name)
            if data is None:
                continue
            try:
                whole = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if sum(map(_plausible, whole)) * 2 > len(whole):
                return name, run[:head] + whole + run[len(run) - tail :], len(whole)
    return None


def traces(text: str) -> tuple[int, int]:
    """(traces attached to words, traces that stand alone)."""
    if text.isascii():
        return 0, 0
    attached = alone = 0
    n = len(text)

    def weigh(s: int, e: int, many: bool) -> None:
        nonlocal attached, alone
        if many or (s > 0 and text[s - 1].isalnum()) or (e < n and text[e].isalnum()):
            attached += 1
        else:
            alone += 1

    for m in _BROKEN.finditer(text):
        weigh(m.start(), m.end(), m.end() - m.start() > 1)
    if _HINT.search(text):
        for m in _RUN.finditer(text):
            found = run_trace(m[0])
            if found:
                weigh(m.start(), m.end(), found[2] > 1)
    if "\xc3 " in text or "\xc2 " in text:
        attached += len(_LOST_SPACE.findall(text))
    return attached, alone


def implausible(text: str) -> int:
    """Signs that no text in its own encoding shows: case that flips within words, signs between letters, mixed scripts, words of accented letters."""
    if text.isascii():
        return 0
    return (
        3 * len(_BROKEN.findall(text))
        + 2 * len(_CYRILLIC_AS_LATIN.findall(text))
        + len(_SHIFTED_CASE.findall(text))
        + len(_MIXED_SCRIPT.findall(text))
        + len(_INNER_SIGN.findall(text))
    )


def cost(text: str) -> int:
    attached, _ = traces(text)
    return 4 * attached + implausible(text)


def is_garbled(text: str) -> bool:
    """Whether words of the text are damaged. Three signs alone count as damage too: no page talks so much about them."""
    attached, alone = traces(text)
    return attached > 0 or alone >= 3 or bool(len(_CYRILLIC_AS_LATIN.findall(text)) >= 3)


def unwrap(text: str) -> str:
    """One layer off: the whole text re-encoded under the encoding that leaves it least garbled; else its garbled runs, other text left alone."""
    wholes = []
    for name in LEGACY:
        data = encode_loosely(text, name)
        if data is not None:
            try:
                wholes.append(data.decode("utf-8"))
            except UnicodeDecodeError:
                continue
    if wholes:
        whole = min(dict.fromkeys(wholes), key=cost)
        if whole != text:
            return whole

    def one(m: re.Match[str]) -> str:
        found = run_trace(m[0])
        return found[1] if found else m[0]

    tried = _RUN.sub(one, text)
    return tried if tried != text else _LATIN_RUN.sub(one, text)  # garbled signs between sound ones of another script


def repair_text(text: str) -> tuple[str, int]:
    """(text, layers taken off). A layer is accepted when the cost drops; it is a count, so the layers end."""
    layers, now = 0, cost(text)
    while now:
        tried = unwrap(text)
        after = cost(tried)
        if tried == text or after >= now:
            break
        text, now, layers = tried, after, layers + 1
    return text, layers


_ENTITY = re.compile("&(?:#[xX]?[0-9a-fA-F]{2,6}|[a-zA-Z]{2,8});")


def without_high_entities(text: str) -> str:
    """Entities of characters beyond ascii decoded: a page may have been escaped after it was garbled. Markup is left as it is."""

    def one(m: re.Match[str]) -> str:
        ch = html.unescape(m[0])
        return ch if not ch.isascii() else m[0]

    return _ENTITY.sub(one, text) if "&" in text else text


def mostly_garbled(text: str) -> bool:
    """Whether about a third of the words are damaged, so that nothing else can be said of the text."""
    return 3 * (traces(text)[0] + len(_CYRILLIC_PAIR.findall(text))) > len(text.split())


def redecode(body: bytes, declared: str, text: str) -> tuple[str, str]:
    """The text under the encoding that fits the bytes best, and its name; the declared one where no other costs less."""
    best, name, least = text, declared, cost(text)
    if declared == "utf-8" and "\ufffd" not in text:  # the bytes are what they claim; they were garbled before
        return text, declared
    try:
        if declared == "utf-8":
            body.decode(declared)
            return text, declared  # the signs of loss are stored ones
    except UnicodeDecodeError:
        pass
    for other in FITS:
        if not least:
            break
        if other == declared:
            continue
        try:
            tried = body.decode(other)
        except (UnicodeDecodeError, LookupError):
            continue
        c = cost(tried)
        if c < least:
            best, name, least = tried, other, c
    return best, name


def page_is_garbled(body: bytes, declared: str, main_text: str, text: str) -> bool:
    """is_garbled, and for pages under a legacy charset: signs of another one whose reading of the bytes costs less."""
    if is_garbled(main_text):
        return True
    if declared in ("utf-8", "utf-16-le", "utf-16-be") or not implausible(main_text):
        return False
    return redecode(body, declared, text)[1] != declared
