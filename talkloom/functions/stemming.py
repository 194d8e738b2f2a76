"""The English (Porter2) stemmer, after its published definition."""

from __future__ import annotations

import re
from functools import lru_cache

_V = "[aeiouy]"
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_KEPT_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]


def _region(w: str, start: int) -> int:
    m = re.compile(r"[aeiouy][^aeiouy]").search(w, start)
    return m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a word in small letters."""
    w = word.lower().replace("’", "'")
    if len(w) <= 2:
        return w
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    if w in _KEPT:
        return w
    w = w.removeprefix("'")
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    m = re.match(r"gener|commun|arsen", w)
    r1 = m.end() if m else _region(w, 0)
    r2 = _region(w, r1)
    if s := _longest(w, ("'", "'s", "'s'")):
        w = w[: -len(s)]
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(_V + ".", w[:-1]):
        w = w[:-1]
    if w in _KEPT_AFTER_1A:
        return w
    # 1b
    s = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and re.search(_V, w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif re.search(r"(?:bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    # 2
    if (s := _longest(w, _STEP_2)) and len(w) - len(s) >= r1:
        if s == "li":
            if len(w) > 2 and w[-3] in "cdeghkmnrt":
                w = w[:-2]
        elif s != "ogi" or w[-4:-3] == "l":
            w = w[: -len(s)] + _STEP_2[s]
    # 3
    if (s := _longest(w, _STEP_3)) and len(w) - len(s) >= r1 and (s != "ative" or len(w) - 5 >= r2):
        w = w[: -len(s)] + _STEP_3[s]
    # 4
    if (s := _longest(w, _STEP_4)) and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
