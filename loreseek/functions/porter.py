"""The Porter stemmer (Porter 1980, with the published departures for -bli and -logi), on ASCII words."""

from __future__ import annotations

from functools import lru_cache

#: The published endings.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "logi": "log", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonants(word: str) -> str:
    out = []
    for k, c in enumerate(word):
        out.append("v" if c in "aeiou" or c == "y" and k and out[-1] == "c" else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _consonants(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _consonants(stem)


def _short_end(stem: str) -> bool:
    return len(stem) > 2 and _consonants(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replace(word: str, table: dict[str, str], least: int) -> str:
    for size in range(7, 1, -1):
        new = table.get(word[-size:]) if len(word) > size else None
        if new is not None:
            return word[:-size] + new if _measure(word[:-size]) >= least else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of under 3 or over 64 characters and words with other characters than letters and digits stay."""
    # Long runs, such as texts without blanks, are not kept.
    return _stem(word) if len(word) <= 64 and 3 <= len(word.encode()) <= 64 else word


@lru_cache(maxsize=1 << 16)
def _stem(word: str) -> str:
    w = word
    if w.endswith("sses") and len(w) > 4 or w.endswith("ies") and len(w) > 3:
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed") and len(w) > 3:
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        cut = w[:-2] if w.endswith("ed") and _has_vowel(w[:-2]) else w[:-3] if w.endswith("ing") and _has_vowel(w[:-3]) else None
        if cut is not None:
            w = cut
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short_end(w):
                w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(w, STEP2, 1)
    w = _replace(w, STEP3, 1)
    for size in (5, 4, 3, 2):
        end = w[-size:]
        if len(w) > size and end in STEP4:
            if _measure(w[:-size]) > 1 and (end != "ion" or w[-4] in "st"):
                w = w[:-size]
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
