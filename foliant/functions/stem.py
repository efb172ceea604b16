"""English stems by M. F. Porter's published algorithm, and stop words."""

from __future__ import annotations

import re

# Function words that a search leaves out.
STOP_WORDS = frozenset(
    "a about above after again all am an and any are as at be because been before being below between both but by can did do does doing down during each few "
    "for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other "
    "our out over own s same she should so some such t than that the their them then there these they this those through to too under until up very was we were "
    "what when where which while who whom why will with you your".split()
)

_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and k > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(s: str) -> int:
    return len(re.findall("v+c+", _shape(s)))


def _short(s: str) -> bool:
    return _shape(s)[-3:] == "cvc" and s[-1] not in "wxy"


def _swap(word: str, pairs) -> str:
    for end, new in sorted(pairs, key=lambda p: -len(p[0])):
        if word.endswith(end):
            base = word[: -len(end)]
            return base + new if _measure(base) > 0 else word
    return word


def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        base = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else w
        if base != w and "v" in _shape(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and len(w) > 2 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=lambda e: -len(e)):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base[-1] in "st"):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or _measure(base) == 1 and not (len(base) > 2 and _short(base)):
            w = base
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w
