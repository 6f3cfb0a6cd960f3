"""The Porter stemmer, from the published algorithm (M. F. Porter, 1980)."""

from __future__ import annotations

import re


# Fixed values of the algorithm: suffix and what replaces it.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = (
    "ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou",
)


def _letters(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    kinds = ""
    for ch in word:
        kinds += "v" if ch in "aeiou" or (ch == "y" and kinds.endswith("c")) else "c"
    return kinds


def _m(stem: str) -> int:
    return len(re.findall("v+c+", _letters(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _letters(word)[-1] == "c"


def _short(word: str) -> bool:
    return _letters(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    """Stem of a lower-case ASCII word; other words and those of one or two letters stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _m(word[:-3]) > 0:
            word = word[:-1]
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in _letters(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _m(word) == 1 and _short(word):
                    word += "e"
                break
            if word.endswith(end):
                break
    if word.endswith("y") and "v" in _letters(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP2, STEP3):
        for end, new in table:
            if word.endswith(end):
                if _m(word[: -len(end)]) > 0:
                    word = word[: -len(end)] + new
                break
    for end in STEP4:
        if word.endswith(end):
            base = word[: -len(end)]
            if _m(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e") and (_m(word[:-1]) > 1 or (_m(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and _m(word) > 1:
        word = word[:-1]
    return word
