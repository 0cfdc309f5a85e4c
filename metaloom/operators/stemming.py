"""Porter's stemmer (M. F. Porter, An algorithm for suffix stripping, 1980), run on a vocabulary."""

from __future__ import annotations

import re

import pandas as pd

# Suffixes of steps 2, 3 and 4.
STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def kinds(word: str) -> str:
    """``c`` or ``v`` for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c", kinds(stem)))


def _ends(word: str, rules: list[tuple[str, str]]) -> str:
    """The longest suffix that fits decides; it goes if enough stands before it."""
    for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if measure(stem) > 0 else word
    return word


def _short_end(stem: str) -> bool:
    return kinds(stem).endswith("cvc") and stem[-1] not in "wxy"


def porter(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in kinds(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and kinds(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _ends(_ends(word, STEP2), STEP3)
    for suffix in sorted([*STEP4, "ion"], key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            if measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                word = stem
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not _short_end(word[:-1])):
        word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def stems(words: pd.Series) -> pd.Series:
    return words.map(porter)
