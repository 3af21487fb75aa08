"""Stems of English words after Porter's published algorithm (1980), for full-text search.

Words of one or two letters, and those with other than the letters a to z, are their own stems.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of the algorithm's steps with what they become; the longest that fits a word decides its step.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")

_PLAIN = re.compile(r"[a-z]{3,}")


def kinds(word: str) -> str:
    """``c`` or ``v`` for each letter; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or ch == "y" and out.endswith("c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    return kinds(stem).count("vc")


def _short(word: str) -> bool:
    return kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and kinds(word).endswith("c")


def _replace(word: str, table: dict[str, str], least: int) -> str:
    suffix = max((s for s in table if word.endswith(s)), key=len, default=None)
    if suffix is None or measure(word[: -len(suffix)]) <= least:
        return word
    return word[: -len(suffix)] + table[suffix]


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    if not _PLAIN.fullmatch(word):
        return word
    # Plurals, past and progressive forms.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) > 0 else word
    elif (cut := next((n for s, n in (("ed", 2), ("ing", 3)) if word.endswith(s)), 0)) and "v" in kinds(word[:-cut]):
        word = word[:-cut]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
        elif measure(word) == 1 and _short(word):
            word += "e"
    if word.endswith("y") and "v" in kinds(word[:-1]):
        word = word[:-1] + "i"
    # Suffixes of suffixes, then one suffix as a whole.
    word = _replace(_replace(word, STEP2, 0), STEP3, 0)
    suffix = max((s for s in STEP4 if word.endswith(s)), key=len, default=None)
    if suffix is not None and measure(word[: -len(suffix)]) > 1 and (suffix != "ion" or word[-4] in "st"):
        word = word[: -len(suffix)]
    # A last e, and a double l.
    if word.endswith("e"):
        m = measure(word[:-1])
        word = word[:-1] if m > 1 or m == 1 and not _short(word[:-1]) else word
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word


def stems(words: Column) -> Column:
    """Stems of an array of lower-case words."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ws: [stem(w) for w in ws], na_action="ignore")

    return run(words)
