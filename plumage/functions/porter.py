"""The stemming algorithm of Porter (1980), by rule tables, over the distinct words of a batch."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CONS = "[^aeiou]"
_VOWEL = "[aeiouy]"
_C = rf"{_CONS}[^aeiouy]*"
_V = rf"{_VOWEL}[aeiou]*"
_M1 = re.compile(rf"^(?:{_C})?{_V}{_C}")
_M_EQ1 = re.compile(rf"^(?:{_C})?{_V}{_C}(?:{_V})?$")
_M2 = re.compile(rf"^(?:{_C})?{_V}{_C}{_V}{_C}")
_HAS_VOWEL = re.compile(rf"^(?:{_C})?{_VOWEL}")
_CVC = re.compile(rf"^{_C}{_VOWEL}[^aeiouwxy]$")
# Suffixes and their replacements of steps 2, 3 and 4.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(w: str, table, when: re.Pattern) -> str:
    for suffix, new in sorted(table, key=lambda t: -len(t[0])):
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            return stem + new if when.match(stem) else w
    return w


@functools.lru_cache(100_000)
def stem(word: str) -> str:
    w = word.lower()
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _M1.match(w[:-3]):
            w = w[:-1]
    else:
        for suffix in ("ed", "ing"):
            base = w[: -len(suffix)]
            if w.endswith(suffix):
                if _HAS_VOWEL.match(base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
                        w = w[:-1]
                    elif _CVC.match(w):
                        w += "e"
                break
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(w, _STEP2, _M1)
    w = _swap(w, _STEP3, _M1)
    for suffix in sorted((*_STEP4, "ion"), key=len, reverse=True):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if _M2.match(base) and (suffix != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e"):
        base = w[:-1]
        if _M2.match(base) or (_M_EQ1.match(base) and not _CVC.match(base)):
            w = base
    if w.endswith("ll") and _M2.match(w[:-1]):
        w = w[:-1]
    return w


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stems(col: pd.Series) -> pd.Series:
    return col.map(lambda ws: None if ws is None else [None if w is None else stem(w) for w in ws])


def stems(words: Column) -> Column:
    """The stems of an array of words; words with other than ASCII letters only go to lower case."""
    return _stems(words)
