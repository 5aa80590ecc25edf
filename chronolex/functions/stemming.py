"""Porter's stems of English words (the algorithm published in 1980)."""

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: the endings of steps 2, 3 and 4, and what takes their place
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """c for each consonant and v for each vowel; y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c", _shape(w)))


def _short(w: str) -> bool:
    """Whether w ends in consonant, vowel, consonant, the last not w, x or y."""
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _swap(w: str, table: dict[str, str], least: int) -> str:
    """w with its longest ending of the table replaced, if what is before it measures over `least`."""
    end = max((e for e in table if w.endswith(e)), key=len, default=None)
    if end is None:
        return w
    base = w[: -len(end)]
    fits = _measure(base) > least and (end != "ion" or base.endswith(("s", "t")))
    return base + table[end] if fits else w


@lru_cache(1 << 16)
def stem(w: str) -> str:
    """The stem of a lower-case word; words of one or two letters, and any with other characters than a-z, stay."""
    if len(w) <= 2 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("s"):  # plurals
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w.endswith("ss") else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        base = w[:-2] if w.endswith("ed") else w[:-3] if w.endswith("ing") else None
        if base is not None and "v" in _shape(base):
            w = base
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w[-1:] == w[-2:-1] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _short(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2, 0), STEP3, 0)
    w = _swap(w, dict.fromkeys(STEP4, ""), 1)
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stems(words: Column) -> Column:
    """An array of words as an array of their stems, in Arrow batches; null for null."""

    @F.pandas_udf("array<string>")
    def each(column: pd.Series) -> pd.Series:
        return column.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return each(words)
