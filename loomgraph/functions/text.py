"""Tokens of queries and identifiers, stop words and English stems."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that natural-language queries do without.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from is it that this are was be has had have do does did will would could should may might can shall not no all each every "
    "how what where when who which why i me my we our you your he she they show give tell been done made used using work works found also into then than just more some such over only out "
    "its so up as if look need needs want happen happens"
).split()
CAMEL_QUERY = r"[A-Z][a-z0-9]+|[A-Z]+(?=[A-Z]|$)|[a-z0-9]+"
CAMEL_RANK = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"


def index_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, as the full-text index has them."""
    plain = F.lower(F.translate(F.coalesce(text, F.lit("")), "İ", "i"))  # the one letter whose lower case is two
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(text: Column) -> Column:
    """Words of a query and their camel-case parts, each once by lower case, in order."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    parts = F.transform(words, lambda w: F.concat(F.array(w), F.regexp_extract_all(w, F.lit(CAMEL_QUERY), F.lit(0))))
    return F.array_distinct(F.transform(F.flatten(parts), F.lower))


def rank_tokens(text: Column, stem: bool = False) -> Column:
    """The set of tokens by which hits are scored: words but stop words, camel-case parts, and stems."""
    words = F.filter(F.split(text, r"[^A-Za-z0-9]+"), lambda w: (w != "") & ~F.lower(w).isin(STOP_WORDS))
    parts = F.transform(words, lambda w: F.concat(F.array(w), F.regexp_extract_all(w, F.lit(CAMEL_RANK), F.lit(0))))
    plain = F.array_distinct(F.transform(F.flatten(parts), F.lower))
    return F.array_distinct(F.concat(plain, stems(plain))) if stem else plain


def without_stop_words(text: Column) -> Column:
    """Words but stop words, each once, stemmed if they are plain English words; all words if nothing is left."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    kept = F.filter(words, lambda w: ~F.lower(w).isin(STOP_WORDS))
    out = F.array_distinct(stems(kept))
    return F.when(F.size(out) > 0, F.array_join(out, " ")).otherwise(text)


_VOWEL = "aeiouy"
_DOUBLE = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic"]
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
_AFTER_1A = set("inning outing canning herring earring proceed exceed succeed".split())


@lru_cache(100_000)
def porter2(word: str) -> str:
    """The published English (Porter2) stemming algorithm for one lower-case word."""
    if len(word) <= 2:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word.lstrip("'")
    w = re.sub(r"(?<=[aeiouy])y|^y", "Y", w)
    vowel = lambda c: c in _VOWEL

    def region(s: str, start: int) -> int:
        for i in range(start + 1, len(s)):
            if not vowel(s[i]) and vowel(s[i - 1]):
                return i + 1
        return len(s)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = region(w, 0) if r1 is None else r1
    r2 = region(w, r1)

    def short(s: str) -> bool:
        if len(s) == 2:
            return vowel(s[0]) and not vowel(s[1])
        return len(s) >= 3 and not vowel(s[-3]) and vowel(s[-2]) and not vowel(s[-1]) and s[-1] not in "wxY"

    w = re.sub(r"('s'|'s|')$", "", w)  # step 0
    if w.endswith("sses"):  # step 1a
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(map(vowel, w[:-2])):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):  # step 1b
        if w.endswith(end):
            if end in ("eedly", "eed"):
                if len(w) - len(end) >= r1:
                    w = w[: -len(end)] + "ee"
            elif any(map(vowel, w[: -len(end)])):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLE):
                    w = w[:-1]
                elif short(w) and len(w) <= r1:
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and not vowel(w[-2]):  # step 1c
        w = w[:-1] + "i"
    for end, to in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, to in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + to
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):  # step 5
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Plain lower-case words stemmed; other words in lower case."""
    for part in words:
        yield part.map(lambda ws: None if ws is None else [porter2(w) if w.isalpha() and w == w.lower() else w.lower() for w in ws])
