"""Full-text terms: tokens, stop words and English stems."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: English stop words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during before after above below to from up down in out on "
    "off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so "
    "than too very s t can will just don should now"
).split()

_VOWELS = "aeiouy"


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def tokens(text: Column) -> Column:
    """Distinct lower-case words of letters and digits, without stop words."""
    return F.filter(F.array_distinct(words(text)), lambda w: ~w.isin(STOP_WORDS))


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 of the Porter2 algorithm begin."""

    def after(i: int) -> int:
        while i < len(word) and word[i] not in _VOWELS:
            i += 1
        while i < len(word) and word[i] in _VOWELS:
            i += 1
        return min(len(word), i + 1)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short(word: str, r1: int) -> bool:
    v = [c in _VOWELS for c in word]
    ends = (len(word) == 2 and v[0] and not v[1]) or (len(word) > 2 and not v[-3] and v[-2] and not v[-1] and word[-1] not in "wxY")
    return ends and r1 >= len(word)


#: Suffixes of steps 2 to 4 and what they become (null: they go), longest first within a step.
_STEP2 = [
    ("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"),
    ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize al er ic".split()
_WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_KEPT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_KEPT_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}


def stem_word(word: str) -> str:
    """The English stem of a lower-case word (Porter2)."""
    if len(word) <= 2 or word in _KEPT:
        return word
    if word in _WHOLE:
        return _WHOLE[word]
    w = word[1:] if word[0] == "'" else word
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _VOWELS) else c for i, c in enumerate(w))
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT_1A:
        return w
    if w.endswith(("eedly", "eed")):
        n = 5 if w.endswith("eedly") else 3
        w = w[:-n] + "ee" if len(w) - n >= r1 else w
    else:
        n = next((len(s) for s in ("ingly", "edly", "ing", "ed") if w.endswith(s)), 0)
        if n and any(c in _VOWELS for c in w[:-n]):
            w = w[:-n]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and w[-1] in "bdfgmnprt":
                w = w[:-1]
            elif _short(w, r1):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWELS:
        w = w[:-1] + "i"
    for suffix, to in _STEP2:
        if w.endswith(suffix):
            w = w[: -len(suffix)] + to if len(w) - len(suffix) >= r1 else w
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for suffix, to in _STEP3:
        if w.endswith(suffix):
            w = w[: -len(suffix)] + to if len(w) - len(suffix) >= r1 else w
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for suffix in _STEP4:
        if w.endswith(suffix):
            w = w[: -len(suffix)] if len(w) - len(suffix) >= r2 else w
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short(w[:-1], min(r1, len(w) - 1) if r1 < len(w) - 1 else len(w) - 1)):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@functools.lru_cache(65_536)
def known_stem(word: str) -> str:
    """`stem_word` for words that come again and again; a worker remembers 65,536 of them."""
    return stem_word(word)


@F.pandas_udf(T.StringType())
def stem(words: pd.Series) -> pd.Series:
    return words.map(stem_word, na_action="ignore")


def query_terms(query: str, stemmed: bool = True) -> list[str]:
    """The distinct terms of a query, without stop words, as stems or as they are."""
    said = {w for w in re.findall(r"[^\W_]+", query.lower()) if w not in STOP_WORDS}
    return sorted({stem_word(w) for w in said} if stemmed else said)


def _has_stems(words: Column, terms: list[str]) -> Column:
    """Whether the words have every one of these stems. Stemming keeps a word's first letter, so only words that begin like a term are stemmed."""
    first = lambda w: F.substring(w, 1, 1)
    like = F.filter(words, lambda w: first(w).isin(sorted({t[0] for t in terms})) | (first(w) > F.lit("\x7f")))
    wanted = frozenset(terms)

    @F.pandas_udf(T.BooleanType())
    def has(said: pd.Series) -> pd.Series:
        return said.map(lambda some: wanted <= {known_stem(w) for w in some})

    return has(F.array_distinct(like))


def search(df: DataFrame, query: str, *, stemmed: bool = True, id_col: str = "posting_id") -> DataFrame:
    """Rows with an id whose title and description hold every term of the query; a query of stop words only matches nothing. Filters, never ranks.

    With stemming the words of a row that begin like a term are stemmed; without it the terms must be words of the
    text. Each row is judged by itself, in one pass over the texts and without a shuffle.
    """
    terms = query_terms(query, stemmed)
    if not terms:
        return df.limit(0)
    said = words(F.concat_ws("\n", "title", "description"))
    held = _has_stems(F.filter(said, lambda w: ~w.isin(STOP_WORDS)), terms) if stemmed else F.size(F.array_intersect(said, F.array(*[F.lit(t) for t in terms]))) == len(terms)
    return df.where(F.col(id_col).isNotNull() & held)
