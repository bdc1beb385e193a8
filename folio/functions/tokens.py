"""Folding and tokenising. Unicode decomposition has no built-in function, so the fold is an Arrow UDF;
the base tokens and their forms are also there as Column expressions for text that is already folded."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.config import CASE_MARK, CASED_MOST, FUNCTION_WORDS, GLUED_MOST

# A token, where it splits, and a thousands dot.
TOKEN = r"[0-9a-z]+(?:[./,\-][0-9a-z]+)*"
SPLIT = r"[-/]"
THOUSANDS = r"(?<=\d)\.(?=\d{3}(?:\D|$))"
_TOKEN, _SPLIT, _THOUSANDS = map(re.compile, (TOKEN, SPLIT, THOUSANDS))
_STOP = frozenset(FUNCTION_WORDS)


@lru_cache(1 << 16)
def fold_char(c: str) -> str:
    """A character without case, accents and compatibility forms (both micro signs are u)."""
    if c in "µμ":
        return "u"
    return "".join(x for x in unicodedata.normalize("NFKD", c).replace("μ", "u") if not unicodedata.combining(x)).casefold()


def fold_text(t: str) -> str:
    return t.lower() if t.isascii() else "".join(map(fold_char, t))


def forms(token: str) -> list[str]:
    """The token, then without thousands dots, its segments, and glued if it is short and has a letter."""
    plain = lambda s: _THOUSANDS.sub("", s)
    out = {token: None, plain(token): None}
    parts = [s for s in _SPLIT.split(token) if s]
    if len(parts) > 1:
        out |= {x: None for s in parts for x in (s, plain(s))}
        glued = _SPLIT.sub("", plain(token))
        if len(glued) <= GLUED_MOST and re.search("[a-z]", glued):
            out[glued] = None
    return list(out)


_forms = lru_cache(1 << 18)(lambda t: tuple(forms(t)))


def tokenize(text: str | None) -> list[str]:
    """All tokens of a text in order: each with its forms, then in its own case if short and not lower-case."""
    if not text:
        return []
    folded = fold_text(text)
    if len(folded) == len(text) and all(len(fold_char(c)) == 1 for c in set(text)):
        at = None
    else:  # a character may fold to none or several
        at = [i for i, c in enumerate(text) for _ in fold_char(c)]
    out: list[str] = []
    for m in _TOKEN.finditer(folded):
        out += _forms(m[0])
        raw = text[m.start() : m.end()] if at is None else text[at[m.start()] : at[m.end() - 1] + 1]
        if len(raw) <= CASED_MOST and any(map(str.isupper, raw)):
            out.append(raw + CASE_MARK)
    return out


def is_function_word(token: str) -> bool:
    return (fold_text(token.removesuffix(CASE_MARK)) if token.endswith(CASE_MARK) else token) in _STOP


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(fold_text, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokens(text: pd.Series) -> pd.Series:
    return text.map(tokenize)


@F.pandas_udf(T.ArrayType(T.StringType()))
def query_tokens(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [x for x in tokenize(t) if not is_function_word(x)])


def base_tokens(folded: Column) -> Column:
    """Whole tokens of folded text."""
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def without_thousands(c: Column) -> Column:
    return F.regexp_replace(c, THOUSANDS, "")


def token_forms(token: Column) -> Column:
    """The forms of a folded token as an array, the whole token first."""
    parts = F.filter(F.split(token, SPLIT), lambda s: s != "")
    glued = F.regexp_replace(without_thousands(token), SPLIT, "")
    short = F.when((F.length(glued) <= GLUED_MOST) & glued.rlike("[a-z]"), F.array(glued)).otherwise(F.array().cast("array<string>"))
    more = F.concat(F.flatten(F.transform(parts, lambda s: F.array(s, without_thousands(s)))), short)
    return F.array_distinct(F.concat(F.array(token, without_thousands(token)), F.when(F.size(parts) > 1, more).otherwise(F.array().cast("array<string>"))))


def drop_function_words(tokens: Column) -> Column:
    """Folded tokens without function words."""
    stop = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))
