"""Text rules as Column functions: spaces, sentences, tokens, terms, focus alignment.

Patterns are given to Spark as literals built here; \\s is spelled out, as Java's is ASCII only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .lexicon import STOPWORDS

# White space, and patterns that decide the results.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Line ends of all kinds.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
TOKEN = "[A-Za-z가-힣][A-Za-z0-9가-힣'-]*"
SPEAKER = rf"(?s)^([A-Za-z가-힣][A-Za-z0-9가-힣 _.-]{{0,60}})(?U:[\s\x1c-\x1f])*:(?U:[\s\x1c-\x1f])+(.+)$"
SENTENCE_BREAK = r"(?<=[.!?]) "
#: A token without apostrophes at its end that is no participant number (p12).
WORD = "(?![pP][0-9]+'*(?![A-Za-z0-9가-힣'-]))[A-Za-z가-힣](?:[A-Za-z0-9가-힣'-]*[A-Za-z0-9가-힣-])?"
NOT_MATCHED = "[^a-z0-9가-힣-]+"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def filled(c: Column) -> Column:
    """Whether a text has any character that is no white space; false for null."""
    return F.coalesce(c.rlike(f"[^{SPACES}]"), F.lit(False))


def normalize_space(c: Column) -> Column:
    """Every run of white space one space; none at the ends."""
    return F.trim(F.regexp_replace(c, F.lit(f"{SPACE}+"), F.lit(" ")))


def normalize_for_match(c: Column) -> Column:
    """Lower case; all but a-z, digits, Hangul and hyphens is space."""
    return F.trim(F.regexp_replace(F.lower(c), F.lit(NOT_MATCHED), F.lit(" ")))


def sentences(c: Column) -> Column:
    """Array of sentences, each with its closing mark (a full stop where there was none)."""
    pieces = F.array_remove(F.split(normalize_space(c), SENTENCE_BREAK), "")
    return F.transform(pieces, lambda s: F.when(s.rlike("[.!?]$"), s).otherwise(F.concat(s, F.lit("."))))


def words(c: Column) -> Column:
    """All tokens, lower case, without outer apostrophes and participant numbers.

    Tokens hold no space, so they are made lower case joined, not one by one.
    """
    found = F.array_join(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), " ")
    return F.array_remove(F.split(F.lower(found), " "), "")


def word_count(c: Column) -> Column:
    """The number of words()."""
    return F.regexp_count(c, F.lit(WORD))


def content_words(c: Column) -> Column:
    """words() without stopwords and single characters."""
    return F.filter(words(c), lambda t: ~is_stopword(t) & (F.length(t) > 1))


def is_stopword(t: Column) -> Column:
    """A set lookup: Spark turns a long IN of literals into one."""
    return t.isin(*STOPWORDS)


def bound(value: Column, f) -> Column:
    """f(value) with value computed once, however often f's lambdas use it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def grams(tokens: Column, n: int, by: str) -> Column:
    """Array of the runs of n tokens, joined."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(by, *[F.element_at(tokens, i + k) for k in range(n)]))


def vector_terms(c: Column) -> Column:
    """Content words and their runs of two and three; repeats stay."""
    return bound(content_words(c), lambda t: F.concat(t, grams(t, 2, "_"), grams(t, 3, "_")))


def python_words(text: str, keep_stopwords=False) -> list[str]:
    """words() or content_words() of a short setting, on the driver."""
    found = [t.lower().strip("'") for t in re.findall(TOKEN, text)]
    found = [t for t in found if t and not re.fullmatch(r"p\d+", t)]
    return found if keep_stopwords else [t for t in found if t not in STOPWORDS and len(t) > 1]


def alignment(c: Column, focus: str) -> Column:
    """Share of the focus words that the text contains, as part of a word too; 0 without focus."""
    terms = python_words(focus)
    if not terms:
        return F.lit(0.0)
    normal = normalize_for_match(c)
    hits = sum((F.contains(normal, F.lit(_match_form(t))).cast("int") for t in terms), F.lit(0))
    return hits / F.lit(float(len(terms)))


def _match_form(term: str) -> str:
    return re.sub(NOT_MATCHED, " ", term.lower()).strip()


def match_form(text: str) -> str:
    """normalize_for_match of a parameter, on the driver."""
    return re.sub(r"\s+", " ", _match_form(text))


def focus_augmented(c: Column, focus: str) -> Column:
    """The text with the focus twice behind it, if it has any of it."""
    focus = focus.strip()
    if not focus:
        return c
    return F.when(alignment(c, focus) > 0, F.concat_ws(" ", c, F.lit(focus), F.lit(focus))).otherwise(c)
