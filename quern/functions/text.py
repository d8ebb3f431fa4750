"""Text normalisation as Spark columns, and the same for query strings in Python."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: White space as ECMAScript regular expressions understand it, for Java character classes.
SPACE = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: Its characters.
SPACES = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same within a line, for Java alone: those beyond Latin-1 stand behind one comparison of ranges, so that other letters are not held against each of them.
BLANK = r"[\t\x0B\x0C\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]]"
#: The rest of a line as ECMAScript's dot reads it, and the two sides of an ASCII word.
REST_OF_LINE = r"[^\n\r\u2028\u2029]*"
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


#: Combining marks that the index drops inside words; a letter of a-z with one of them is that letter. Fixed values.
MARKS = "".join(map(chr, (*range(0x300, 0x305), *range(0x306, 0x30D), 0x30F, 0x311, 0x31B, *range(0x323, 0x329), 0x32D, 0x32E, 0x330, 0x331)))


def _fold_letter(letter: str) -> str:
    """A lower-case letter as the index stores it: simple case folding, then a-z without a single mark. Other alphabets keep their marks, and so do letters with two."""
    folded = letter.casefold()
    folded = folded if len(folded) == 1 else letter
    base, *marks = unicodedata.normalize("NFD", folded)
    return base if len(marks) == 1 and marks[0] in MARKS and base.isascii() else folded


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Letters that folding changes, and what they become; the marks that go are at the end of the first."""
    letters = [c for c in map(chr, range(0x80, 0x2200)) if len(c.lower()) == 1 and c.lower() == c and _fold_letter(c) != c]
    return "".join(letters) + MARKS, "".join(map(_fold_letter, letters))


def fold(c: Column) -> Column:
    """Lower case without diacritics on Latin letters, as the index stores it."""
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, *_folds())).otherwise(low)


#: A character of a token: letters, numbers, private use, and code points without a character.
TOKEN = r"[\p{L}\p{N}\p{Co}\p{Cn}]"


def tokens(c: Column) -> Column:
    """Folded runs of token characters, in order."""
    return F.filter(F.split(fold(F.coalesce(c, F.lit(""))), rf"{TOKEN[0]}^{TOKEN[1:]}+"), lambda x: x != "")


def token_count(folded: Column) -> Column:
    """How many tokens a folded text has."""
    return F.regexp_count(folded, F.lit(f"{TOKEN}+"))


def term_count(folded: Column, term: str) -> Column:
    """How many tokens of a folded text are ``term``, a folded token."""
    return F.regexp_count(folded, F.lit(f"(?<!{TOKEN}){term}(?!{TOKEN})"))


def query_terms(query: str) -> list[str]:
    """Words of a query: lower case, punctuation removed inside each word, repeated words kept."""
    pieces = re.split(r"\s+", query.lower())
    return [t for t in ("".join(ch for ch in p if unicodedata.category(ch)[0] in "LN") for p in pieces) if t]


def terms_of(query: Column) -> Column:
    """The same for a column of queries, folded."""
    words = F.transform(F.split(F.lower(F.coalesce(query, F.lit(""))), r"(?U)\s+"), lambda w: fold(F.regexp_replace(w, r"[^\p{L}\p{N}]+", "")))
    return F.filter(words, lambda w: w != "")


def fold_term(term: str) -> str:
    """A query term as the index stores it."""
    letters, to = _folds()
    return term.lower().translate(str.maketrans(letters[: len(to)], to, MARKS))


def norm_key(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 dropped: the key under which titles and citations are compared."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def norm_key_of(text: str) -> str:
    return re.sub("[^a-z0-9]+", "", text.lower())


def trim_space(c: Column) -> Column:
    """Without white space at either end, in the wider sense of SPACE."""
    return F.btrim(c, F.lit(SPACES))


def normalise_whitespace(c: Column) -> Column:
    """Unix line ends, no blanks around line ends, at most one blank line, single blanks inside lines, trimmed."""
    for pattern, to in (("\r\n", "\n"), ("[ \t]+\n", "\n"), ("\n[ \t]+", "\n"), ("\n{3,}", "\n\n"), ("[ \t]{2,}", " "), ("(?m)^[ \t]+", "")):
        c = F.regexp_replace(c, pattern, to)
    return trim_space(c)


def content_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 text, lower-case hexadecimal."""
    return F.sha2(c.cast("binary"), 256)


def first_iso_date(c: Column) -> Column:
    """The first thing shaped like an ISO date, unchecked; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0), F.lit(""))


def leading_int(c: Column) -> Column:
    """The integer that a text starts with, else 0."""
    return F.coalesce(F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1).try_cast("long"), F.lit(0).cast("long"))


def strip_provision_prefix(c: Column) -> Column:
    """A provision number without a leading ``Art.`` or ``Sec.``; longer spellings keep their tail, as the first alternative wins."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?i)^(art\.?\s*|article\s+|sec\.?\s*|section\s+)", ""))
