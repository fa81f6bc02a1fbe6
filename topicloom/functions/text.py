"""Text expressions.  Each one is a JVM-side column expression without shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import fixed_values as fv

# Unicode classes for \w, \d, \s and \b; the second one also ignores case.
UNICODE = "(?U)"
UNICODE_NOCASE = "(?iU)"
# A character that cannot occur in the text marks sentence ends before splitting.
MARK = "\u0001"


def strip(text: Column) -> Column:
    """Remove all white space, not only blanks, at both ends."""
    return F.regexp_replace(text, UNICODE + r"^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Drop tags and escaped tabs, collapse blanks, keep line breaks, strip."""
    text = F.regexp_replace(text, fv.HTML_TAG, " ")
    text = F.replace(text, F.lit(fv.ESCAPED_TAB), F.lit(" "))
    text = F.regexp_replace(text, fv.BLANKS, " ")
    return strip(text)


def split_paragraphs(text: Column) -> Column:
    """Array of paragraphs; blank lines separate them."""
    return F.split(text, fv.PARAGRAPH_BREAK)


def split_sentences(text: Column, abbreviations: Iterable[str] = ()) -> Column:
    """Array of sentences.

    A sentence ends at ``.``, ``!`` or ``?`` followed by white space.
    ``abbreviations`` (without the final dot) do not end one.
    """
    words = sorted(set(abbreviations))
    guard = ""
    if words:
        alternatives = "|".join(re.escape(w) for w in words)
        guard = rf"(?<!(?iU)\b(?:{alternatives})\.)"
    marked = F.regexp_replace(text, rf"([.!?]){guard}[ \t\r\n]+", "$1" + MARK)
    return F.filter(F.split(marked, MARK), lambda s: F.length(s) > 0)


def has_date(text: Column) -> Column:
    return F.rlike(text, F.lit(UNICODE_NOCASE + fv.DATE))


def has_phone(text: Column) -> Column:
    return F.rlike(text, F.lit(UNICODE + fv.PHONE))


def has_email(text: Column) -> Column:
    return F.rlike(text, F.lit(UNICODE + fv.EMAIL))


def has_homepage(text: Column) -> Column:
    return F.rlike(text, F.lit(UNICODE_NOCASE + fv.HOMEPAGE))


def is_sensitive(text: Column) -> Column:
    """True if the text holds a date, phone number, e-mail or web address."""
    return has_date(text) | has_phone(text) | has_email(text) | has_homepage(text)


def one_line(text: Column) -> Column:
    return strip(F.regexp_replace(text, fv.LINE_BREAKS, " "))


def safe_sentences(text: Column, abbreviations: Iterable[str] = ()) -> Column:
    """Sentences of ``text`` without the sensitive ones, each on one line."""
    kept = F.filter(split_sentences(text, abbreviations), lambda s: ~is_sensitive(s))
    return F.filter(F.transform(kept, one_line), lambda s: F.length(s) > 0)


def tokens(text: Column) -> Column:
    """Lower-case tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(fv.TOKEN), F.lit(0))


def remove_stopwords(words: Column, stopwords: Iterable[str]) -> Column:
    """Drop listed tokens; order and repetitions of the others stay."""
    stopwords = list(stopwords)
    if not stopwords:
        return words
    # isin() over literals is a hash lookup per token, array_contains a scan
    return F.filter(words, lambda w: ~w.isin(stopwords))


def with_ngrams(df: DataFrame, words: str, low: int = 1, high: int = 1, out: str = "terms") -> DataFrame:
    """Add ``out``: all n-grams of the array column ``words`` for n in low..high, joined by a blank.

    Every length is a column of its own, so Spark builds it once per row.
    """
    if not 1 <= low <= high:
        raise ValueError(f"wrong n-gram range ({low}, {high})")
    steps = [words]
    for n in range(2, high + 1):
        # the shorter array is filled up with nulls, and so are the n-grams past the end
        shifted = F.slice(words, n, F.size(words))
        df = df.withColumn(
            f"_{n}grams", F.zip_with(steps[-1], shifted, lambda g, w: F.concat(g, F.lit(" "), w))
        )
        steps.append(f"_{n}grams")
    if high == 1:
        return df.withColumn(out, F.col(words))
    grams = F.filter(F.concat(*steps[low - 1 :]), lambda g: g.isNotNull())
    return df.withColumn(out, grams).drop(*steps[1:])
