"""Text cleaning, one column function per step.

``clean_text`` chains them in order; the result is one Catalyst expression
that runs inside the scan stage, with no UDF and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters deleted, the whitespace split on, the shape of
# a word.  ASCII punctuation keeps ' - and @ for the later steps.
PUNCTUATION = r"""[!"#$%&()*+,./:;<=>?\[\\\]^_`{|}~—“”]+"""
WHITESPACE = r"[\s\u001c-\u001f\u0085\p{Z}]+"
WHITESPACE_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"^\p{L}++(?:-\p{L}++)*+$"


def default_stop_words() -> list[str]:
    """Spark's own English list; needs a running session."""
    return StopWordsRemover.loadDefaultStopWords("english")


def drop_punctuation(text: Column) -> Column:
    """Delete punctuation; the characters around it join up."""
    return F.regexp_replace(text, PUNCTUATION, "")


def lower_tokens(text: Column) -> Column:
    """Lower-case and split on Unicode whitespace; edges may leave ''."""
    return F.split(F.lower(text), WHITESPACE)


def drop_links(tokens: Column) -> Column:
    """Drop tokens that hold ``http``."""
    return F.filter(tokens, lambda w: ~F.contains(w, F.lit("http")))


def cut_apostrophes(tokens: Column) -> Column:
    """Cut each token at its first ', or failing that at its first ’."""
    return F.transform(
        tokens,
        lambda w: F.when(
            F.contains(w, F.lit("'")), F.substring_index(w, "'", 1)
        ).otherwise(F.substring_index(w, "’", 1)),
    )


def keep_words(tokens: Column) -> Column:
    """Keep all-letter tokens and hyphen compounds of letter-only parts."""
    return F.filter(tokens, lambda w: F.rlike(w, F.lit(WORD)))


def drop_stop_words(tokens: Column, stop_words: Sequence[str]) -> Column:
    """Drop stop words and one-character tokens."""
    return F.filter(tokens, lambda w: (F.length(w) > 1) & ~w.isin(list(stop_words)))


def join_tokens(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def clean_text(text: Column, stop_words: Sequence[str] | None = None) -> Column:
    """The whole cleaning chain over the whole text.

    Dropping stop words before testing the word shape gives the same result
    (both only remove tokens) and leaves the regex fewer tokens to test.
    """
    stops = default_stop_words() if stop_words is None else stop_words
    tokens = lower_tokens(drop_punctuation(text))
    tokens = cut_apostrophes(drop_links(tokens))
    return join_tokens(keep_words(drop_stop_words(tokens, stops)))


def strip(text: Column) -> Column:
    """Remove whitespace of every kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE_CHARS))
