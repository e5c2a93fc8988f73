"""How often a term occurs in one cleaned text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def tokens(content: Column) -> Column:
    return F.split(content, " ")


def count_word(content: Column, word: Column | str) -> Column:
    """Tokens equal to ``word``.  Texts without it are never split."""
    wanted = _column(word)
    exact = F.size(F.filter(tokens(content), lambda t: t == wanted)).cast("long")
    return F.when(F.contains(content, wanted), exact).otherwise(F.lit(0).cast("long"))


def count_phrase(content: Column, phrase: Column | str) -> Column:
    """Non-overlapping matches of ``phrase`` anywhere, also inside words."""
    wanted = _column(phrase)
    removed = F.length(content) - F.length(F.replace(content, wanted, F.lit("")))
    return F.when(
        F.contains(content, wanted) & (F.length(wanted) > 0),
        F.floor(F.try_divide(removed, F.length(wanted))).cast("long"),
    ).otherwise(F.lit(0).cast("long"))


def count_bounded_phrase(content: Column, phrase: Column | str) -> Column:
    """Matches of ``phrase`` that begin and end at a word boundary.

    ``(?U)`` makes the boundary know letters beyond ASCII.
    """
    wanted = _column(phrase)
    pattern = F.concat(F.lit(r"(?U)\b\Q"), wanted, F.lit(r"\E\b"))
    return F.when(
        F.contains(content, wanted) & (F.length(wanted) > 0),
        F.regexp_count(content, pattern).cast("long"),
    ).otherwise(F.lit(0).cast("long"))


def count_term(content: Column, term: str) -> Column:
    """A phrase counts bounded matches, a single word counts equal tokens."""
    return count_bounded_phrase(content, term) if " " in term else count_word(content, term)
