"""Clock, number and name formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# The stored second format and the run-log minute format.
SECOND_FORMAT = "yyyy-MM-dd HH:mm:ss"
MINUTE_FORMAT = "yyyy-MM-dd HH:mm"


def parse_second(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit(SECOND_FORMAT))


def second_text(moment: Column) -> Column:
    return F.date_format(moment, SECOND_FORMAT)


def minute_text(moment: Column) -> Column:
    return F.date_format(moment, MINUTE_FORMAT)


def dotted_thousands(number: Column) -> Column:
    """1234567 as ``1.234.567``."""
    return F.replace(F.format_number(number, 0), F.lit(","), F.lit("."))


def typed_term(raw: Column) -> Column:
    """A typed name as it is stored: trimmed and in lower case."""
    return F.lower(strip(raw))


def display_name(name: Column) -> Column:
    """Title case, where every run of letters starts with a capital."""
    runs = F.regexp_extract_all(name, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def valid_term(term: Column) -> Column:
    """Letters, hyphens and whitespace only; the empty term passes."""
    return F.rlike(strip(term), F.lit(r"^[\p{L}\s\u001c-\u001f\u0085\p{Z}-]*$"))
