"""Check and run the patterns of site rules, in one dialect.

A pattern that does not compile hits nothing; ``first_error`` reports it.
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType, StringType

# Send this function to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def parse_once(udf):
    """Keep the optimizer from pushing a filter on the result below the call.

    Such a filter would make the call a second time.
    """
    return udf.asNondeterministic()


def _pattern_error(patterns: list[str | None]) -> str | None:
    for pattern in patterns:
        try:
            re.compile(pattern or "")
        except re.error as error:
            return f"bad pattern {pattern!r}: {error}"
    return None


@parse_once
@arrow_udf(StringType())
def first_error(patterns: pa.Array) -> pa.Array:
    """What is wrong with the first bad pattern of each row, or NULL."""
    return pa.array([_pattern_error(row or []) for row in patterns.to_pylist()], pa.string())


#: Compiled patterns of a worker.  A plain dict, as a decorated function would
#: be sent by its name and not be found where the package is not installed.
_known: dict[str, re.Pattern | None] = {}
MOST_KNOWN = 10_000


def _compiled(pattern: str) -> re.Pattern | None:
    if pattern not in _known:
        if len(_known) >= MOST_KNOWN:
            _known.clear()
        try:
            _known[pattern] = re.compile(pattern)
        except re.error:
            _known[pattern] = None
    return _known[pattern]


def hit(pattern: str | None, text: str | None) -> bool:
    found = None if pattern is None or text is None else _compiled(pattern)
    return bool(found and found.search(text))


@arrow_udf(BooleanType())
def pattern_hit(texts: pa.Array, patterns: pa.Array) -> pa.Array:
    """Whether the pattern of a row is found in its text; false without either."""
    return pa.array([hit(p, t) for t, p in zip(texts.to_pylist(), patterns.to_pylist())], pa.bool_())


@arrow_udf(BooleanType())
def any_pattern_hit(texts: pa.Array, patterns: pa.Array) -> pa.Array:
    """Whether one of the patterns of a row is found in its text."""
    return pa.array(
        [any(hit(p, t) for p in ps or []) for t, ps in zip(texts.to_pylist(), patterns.to_pylist())], pa.bool_()
    )


def class_hit(pattern: str | None, classes: list[str] | None) -> bool:
    """A hit in one class name or in all of them side by side."""
    return bool(classes) and (any(hit(pattern, c) for c in classes) or hit(pattern, " ".join(classes)))
