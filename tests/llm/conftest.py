import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from ``(doc_id, text)`` or longer tuples, with an extra column whose name clashes."""

    def make(rows, extra="size string"):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None, "own") for r in rows]
        return spark.createDataFrame(full, f"{DOCUMENTS}, {extra}")

    return make
