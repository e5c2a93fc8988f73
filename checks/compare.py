"""Run the registered queries beside their SQL and compare all rows.

``python -m checks.compare SF_DIR [name ...]``
"""

from __future__ import annotations

import sys
import time

import duckdb

from broadsheet.session import build_session

from .oracles import ORACLES
from .coverage_queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    return value


def sorted_rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, connection, sf_dir: str, name: str) -> str:
    start = time.time()
    result = QUERIES[name](spark, sf_dir)
    got = [tuple(row) for row in result.collect()]
    seconds = time.time() - start
    if name not in ORACLES:
        return f"rows only {len(got)} in {seconds:.2f}s"
    expected = connection.execute(ORACLES[name])
    names = [column[0] for column in expected.description]
    wanted = expected.fetchall()
    if sorted(names) != sorted(result.columns):
        return f"COLUMNS {sorted(result.columns)} != {sorted(names)}"
    mine, theirs = sorted_rows(result.columns, got), sorted_rows(names, wanted)
    if mine == theirs:
        return f"ok {len(got)} rows in {seconds:.2f}s"
    differing = [pair for pair in zip(mine, theirs) if pair[0] != pair[1]][:2]
    return f"DIFFERS {len(mine)} vs {len(theirs)} rows, first {differing}"


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(
        "compare",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    bad = 0
    for name in names or QUERIES:
        try:
            verdict = compare(spark, connection, sf_dir, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            verdict = f"FAILED {type(error).__name__}: {str(error)[:700]}"
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:28s} {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
