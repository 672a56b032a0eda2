"""Corpus queries against DuckDB on the smallest tables, rows compared as multisets."""

import os
from pathlib import Path

import duckdb
import pytest

from formweave.llm.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def comparable(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    tables = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        tables.execute(f"create view {path.stem} as select * from '{path}'")
    want = tables.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    found = QUERIES[name](spark, FOLDER)
    assert sorted(found.columns) == sorted(names)
    got = [tuple(r[n] for n in names) for r in found.collect()]
    assert sorted(map(comparable, got), key=repr) == sorted(map(comparable, want.fetchall()), key=repr)
