"""Queries against DuckDB on the smallest tables, rows compared as multisets."""

import os
from pathlib import Path

import duckdb
import pytest

from formweave.functions.lineage import shared_folder
from formweave.queries import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def comparable(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"subphrases", "cluster_ci"}))
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


def same_rows(spark, name):
    tables = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        tables.execute(f"create view {path.stem} as select * from '{path}'")
    want = tables.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = [tuple(r[n] for n in names) for r in QUERIES[name](spark, FOLDER).collect()]
    assert sorted(map(comparable, got), key=repr) == sorted(map(comparable, want.fetchall()), key=repr)
    return got


def test_subphrases_of_whole_texts(spark):
    found = {r[0] for r in same_rows(spark, "subphrases")}
    texts = [r.text for r in QUERIES["rendered_phrases"](spark, FOLDER).select("text").distinct().collect()]
    assert found == {" ".join(t[i:j]) for t in map(str.split, texts) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}


def test_intervals_of_all_orders(spark):
    sizes = {}
    for _, n, _, half in same_rows(spark, "cluster_ci"):
        sizes[n] = sizes.get(n, 0) + 1
        assert (half is None) == (n == 1)
    orders = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert sum(sizes.values()) == orders and min(sizes) == 1 and max(sizes) > 7


def test_template_of_the_first_document_there_is(spark, tmp_path):
    for path in Path(FOLDER).glob("*.parquet"):
        rows, key = spark.read.parquet(str(path)), {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(path.stem)
        (rows.where(f"{key} >= 50") if key else rows.limit(0)).write.parquet(str(tmp_path / path.name))
    same = duckdb.sql(ORACLES["template_learned"]).fetchall()
    assert sorted(map(tuple, QUERIES["template_learned"](spark, str(tmp_path)).collect())) == sorted(same)


def test_counted_calls_leave_no_prompts_behind(spark):
    """The prompts of both kinds are rendered once each, and these and the memos are gone when the calls are counted."""
    shared = Path(shared_folder(spark))
    before = {f for f in shared.rglob("*") if f.is_file()}
    found = {r.kind: r for r in QUERIES["model_calls"](spark, FOLDER).collect()}
    assert {f for f in shared.rglob("*") if f.is_file()} == before
    assert all(r.prompts == r.calls > 1000 and r.again == 0 for r in found.values()) and set(found) == {"rows", "pairs"}
