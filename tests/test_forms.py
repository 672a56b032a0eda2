"""Rendered forms: long orders, and how often their phrases are moved."""

from pathlib import Path
from random import Random

import duckdb
import pytest
from pyspark.sql import functions as F

from formweave.api import Engine
from formweave.plans import render
from formweave.operators.rows import PHRASES, visual_rows
from formweave.queries import ORACLES, QUERIES
from formweave.sources import artifacts as S
from formweave.streaming.pages import row_starts

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["form_extract_lines", "form_extract_nested", "form_extract_learned_nested", "form_extract_learned_deep"])
def test_orders_of_many_lines(spark, tmp_path, name):
    """Records that are longer than a page's usual share do not run into the one below."""
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").where("l_orderkey < 150").withColumn("l_orderkey", F.when(F.col("l_orderkey") > 140, 120).otherwise(F.col("l_orderkey")))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.read.parquet(f"{FOLDER}/orders.parquet").where("o_orderkey < 150").write.parquet(str(tmp_path / "orders.parquet"))
    assert lines.where("l_orderkey = 120").count() > 20
    tables = duckdb.connect()
    for table in ("lineitem", "orders"):
        tables.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    want = tables.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    got = [tuple(r[n] for n in names) for r in QUERIES[name](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["form_extract_lines", "record_spans", "table_columns", "row_texts", "line_phrases", "legacy_phrases", "position_vectors"])
def test_orders_and_lines_are_moved_once(spark, name):
    """Phrases, of which a line has seven, are not."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange ") == 1


@pytest.mark.parametrize("name", ["form_extract_lines", "form_extract_nested"])
def test_rows_are_copied_by_few_windows(spark, name):
    """A window copies all rows: columns of a block share one, however many there are."""
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert 0 < plan.count("Window [") <= 9


def test_rows_of_boxes_that_neither_stand_level_nor_apart(spark):
    """Pages with and without a fold have the rows of a plain walk, in one document too, with boxes upside down and without a height."""
    draw, found = Random(3), []
    for page in range(1, 41):
        step = draw.choice([1, 4, 12])  # so that some pages' rows are all level or apart
        boxes = [(y := draw.randrange(0, 60, step), y + draw.choice([-2, 0, 3, 10])) if page % 4 else (12 * (k // 3), 12 * (k // 3) + 10) for k in range(draw.randrange(1, 30))]
        found += [("a" if page % 2 else "b", len(found) + k, page, "t", 10.0 * k, float(a), 10.0 * k + 5, float(z)) for k, (a, z) in enumerate(boxes)]
    rows = [r for r in visual_rows(spark.createDataFrame(found, PHRASES)).collect()]
    want = {}
    for doc in "ab":
        for page in sorted({p[2] for p in found if p[0] == doc}):
            cells = [p[1:] for p in found if p[0] == doc and p[2] == page]
            starts = row_starts(cells)
            for s, e in zip(starts, [*starts[1:], len(cells)]):
                own = want.setdefault(doc, [])
                own.append((len(own), page, [c[0] for c in cells[s:e]]))
    for doc in "ab":
        assert sorted((r.row_id, r.page, [c.idx for c in r.cells]) for r in rows if r.doc_id == doc) == want[doc]


@pytest.mark.parametrize("name", ["template_learned", "edit_template", "template_learned_asked", "form_extract_learned_nested"])
def test_only_the_sample_is_rendered_to_learn_from(spark, monkeypatch, name):
    seen, predict = [], Engine.predict_field

    def predicted(self, phrases, *args, **more):
        seen.append(sorted(r.doc_id for r in phrases.select("doc_id").distinct().collect()))
        return predict(self, phrases, *args, **more)

    monkeypatch.setattr(Engine, "predict_field", predicted)
    QUERIES[name](spark, FOLDER)
    every = sorted(r.doc_id for r in QUERIES["rendered_phrases"](spark, FOLDER).select("doc_id").distinct().collect())
    assert seen == [every[:5]] and len(every) > 5


@pytest.mark.parametrize("name", ["exchange_phrases", "exchange_words"])
def test_phrases_are_written_where_they_lie(spark, monkeypatch, name):
    """A document's phrases are in one part already, and are not dealt again to be written; each document is one file."""
    moved, deal = [], type(spark.range(0)).repartition

    def dealt(self, *args):
        moved.append(set(self.columns))
        return deal(self, *args)

    written = []
    monkeypatch.setattr(type(spark.range(0)), "repartition", dealt)
    monkeypatch.setattr(S, "write_phrases", lambda phrases, path, *args, write=S.write_phrases, **more: (written.append(path), write(phrases, path, *args, **more)))
    QUERIES[name](spark, FOLDER)
    assert moved and not any("phrase_idx" in columns for columns in moved)
    files = [len(list(folder.glob("*.csv"))) for folder in Path(written[0].removeprefix("file:")).glob("doc_id=*")]
    assert len(files) == 30 and set(files) == {1}


def test_parts_keep_to_a_task_s_memory(spark):
    """F40-F45: a part holds few enough lines that what is sorted of their phrases is not spilled."""
    lines = spark.range(400_000)
    assert render._parts(spark, lines) >= 10


def test_rows_are_taken_apart_once(spark):
    """F34-F39: no filter repeats what takes pages, rows and cells apart, and finds headers."""
    from formweave import queries as Q

    plan = Q.form_extract_lines(spark, FOLDER)._jdf.queryExecution().optimizedPlan()
    filters = [line for line in plan.toString().splitlines() if "Filter " in line.split("[", 1)[0]]
    assert filters and not [f for f in filters if "lambda" in f]


def test_wide_rows_are_compared_as_narrow_ones(spark):
    """A row of more values than the template's tables have fields is judged by the same rule."""
    from formweave.operators.extract import _one_to_one

    for at, expected in (([0.0, 20.0, 40.0], True), ([0.0, 20.0, 25.0], False), ([0.0, 20.0, 60.0], False)):
        header = [(x, x + 10) for x in (0.0, 20.0, 40.0)]
        frame = spark.createDataFrame([(header, [(x, x + 10) for x in at])], "k array<struct<x0:double,x1:double>>, v array<struct<x0:double,x1:double>>")
        for columns in (1, 3, 7):
            assert frame.selectExpr(_one_to_one("k", "v", columns)).first()[0] is expected


def test_keyword_questions_are_rendered_once(spark):
    """what is asked is kept; replies meet it without a second rendering."""
    from formweave import queries as Q

    for query in (Q.asked_keywords, Q.asked_spellings):
        assert "l_orderkey" not in query(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_layouts_are_extracted_where_their_documents_lie(spark):
    """the phrases of two layouts are neither kept nor dealt by document once more."""
    from formweave import queries as Q

    plan = Q.extract_two_layouts(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "LogicalRDD" in line and "phrase_idx" in line]
    assert sum("RepartitionByExpression" in line for line in plan) == 2  # orders and lines, for each layout


@pytest.mark.parametrize("name, kind", [("form_extract_kv", "kv"), ("kv_explode", "kv"), ("exchange_records", "kv"), ("form_extract_lines", "table"), ("table_pivot", "table")])
def test_blocks_that_are_not_asked_for_are_not_taken_apart(spark, monkeypatch, name, kind):
    """rows of the other blocks are numbered and go."""
    from formweave.operators import extract as X

    seen = []
    monkeypatch.setattr(X, "block_cells", lambda rows, template, cells=X.block_cells: (seen.append({r[0] for r in rows.select("block_type").distinct().collect()}), cells(rows, template))[1])
    QUERIES[name](spark, FOLDER)
    assert seen == [{kind}]


def test_exchanged_records_are_compressed(spark, monkeypatch):
    """a document's records are one file, a block of the disk for most."""
    written = []
    monkeypatch.setattr(S, "write_nested", lambda nested, path, *args, write=S.write_nested: (written.append(path), write(nested, path, *args)))
    QUERIES["exchange_records"](spark, FOLDER)
    assert len(list(Path(written[0].removeprefix("file:")).glob("doc_id=*/*.json.gz"))) == 30
