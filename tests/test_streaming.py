"""Pages in any order through keyed state, and files of a run as a data source."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from formweave.operators import extract as X
from formweave.operators.rows import PHRASES, visual_rows
from formweave.plans.render import forms
from formweave.plans.template import Node
from formweave.queries import FORM, METADATA, ROCKS, STATE_STORE
from formweave.sources import artifacts as S
from formweave.sources.folder import PUSHDOWN, PhraseFolder
from formweave.streaming.pages import RECORDS, boundary_of, extract_page_stream, read_page_stream, record_cells, row_starts

ROWS = [["Order Report", f"Sheet {p}"] for p in range(1, 26)]


@pytest.fixture
def rocks(spark):
    spark.conf.set(STATE_STORE, ROCKS)
    yield
    spark.conf.unset(STATE_STORE)


@pytest.fixture(scope="module")
def some_forms(spark):
    return forms(spark, "/root/testdata/sf0.001").where("doc_id IN ('forms_1', 'forms_2', 'forms_7')").checkpoint()


def cells_of(frame):
    return sorted(map(repr, frame.select("doc_id", "record_id", "block_id", "block_type", "row_no", "col_no", "key", "value").collect()))


def test_pages_in_any_order_and_any_file(spark, rocks, some_forms, tmp_path):
    """Single pages arrive one file at a time, the last pages first; the cells are those of the batch query."""
    sizes = some_forms.groupBy("doc_id").agg(F.max("page").alias("pages"))
    place = F.pmod(F.xxhash64("doc_id", "page"), F.lit(5))
    some_forms.join(sizes, "doc_id").repartitionByRange(5, place.desc()).write.parquet(f"{tmp_path}/in")
    run = extract_page_stream(read_page_stream(spark, f"{tmp_path}/in", files=1), FORM, f"{tmp_path}/out", f"{tmp_path}/ck", METADATA, ROWS)
    assert run.awaitTermination(200) and run.exception() is None
    assert cells_of(spark.read.parquet(f"{tmp_path}/out")) == cells_of(X.extract_cells(some_forms, FORM, METADATA, ROWS))


def test_a_document_without_news_closes(spark, rocks, some_forms, tmp_path):
    """No number of pages and one page missing: after a quiet while the pages that are there count."""
    gone = some_forms.where("doc_id = 'forms_2' AND page <> 3").withColumn("pages", F.lit(None).cast("int"))
    gone.coalesce(1).write.parquet(f"{tmp_path}/in")
    run = extract_page_stream(read_page_stream(spark, f"{tmp_path}/in"), FORM, f"{tmp_path}/out", f"{tmp_path}/ck", METADATA, ROWS, quiet_ms=2000)
    want = cells_of(X.extract_cells(gone.drop("pages"), FORM, METADATA, ROWS))
    try:
        end, got = time.time() + 120, []
        while time.time() < end and len(got) < len(want):
            time.sleep(1)
            if list(Path(tmp_path).glob("out/*/_SUCCESS")):
                got = cells_of(spark.read.parquet(f"{tmp_path}/out"))
    finally:
        run.stop()
    assert got == want


def test_records_are_extracted_alone(spark, some_forms):
    rows = X.records(visual_rows(some_forms), FORM)
    records = rows.select("doc_id", "record_id", F.explode("cells").alias("c")).select("doc_id", "record_id", F.col("c.idx").alias("phrase_idx"), *(f"c.{n}" for n in ("page", "text", "x0", "y0", "x1", "y1")))
    assert records.schema.simpleString() == spark.createDataFrame([], RECORDS).schema.simpleString()
    assert cells_of(record_cells(records, FORM, METADATA, ROWS)) == cells_of(X.extract_cells(some_forms, FORM, METADATA, ROWS))


def test_rows_and_boundaries_of_a_page():
    at = lambda *ys: [(k, 1, "t", 0.0, a, 0.0, b) for k, (a, b) in enumerate(ys)]
    assert row_starts(at((0, 10), (5, 12), (11, 20))) == [0, 2] and row_starts([]) == []
    kv, table = Node("kv", ("A", "B")), Node("table", ("A", "B"))
    assert boundary_of(["A", "x", "A"], kv) == ["A"] and boundary_of(["x"], kv) is None
    assert boundary_of(["A", "B"], table) == ["A", "B"] and boundary_of(["A", "x"], table) is None


def test_a_run_s_folder_as_a_source(spark, tmp_path):
    texts = ['plain', 'with, comma', 'with "quotes"', "two\nlines", "ß 日本", "12", ""]
    rows = [(d, k, 1 + k // 3, t, 1.5 * k, 2.0, 3.0, 4.0) for d in ("a b", "c:d", "e%f", "g+h") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id string, phrase_idx int, page int, text string, x0 double, y0 double, x1 double, y1 double")
    folder = str(tmp_path / "run")
    S.write_phrases(frame, folder)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(PhraseFolder)
    found = spark.read.format("phrase_folder").load(folder)
    known = {(*r[:3], r[3], *r[4:]) for r in rows}
    assert {tuple(r) for r in found.collect()} == known
    some = found.where("doc_id = 'c:d' AND page >= 2 AND page < 3 AND text <> '12'")
    assert {tuple(r) for r in some.collect()} == {r for r in known if r[0] == "c:d" and r[2] == 2 and r[3] != "12"}
    plan = some._jdf.queryExecution().executedPlan().toString()
    kept = plan.split("BatchScan")[0]  # what Spark still has to filter
    assert "c:d" not in kept and "= 12" in kept and ">= 2" not in kept and "< 3" not in kept and some.rdd.getNumPartitions() == 1
    assert {r["doc_id"] for r in found.where("doc_id IN ('a b', 'g+h', 'none')").collect()} == {"a b", "g+h"}
    words = S.read_words(spark, f"{folder}/*/*.csv")
    assert {r["doc_id"] for r in words.collect()} == {"a b", "c:d", "e%f", "g+h"}


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    """Lines keep their places over batches, and none is moved; where Spark cuts files, a document's pieces meet."""
    rows = [(f"d+{k % 3} %", k // 3, 1, f"t{k}\u00e9, \"q\"", float(k), 0.0, 1.0, 2.0) for k in range(60)]
    S.write_phrases(spark.createDataFrame(rows, PHRASES).repartition(5, "phrase_idx"), str(tmp_path / "w"))
    moved = lambda frame: "Exchange" in frame._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        words = S.read_words(spark, str(tmp_path / "w/*/*.csv"), in_place=True)
        assert sorted(map(tuple, words.collect())) == sorted(rows) and not moved(words)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100b")
        words = S.read_words(spark, str(tmp_path / "w/*/*.csv"), in_place=True)
        assert sorted(map(tuple, words.collect())) == sorted(rows) and moved(words)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_many_files_are_few_parts(spark, tmp_path, monkeypatch):
    """Parts do not grow with the files without end; every file is read."""
    from formweave.sources import folder as D

    monkeypatch.setattr(D, "PARTS", 3)
    rows = [(f"d{k % 10}", k // 10, 1 + k // 20, f"t{k}", 0.0, 0.0, 1.0, 2.0) for k in range(40)]
    S.write_phrases(spark.createDataFrame(rows, PHRASES), str(tmp_path / "w"))
    reader = D.PhraseReader(str(tmp_path / "w"))
    parts = reader.partitions()
    assert len(parts) == 3 and sum(len(p.files) for p in parts) == 10
    got = [tuple(r.values()) for p in parts for batch in reader.read(p) for r in batch.to_pylist()]
    assert sorted(got) == sorted(rows)
