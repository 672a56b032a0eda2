"""The corpus pipeline against plain Python: what each stage keeps, on a table of its own."""

import random

import corpus_pipeline
from test_corpus import prose


def test_stages(spark, tmp_path):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(160):
        if i % 8 == 7:
            text = " ".join(f"%%{w}###" for w in prose(i, 60).split())
        else:
            text = ". ".join(prose(i * 31 + k, r.randint(8, 14)) for k in range(7)) + "."
        rows.append([i, text, "en", f"s{i % 4}", len(text)])
        labels.append((i, int(i % 8 != 7), 0))
    bench = [(1, prose(90001, 40, 5000)), (2, prose(90002, 40, 5000))]
    rows[20][1] = rows[10][1]
    rows[30][1] += " " + bench[0][1]
    rows[40][1] += " write to a.b@c.org now."
    spark.createDataFrame([tuple(x) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = {i for i in range(160)}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), want
        ids = [x.doc_id for x in docs.select("doc_id").collect()]
        want = {"quality": {i for i in before if i % 8 != 7}, "near_dedup": before - {20}, "decontaminate": before - {30}}.get(name, before)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name != "mix":
            assert sorted(ids) == sorted(want), name
        else:
            assert set(ids) <= want and max(map(ids.count, ids)) <= 3
    text = spark.read.parquet(str(tmp_path / "personal_data")).where("doc_id = 40").first()
    assert text.text.endswith("write to [EMAIL] now.") and text.n_chars == len(text.text)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def in_table(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, 0) for i in range(4)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(90001, 40, 5000)), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return spark.read.parquet(str(tmp_path / "documents.parquet"))


def test_no_stage_loses_rows_whose_ids_repeat_or_are_null(spark, tmp_path):
    """Four texts of which two share an id and one has none; blank texts; one copy, one contaminated row beside a clean one of its id."""
    texts = [". ".join(prose(k * 31 + j, 11) for j in range(7)) + "." for k in range(4)]
    rows = [(1, texts[0], "en", "s", 1), (1, texts[1], "en", "s", 1), (None, texts[2], None, None, None), (4, texts[3], "en", "s", 1)]
    rows += [(5, None, "en", "s", None), (5, "", "en", None, 0), (None, None, None, None, None), (7, texts[3], "en", "t", 1), (4, texts[3] + " " + prose(90001, 40, 5000), "en", "s", 1)]
    docs = in_table(spark, tmp_path, rows)
    stages = dict(corpus_pipeline.STAGES)
    of = lambda frame: sorted(((x.doc_id, x.text) for x in frame.collect()), key=repr)
    pick = lambda *at: sorted((rows[k][:2] for k in at), key=repr)
    assert of(stages["near_dedup"](spark, docs, str(tmp_path))) == pick(0, 1, 2, 3, 4, 5, 6, 8)
    assert of(stages["decontaminate"](spark, docs, str(tmp_path))) == pick(0, 1, 2, 3, 4, 5, 6, 7)
    assert of(stages["personal_data"](spark, docs, str(tmp_path))) == pick(*range(9))
    mixed = of(stages["mix"](spark, docs, str(tmp_path)))
    assert set(mixed) <= set(pick(*range(9))) and (None, texts[2]) in mixed
    judged = of(stages["quality"](spark, docs.where("n_chars = 1"), str(tmp_path)))
    assert set(judged) <= set(pick(0, 1, 3, 7, 8))


def test_empty_table(spark, tmp_path):
    in_table(spark, tmp_path, [])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() == 0
