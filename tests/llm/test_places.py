"""Rows are known by the same places in every read, and other columns may have any names."""

import itertools

import pytest
from pyspark.sql import functions as F

from formweave.llm import common, decontaminate, mixing, near_dedup, pii, site_quality

SETTING = "spark.sql.files.minPartitionNum"


@pytest.fixture
def stored(spark, tmp_path):
    """1,000 documents in 7 files: copies of 40 texts, junk, null and repeated ids."""
    r = spark.range(1000).select(
        F.when(F.col("id") % 50 == 3, None).otherwise(F.col("id") % 700).alias("doc_id"),
        F.when(F.col("id") % 9 == 1, F.concat(F.lit("# | # $$ "), F.col("id") % 13)).otherwise(F.concat_ws(" ", *(F.concat(F.lit(f"w{k}x"), (F.col("id") % 40 * (k + 3)) % 97) for k in range(30)))).alias("text"),
        F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), F.lit(7).alias("n_chars"), F.col("id").alias("_row"),
    )
    r.repartition(7, "_row").write.parquet(f"{tmp_path}/some docs.parquet")
    yield spark.read.parquet(f"{tmp_path}/some docs.parquet")
    spark.conf.unset(SETTING)


def shifting(monkeypatch, spark):
    """From now on every cut of lineage changes how the files of the next read are packed."""
    turn = itertools.cycle(["2", "40", "5", "13"])
    cut = common.cut

    def shifted(frame):
        done = cut(frame)
        spark.conf.set(SETTING, next(turn))
        return done

    for module in (common, near_dedup, mixing, site_quality):
        monkeypatch.setattr(module, "cut", shifted)


def test_places_hold(spark, stored):
    table, name = common.placed(stored)
    assert name not in stored.columns and table.columns == [*stored.columns, name]
    found = []
    for n in ("1", "3", "40"):
        spark.conf.set(SETTING, n)
        found.append({r["_row"]: r[name] for r in table.collect()})
        assert {r["_row"]: r[name] for r in table.where("_row > 500").collect()}.items() <= found[0].items()
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) == 1000


def test_places_of_frames_that_are_no_table(spark, stored):
    for frame in (stored.select("text", "_row"), stored.union(stored), spark.range(9), stored.where("_row > 3"), stored.limit(0)):
        table, name = common.placed(frame)
        rows = [r[name] for r in table.collect()]
        assert len(rows) == len(set(rows)) == frame.count()
        assert sorted(rows) == sorted(r[name] for r in table.collect())


def test_stages_when_files_are_packed_anew(spark, stored, monkeypatch):
    labels = spark.createDataFrame([(i, int(i % 9 != 1)) for i in range(700)], "doc_id long, quality int")
    item = stored.where("text not like '#%'").orderBy("text").first()["text"]
    benchmark = spark.createDataFrame([(1, " ".join(item.split()[3:20]))], "item_id long, text string")
    stages = {
        "copies": lambda: near_dedup.without_copies(stored), "rejected": lambda: site_quality.without_rejected(stored, labels),
        "contaminated": lambda: decontaminate.without_contaminated(stored, benchmark), "mixed": lambda: mixing.mixed_documents(stored),
        "op1": lambda: near_dedup.near_duplicates(stored),
    }
    rows = lambda: {k: sorted(map(repr, f().collect())) for k, f in stages.items()}
    still = rows()
    assert 0 < len(still["copies"]) < 1000 and 0 < len(still["rejected"]) < 1000 and 0 < len(still["contaminated"]) < 1000
    shifting(monkeypatch, spark)
    assert rows() == still


def test_any_other_column_names(spark):
    names = ["_phone", "_email", "_g0", "_text", "_runs", "_parts", "_base", "_spans", "_others", "_whole", "_copies", "_row", "_row_path", "a.b", "0", "copies", "size"]
    frame = spark.createDataFrame([(1, "mail ann@example.org now", "s", *("mine",) * len(names)), (None, None, None, *(None,) * len(names))], ["doc_id", "text", "source", *names])
    got = pii.redact(frame).collect()
    assert [r["text"] for r in got] == ["mail [EMAIL] now", None] and all(r[n] == ("mine" if r["doc_id"] else None) for r in got for n in names)
    assert pii.redact(frame.select("text")).columns == ["text"]
    mixed = mixing.mixed_documents(frame).collect()
    assert mixed and all(r[n] == "mine" for r in mixed for n in names if r["doc_id"])


def test_short_items(spark):
    texts = {1: "he asked what is love and left", 2: "what is it", 3: "love", 4: "what  IS\nLove what is love", 5: "", 6: None, 7: "is love what"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    items = spark.createDataFrame([(1, "what is love"), (2, "love"), (3, "is it"), (4, " "), (5, None), (6, "What is LOVE")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["score"], r["n_passages"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert found == {
        (1, 1): (1.0, 1), (1, 6): (1.0, 1), (4, 1): (1.0, 2), (4, 6): (1.0, 2), (1, 2): (1.0, 1), (3, 2): (1.0, 1), (4, 2): (1.0, 2), (7, 2): (1.0, 1), (2, 3): (1.0, 1),
    }
    assert sorted(r["doc_id"] for r in decontaminate.without_contaminated(docs, items.where("item_id = 3")).collect()) == [1, 3, 4, 5, 6, 7]


