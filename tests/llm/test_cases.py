"""Ties, repeated rows and texts of three megabytes, operator by operator and stage by stage."""

import corpus_pipeline
import pytest
from test_corpus import prose

from formweave.llm.decontaminate import contaminated
from formweave.llm.html_text import extract_html
from formweave.llm.licenses import license_scan
from formweave.llm.site_quality import site_quality
from formweave.llm.tokens import UnigramCounter, count_tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 9973}" for k in range(450_000))  # about three megabytes


def table(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in texts], DOCS)


def test_equal_scores_of_paths():
    """One piece and two pieces of the same score: the piece that starts first counts."""
    assert UnigramCounter([("▁ab", -2.0), ("▁a", -1.0), ("b", -1.0), ("▁", -9.0), ("a", -9.0)]).count("ab") == 1
    assert UnigramCounter([("▁ab", -2.5), ("▁a", -1.0), ("b", -1.0), ("▁", -9.0), ("a", -9.0)]).count("ab") == 2


def test_scores_at_the_threshold_and_items_that_share_an_id(spark):
    docs = table(spark, [(1, "x a b y"), (1, "x a b y"), (2, "a x b"), (3, "a b c d")])
    items = spark.createDataFrame([(7, "a b c d"), (7, "q a b c"), (8, "a b c d")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in contaminated(docs, items).collect()}
    assert found == {(1, 7): 0.5, (1, 8): 0.5, (3, 7): 1.0, (3, 8): 1.0}


def test_scores_of_one_half_stay(spark):
    docs = table(spark, [(k, prose(k % 3, 30)) for k in range(9)])
    one_kind = spark.createDataFrame([(k, 1) for k in range(9)], "doc_id long, quality int")
    assert all(r["score"] == 0.5 and r["kept"] for r in site_quality(docs, one_kind).collect())
    both = spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, quality int")  # equal texts with both labels
    scores = {}
    for r in site_quality(docs, both).collect():
        scores.setdefault((r["doc_id"] % 3, r["doc_id"] % 2), set()).add((r["text_score"], r["kept"]))
    assert all(len({s for s, _ in own}) == 1 for own in scores.values())


def test_repeated_pages_blocks_and_notices(spark):
    html = "<html><body><article><h1>One title</h1><p>" + prose(1, 60) + ".</p><p>" + prose(1, 60) + ".</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a.org/x", html), (1, "http://a.org/x", html), (2, "http://a.org/y", html)], "page_id long, url string, html string")
    texts = [r["text"] for r in extract_html(pages).collect()]
    assert len(texts) == 3 and len(set(texts)) == 1 and texts[0].count(prose(1, 60)) == 2
    notice = "Released under the MIT License."
    found = license_scan(table(spark, [(1, notice), (1, notice), (2, f"{notice} {prose(2, 30)} {notice}")])).collect()
    assert {(r["licenses"], r["n_notices"]) for r in found} == {("MIT", 1)} and len(found) == 3


def test_texts_of_three_megabytes(spark):
    docs = table(spark, [(1, LONG), (2, LONG + " Released under the MIT License."), (3, None), (4, "x" * 3_000_000)])
    items = spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10")], "item_id long, text string")
    assert {r["doc_id"] for r in contaminated(docs, items).collect()} == {1, 2}
    assert {r["doc_id"]: r["licenses"] for r in license_scan(docs).collect()} == {1: "", 2: "MIT", 3: "", 4: ""}
    counts = {r["doc_id"]: (r["n_tokens"], r["n_chars"]) for r in count_tokens(docs).collect()}
    assert counts[3] == (0, 0) and counts[1][1] == len(LONG) and 0 < counts[1][0] < counts[2][0]
    assert site_quality(docs, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int")).count() == 4
    page = spark.createDataFrame([(1, "http://a.org", "<html><body><article><h1>T</h1><p>" + LONG + "</p></article></body></html>")], "page_id long, url string, html string")
    assert extract_html(page).first()["text"].endswith(LONG[-1000:])


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_long_texts_and_ties(spark, tmp_path, name):
    """Equal rows, equal texts of two ids, a null text, and three megabytes."""
    base = [(1, prose(1, 80)), (1, prose(1, 80)), (2, prose(1, 80)), (3, LONG), (4, None), (5, prose(5, 80) + " write to a.b@c.org")]
    table(spark, base).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(1, 6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "w5 w6 w7 w8 w9 w10")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert found.columns == docs.columns
    ids = sorted(r["doc_id"] for r in found.collect())
    want = {"quality": [1, 1, 2, 3, 4, 5], "near_dedup": [1, 3, 4, 5], "decontaminate": [1, 1, 2, 4, 5], "personal_data": [1, 1, 2, 3, 4, 5]}
    assert ids == want.get(name, ids) and (name != "mix" or set(ids) <= {1, 2, 3, 4, 5})
