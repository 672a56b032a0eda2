"""Pages of many phrases: neighbours by strips and joins by ground phrases, against plain loops."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from formweave.operators import phrases as P


def plain_overlap(a, b):
    shared = min(a[1], b[1]) - max(a[0], b[0])
    return shared > 0 and shared >= 0.2 * min(a[1] - a[0], b[1] - b[0])


def boxes(r, n, kind):
    if kind == "columns":
        return [(100.0 * c, 100.0 * c + r.randint(5, 99)) for c in (r.randrange(6) for _ in range(n))]
    if kind == "wide":
        return [(x, x + r.choice([1.0, 30.0, 900.0])) for x in (r.uniform(0, 1000) for _ in range(n))]
    return [(7.0, 7.0 + r.choice([0.0, 0.0, 1.0])) for _ in range(n)]  # ties and boxes without width


@pytest.mark.parametrize("kind", ["columns", "wide", "points"])
@pytest.mark.parametrize("n", [0, 1, 2, 5, 300])
def test_first_later_boxes_against_all(kind, n):
    found = boxes(random.Random(n), n, kind)
    x0, x1 = np.array([a for a, _ in found], float), np.array([b for _, b in found], float)
    known = [next((j for j in range(i + 1, n) if plain_overlap(found[i], found[j])), -1) for i in range(n)]
    assert P.first_later(x0, x1) == known


def plainly_merged(page, accepts):
    free, out = [True] * len(page), []
    for i, (text, x0, y0, x1, y1) in enumerate(page):
        if not free[i]:
            continue
        m = (text, x0, y0, x1, y1)
        for j in range(i + 1, len(page)):
            t, a, b, c, d = page[j]
            if free[j] and plain_overlap((a, c), (m[1], m[3])):
                if not accepts(m, t, b, d):
                    break
                free[j], m = False, (f"{m[0]} {t}", min(m[1], a), min(m[2], b), max(m[3], c), max(m[4], d))
        out.append(m)
    return out


def layout(r, n, words):
    return [(" ".join(r.choices(words, k=r.randint(1, 2))), x, 14.0 * k, x + r.randint(10, 150), 14.0 * k + 10) for k, x in enumerate(100.0 * r.randrange(4) for _ in range(n))]


@pytest.mark.parametrize("seed", range(3))
def test_merging_against_loops(spark, seed):
    r = random.Random(seed)
    words = ["net", "gross", "sum", "total", "of", "tax"]
    ground = [" ".join(r.choices(words, k=r.randint(1, 6))) for _ in range(12)] + ["  net   sum  "]
    pages = {(f"d{d}", p): layout(r, 60, words) for d in range(2) for p in (1, 2)}
    rows = [(d, p, k, *x) for (d, p), page in pages.items() for k, x in enumerate(page)]
    frame = spark.createDataFrame(rows, "doc_id string, page int, phrase_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    runs = {" ".join(g.split()[i:j]) for g in ground for i in range(len(g.split())) for j in range(i + 1, len(g.split()) + 1)}
    for found, accepts in (
        (P.merge_by_ground(frame, ground), lambda m, t, y0, y1: f"{m[0]} {t}" in runs),
        (P.merge_by_distance(frame, 30.0), lambda m, t, y0, y1: max(0.0, y0 - m[4], m[2] - y1) <= 30.0),
    ):
        got = {}
        for x in found.orderBy("doc_id", "phrase_idx").collect():
            got.setdefault((x["doc_id"], x["page"]), []).append((x["text"], x["x0"], x["y0"], x["x1"], x["y1"]))
        assert got == {k: plainly_merged(page, accepts) for k, page in pages.items()}
    positive = {(x["doc_id"], x["a"], x["b"]) for x in P.labelled_pairs(frame, ground).where("is_positive").collect()}
    known = set()
    for (d, p), page in pages.items():
        for i, a in enumerate(page):
            j = next((j for j in range(i + 1, len(page)) if plain_overlap((a[1], a[3]), (page[j][1], page[j][3]))), None)
            if j is not None and a[0] not in ground and f"{a[0]} {page[j][0]}" in runs:
                known.add((d, i, j))
    offset = {(d, p): 0 for d, p in pages}
    assert positive == {(d, i + offset[d, 1], j + offset[d, 1]) for d, i, j in known}


def test_a_page_of_twenty_thousand_phrases():
    r = random.Random(5)
    page = pd.DataFrame([("t", x, 14.0 * (k // 8), x + r.randint(20, 95), 14.0 * (k // 8) + 10) for k, x in ((k, 100.0 * (k % 8)) for k in range(20_000))], columns=["text", "x0", "y0", "x1", "y1"])
    start = time.time()
    later = P.first_later(page["x0"].to_numpy(), page["x1"].to_numpy())
    merged = P._merged(page.assign(doc_id="d", page=1), lambda m, j: False)
    assert later[:-8] == [k + 8 for k in range(19_992)] and len(merged) == 20_000 and time.time() - start < 10


def test_a_ground_text_of_five_thousand_words(spark):
    words = [f"w{k}" for k in range(5000)]
    rows = [("d", 1, k, " ".join(words[100 * k : 100 * k + 100]), 0.0, 14.0 * k, 90.0, 14.0 * k + 10) for k in range(50)]
    frame = spark.createDataFrame(rows, "doc_id string, page int, phrase_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    ground = P.ground_table(frame, [" ".join(words)])
    assert P._seams(ground).count() == 4999  # a row for each seam of tokens
    assert [r["text"] for r in P.merge_by_ground(frame, ground).collect()] == [" ".join(words)]


@pytest.mark.parametrize("near", [1, 3, 256])
def test_overlaps_of_many_pages_at_once(spark, monkeypatch, near):
    """Pages that cross batches, and pages longer than what is compared at once, against plain loops."""
    monkeypatch.setattr(P, "NEAR", near)
    r = random.Random(near)
    pages = {(f"d{k % 3}", k): boxes(r, r.choice([1, 2, 40]), kind) for k, kind in enumerate(["columns", "wide", "points"] * 6)}
    want = {(p, i, j) for (_, p), own in pages.items() for i, a in enumerate(own) if (j := next((j for j in range(i + 1, len(own)) if plain_overlap(a, own[j])), -1)) >= 0}
    flat = [x for own in pages.values() for x in own]
    starts = np.cumsum([0, *map(len, pages.values())])[:-1]
    found = P.later_overlaps(np.array([a for a, _ in flat], float), np.array([b for _, b in flat], float), starts)
    at = [(p, int(s)) for (_, p), s in zip(pages, starts, strict=True)]
    assert {(p, i, int(found[s + i]) - s) for (p, s), own in zip(at, pages.values(), strict=True) for i in range(len(own)) if found[s + i] >= 0} == want
    rows = [(d, p, i, f"t{i}", a, 14.0 * i, b, 14.0 * i + 10) for (d, p), own in pages.items() for i, (a, b) in enumerate(own)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = P.next_overlaps(spark.createDataFrame(rows, "doc_id string, page int, phrase_idx int, text string, x0 double, y0 double, x1 double, y1 double")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(x.page, x.a, x.b) for x in got} == want
    assert all((x.a_text, x.b_text, x.distance) == (f"t{x.a}", f"t{x.b}", 14.0 * (x.b - x.a) - 10) for x in got)


def test_a_short_list_of_ground_phrases_needs_no_join(spark):
    """The pairs are found once, in one pass; what is positive is what the joins say of the same phrases as a table."""
    texts = ["Order", "Key", "Order Key", "net", "sum\t of", "", " ", "Line", "1", "x", "net", "sum"]
    rows = [("d", 1, k, t, 40.0, 14.0 * k, 90.0, 14.0 * k + 10) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id string, page int, phrase_idx int, text string, x0 double, y0 double, x1 double, y1 double")
    ground = ["Order Key", " net \t sum ", "Line 1", "Order", "x"]
    found = P.labelled_pairs(frame, ground)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    table = P.labelled_pairs(frame, P.ground_table(frame, ground))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, table.collect()))
    assert {x.a_text for x in found.where("is_positive").collect()} == {"net", "Line"}
