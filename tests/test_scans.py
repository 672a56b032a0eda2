"""Ordered scans against lists, and partial matches by lists of places against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from formweave.functions.scans import prefix_sums, row_numbers, with_next
from formweave.operators import fields as K


@pytest.fixture(params=[True, False])
def parts(spark, request):
    """With a few parts, and with more parts than rows in some tests."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    if request.param:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "17")
    yield request.param
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n", [0, 1, 2, 400])
def test_scans_against_lists(spark, parts, n):
    r = random.Random(n)
    rows = [(k, r.choice([None, r.randrange(-5, 1 << 40)]), f"t{k}", [k, k + 1]) for k in range(n)]
    frame = spark.createDataFrame(r.sample(rows, n), "k long, v long, t string, a array<long>")
    summed = {x["k"]: x["s"] for x in prefix_sums(frame, ["k"], {"s": "v"}).collect()}
    so_far, known = 0, {}
    for k, v, *_ in rows:
        known[k] = so_far
        so_far += v or 0
    assert summed == known
    numbered = row_numbers(frame.withColumn("_one", F.lit("mine")), ["k"])
    assert {x["k"]: (x["row_no"], x["_one"]) for x in numbered.collect()} == {k: (k, "mine") for k in range(n)}
    after = {x["k"]: (x["nt"], x["na"]) for x in with_next(frame, ["k"], {"nt": "t", "na": "a"}).collect()}
    assert after == {k: (f"t{k + 1}", [k + 1, k + 2]) if k + 1 < n else (None, None) for k in range(n)}


def test_no_task_sees_all_rows(spark, parts):
    plan = with_next(prefix_sums(spark.range(100), ["id"], {"s": "id"}), ["id"], {"n": "id"})._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


def follows(a, b, k=1):
    i = 0
    for x in b:
        if i < len(a) and abs(a[i] - x) <= k:
            i += 1
    return i == len(a)


def course(r, n, step):
    found = [0]
    while len(found) < n:
        found.append(found[-1] + r.randint(1, step))
    return found


@pytest.mark.parametrize("k", [0, 1, 3])
def test_partial_matches_against_all_pairs(spark, k):
    r = random.Random(k)
    good = [(f"d{r.randrange(3)}", course(r, r.randint(1, 5), 6)) for _ in range(60)]
    rest = [(f"d{r.randrange(3)}", course(r, r.randint(1, 9), 4)) for _ in range(200)]
    found = K.following_courses(spark.createDataFrame(good, "doc_id string, ours array<int>"), spark.createDataFrame(rest, "doc_id string, course array<int>").distinct(), k)
    known = {(d, tuple(a), tuple(b)) for d, a in good for e, b in rest if d == e and len(b) >= len(a) and follows(a, b, k)}
    assert {(x["doc_id"], tuple(x["ours"]), tuple(x["course"])) for x in found.collect()} == known and known


def test_partial_matches_of_many_vectors_meet_few(spark):
    """50,000 vectors of one document and 500 accepted ones: rows met grow with the vectors, not with their product."""
    r = random.Random(8)
    good = [("d", course(r, 12, 4000)) for _ in range(500)]
    rest = [("d", course(r, 14, 3000)) for _ in range(49_000)]
    rest += [("d", sorted({*a, *(r.randrange(1, a[-1]) for _ in range(4))})) for _, a in (r.choice(good) for _ in range(1000))]
    ours, theirs = spark.createDataFrame(good, "doc_id string, ours array<int>"), spark.createDataFrame(rest, "doc_id string, course array<int>").distinct()
    assert K.course_candidates(ours, theirs).count() < len(rest)
    found = {tuple(x["course"]) for x in K.following_courses(ours, theirs).collect()}
    assert found >= {tuple(b) for _, b in rest[49_000:] if len(b) == 16}
    some = r.sample(rest, 400)
    assert {tuple(b) for _, b in some if any(follows(a, b) for _, a in good)} == {tuple(b) for _, b in some} & found
