"""Groups folded many to a batch, against plain grouping."""

from pyspark.sql import functions as F

from formweave.functions import groups as G
from formweave.operators import fields as K, phrases as P


def test_groups_that_cross_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"d{k % 5}", k % 3, k, float(k)) for k in range(300)]
        frame = spark.createDataFrame(rows, "a string, b int, k int, v double")
        fold = lambda own: {"a": own["a"][:1], "b": own["b"][:1], "ks": [own["k"]]}
        found = {(r.a, r.b): r.ks for r in G.fold_groups(frame, ["a", "b"], ["k"], fold, "a string, b int, ks array<int>").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for a, b, k, _ in rows:
        want.setdefault((a, b), []).append(k)
    assert found == want


def test_clusters_start_no_group_of_pandas(spark):
    """A form has few vectors of a length: a data frame for each costs more than the clusters."""
    vectors = spark.createDataFrame([("d", "p", [1, 2, 3, 4], 1)], "doc_id string, phrase string, vec array<int>, first_pos int")
    assert "FlatMapGroupsInPandas" not in K.leader_clusters(vectors)._jdf.queryExecution().executedPlan().toString()
    assert K.leader_clusters(vectors).select(F.col("leader")).first()[0] == "p"


def test_ground_phrases_that_share_their_tokens(spark):
    """A text meets the ground phrases of its rarest token, not all that have a common one."""
    ground = spark.createDataFrame([(f"Customer No {k}",) for k in range(500)], "text string")
    texts = spark.createDataFrame([(f"No {k}",) for k in range(500)], "text string")
    assert P._met(texts, ["text"], P._lists(ground)).count() == 500
