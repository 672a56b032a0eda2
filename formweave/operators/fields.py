"""Field prediction: phrases that recur at parallel positions form clusters; keyword clusters are fields."""

from __future__ import annotations

from math import cos, exp, lgamma, pi, sqrt, tan

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from formweave.functions.groups import fold_groups
from formweave.functions.lineage import materialised
from formweave.functions.sql import strings
from formweave.operators.oracle import Oracle, RuleOracle
from formweave.operators.replies import clean_reply, reply_flags

VECTORS = "doc_id string, phrase string, vec array<int>, first_pos int, cluster_id int, leader string"


def position_vectors(phrases: DataFrame) -> DataFrame:
    """(doc_id, phrase, vec, first_pos): ascending positions of each text in reading order."""
    found = phrases.groupBy("doc_id", F.col("text").alias("phrase")).agg(F.array_sort(F.collect_list("phrase_idx")).alias("vec"))
    return found.withColumn("first_pos", F.get("vec", F.lit(0)))


def frequent(vectors: DataFrame, least: int = 3) -> DataFrame:
    return vectors.where(F.size("vec") > least)


def matches(v1: Column, v2: Column, k: int = 1) -> Column:
    """Equal lengths, and every distance within k of the first one."""
    first = F.abs(F.get(v1, F.lit(0)) - F.get(v2, F.lit(0)))
    near = F.forall(F.zip_with(v1, v2, lambda a, b: F.abs(F.abs(a - b) - first) <= k), lambda x: x)
    return F.when(F.size(v1) == F.size(v2), near).otherwise(False)


def _ends(k: int, near: bool) -> Column:
    """Join keys of a vector: its ends' rise and their sum, in buckets; with ``near`` the neighbouring buckets too."""
    around = "array(-1, 0, 1)" if near else "array(0)"
    first, last, width = "vec[0]", "element_at(vec, -1)", max(k, 1)
    keys = [f"transform({around}, d -> named_struct('kind', '{c}', 'at', CAST(floor(({last} {c} {first}) / {width}) AS INT) + d))" for c in "-+"]
    return F.explode(F.expr(f"concat({keys[0]}, {keys[1]})"))


def matching_pairs(vectors: DataFrame, k: int = 1) -> DataFrame:
    """(doc_id, p, q) of matching vectors with p first.

    The last positions of two matching vectors lie as far apart as the first ones, but
    for k: on the same side, and then the vectors rise alike from first to last, or on the
    other, and then first and last have the same sum.  Both, with the length, are the join's keys.
    """
    keyed = vectors.where(F.size("vec") > 0)
    a = keyed.select("doc_id", F.size("vec").alias("n"), F.col("phrase").alias("p"), F.col("vec").alias("pv"), F.col("first_pos").alias("pf"), _ends(k, True).alias("key"))
    b = keyed.select("doc_id", F.size("vec").alias("n"), F.col("phrase").alias("q"), F.col("vec").alias("qv"), F.col("first_pos").alias("qf"), _ends(k, False).alias("key"))
    pairs = a.join(b, ["doc_id", "n", "key"]).where((F.col("pf") < F.col("qf")) & matches(F.col("pv"), F.col("qv"), k))
    return pairs.select("doc_id", "p", "q").distinct()


def leader_clusters(vectors: DataFrame, k: int = 1, least: int = 3, dealt: bool = False) -> DataFrame:
    """(doc_id, phrase, vec, first_pos, cluster_id, leader): greedy clusters in order of first position.

    An unclustered phrase leads a cluster and takes every later unclustered phrase that
    matches it.  Only vectors of one length can match, so groups are (document, length);
    cluster_id numbers the leaders of a document by first position.  ``dealt`` vectors lie by
    document already.
    """
    keyed = frequent(vectors, least).select("doc_id", F.size("vec").alias("n"), "first_pos", "phrase", "vec")

    def group(own: dict[str, list]) -> dict[str, list]:
        table = np.array(own["vec"], dtype=np.int64)
        rest = np.arange(len(table))
        owner = np.zeros(len(table), np.int64)
        while len(rest):
            lead = rest[0]
            gaps = np.abs(table[rest] - table[lead])
            fits = (np.abs(gaps - gaps[:, :1]) <= k).all(axis=1)
            owner[rest[fits]] = lead
            rest = rest[~fits]
        first = owner.tolist()
        named = {"cluster_id": [own["first_pos"][i] for i in first], "leader": [own["phrase"][i] for i in first]}
        return {c: own[c] for c in ("doc_id", "phrase", "vec", "first_pos")} | named

    found = fold_groups(keyed, ["doc_id", "n"], ["first_pos", "phrase"], group, VECTORS, dealt)
    number = (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("cluster_id")) - 1).cast("int")
    return found.withColumn("cluster_id", number)


def student_quantile(n: int, p: float = 0.975) -> float:
    """Quantile of Student's t with n degrees of freedom: bisection on the angle atan(t / sqrt(n)), where the density is a power of the cosine."""
    scale = exp(lgamma((n + 1) / 2) - lgamma(n / 2)) / sqrt(pi)

    def below(angle: float, steps: int = 200) -> float:
        h = angle / steps
        return 0.5 + scale * h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * cos(i * h) ** (n - 1) for i in range(steps + 1))

    low, high = 0.0, pi / 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return sqrt(n) * tan((low + high) / 2)


def _large_quantile(d: str, z: float = 1.959963984540054) -> str:
    """SQL: 97.5 % quantile of Student's t with many degrees of freedom d, from the normal one z; at 200 it is right to 2e-9."""
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return f"({z!r}D + " + " + ".join(f"{c!r}D / power({d}, {k})" for k, c in enumerate(terms, 1)) + ")"


def confidence(frame: DataFrame, group: list[str], value: str, most: int = 200) -> DataFrame:
    """(group, n, mean, half): half width of the 95 % t interval; null for a single value.

    Quantiles of groups of up to ``most`` rows are a table, those of larger ones the
    expansion of Student's quantile in powers of 1 / (n - 1), for which ``most`` is large enough.
    """
    table = [(n - 1, student_quantile(n - 1)) for n in range(2, most + 1)]
    t = F.expr("CASE " + " ".join(f"WHEN n = {d + 1} THEN {q!r}D" for d, q in table) + f" ELSE {_large_quantile('(n - 1)')} END")
    found = frame.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    return found.withColumn("half", F.when(F.col("n") > 1, F.col("_sd") / F.sqrt("n") * t)).drop("_sd")


def is_subsequence(a: Column, b: Column, k: int = 1) -> Column:
    """Greedy two pointers: each element of a is met by a later element of b within k."""
    step = lambda i, x: F.when((i < F.size(a)) & (F.abs(F.get(a, i) - x) <= k), i + 1).otherwise(i)
    return F.aggregate(b, F.lit(0), step) == F.size(a)


def partial_match(a: Column, b: Column, k: int = 1) -> Column:
    """The shorter vector, shifted so that first elements coincide, is a subsequence of the longer."""
    shift = F.get(b, F.lit(0)) - F.get(a, F.lit(0))
    return is_subsequence(F.transform(a, lambda x: x + shift), b, k)


def accepted_clusters(clusters: DataFrame, oracle: Oracle, vision: list[str] = ()) -> DataFrame:
    """(doc_id, cluster_id, fields): keyword clusters.

    Of several clusters with more than two phrases one is accepted if a cleaned field is
    a vision field, or if the share p of keywords exceeds one half with an interval of
    less than one half; of a single cluster p decides alone.
    """
    big = clusters.withColumn("_size", F.count("*").over(_cluster())).where("_size > 2")
    judged = big.withColumn("is_key", oracle.is_keyword(F.col("phrase")).cast("int"))
    shares = confidence(judged, ["doc_id", "cluster_id"], "is_key")
    kept = F.array_sort(F.collect_list(F.when(F.col("is_key") == 1, F.struct("first_pos", "phrase"))))
    named = judged.groupBy("doc_id", "cluster_id").agg(kept.alias("f"))
    count = judged.groupBy("doc_id").agg(F.count_distinct("cluster_id").alias("_clusters"))
    rows = named.withColumn("fields", F.expr("transform(f, x -> x.phrase)")).drop("f").join(shares, ["doc_id", "cluster_id"]).join(count, "doc_id")
    seen = F.arrays_overlap("fields", F.expr(strings(vision)))
    good = seen | ((F.col("mean") > 0.5) & ((F.col("_clusters") == 1) | (F.col("half") < 0.5)))
    return rows.where(F.coalesce(good, F.lit(False))).select("doc_id", "cluster_id", "fields")


def _cluster():
    return Window.partitionBy("doc_id", "cluster_id")


def regrouped(clusters: DataFrame, accepted: DataFrame, k: int = 1) -> DataFrame:
    """(doc_id, cluster_id): further clusters with vectors as long as an accepted one's, one of which partly matches it.

    What counts of a vector is its course from its first position.  A course that follows another
    has a place within k of each of the other's, so it has one near the place of the other that
    fewest courses have: lists of courses by place are the only join, and each accepted course
    looks into its shortest list alone.
    """
    course = F.expr("transform(vec, x -> x - vec[0])")
    members = clusters.select("doc_id", "cluster_id", course.alias("course"))
    good = members.join(accepted.select("doc_id", "cluster_id"), ["doc_id", "cluster_id"], "left_semi").select("doc_id", F.col("course").alias("ours")).distinct()
    rest = members.join(accepted.select("doc_id", "cluster_id"), ["doc_id", "cluster_id"], "left_anti")
    found = following_courses(good, rest.select("doc_id", "course").distinct(), k)
    return rest.join(found.select("doc_id", "course").distinct(), ["doc_id", "course"], "left_semi").select("doc_id", "cluster_id").distinct()


def course_candidates(good: DataFrame, rest: DataFrame, k: int = 1) -> DataFrame:
    """(doc_id, ours, course): what the shortest list of each course of good (doc_id, ours) holds of rest (doc_id, course), at least as long."""
    width = max(k, 1)
    place = lambda c: F.floor(c / width).cast("int")
    lists = rest.select("doc_id", "course", F.explode(F.array_distinct(F.transform("course", place))).alias("at"))
    sizes = lists.groupBy("doc_id", "at").agg(F.count("*").alias("n"))
    near = lambda c: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: place(c) + d)).alias("at")
    asked = good.select("doc_id", "ours", F.explode(F.array_distinct("ours")).alias("x")).select("doc_id", "ours", "x", near(F.col("x")))
    lengths = asked.join(sizes, ["doc_id", "at"], "left").groupBy("doc_id", "ours", "x").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    shortest = lengths.groupBy("doc_id", "ours").agg(F.min(F.struct("n", "x")).alias("m")).where("m.n > 0")
    met = shortest.select("doc_id", "ours", near(F.col("m.x"))).join(lists, ["doc_id", "at"]).where(F.size("course") >= F.size("ours"))
    return met.select("doc_id", "ours", "course").distinct()


def following_courses(good: DataFrame, rest: DataFrame, k: int = 1) -> DataFrame:
    """(doc_id, ours, course): courses of rest that follow one of good, as ``partial_match`` says."""
    return course_candidates(good, rest, k).where(partial_match(F.col("ours"), F.col("course"), k))


def predict_field(phrases: DataFrame, oracle: Oracle, vision: list[str] = (), pages: int = 5, k: int = 1, dealt: bool = False) -> DataFrame:
    """(doc_id, field, position): predicted fields; a document of one page has the vision fields among its phrases.

    A model oracle is asked about the phrases of all documents given, which should then be a sample.
    """
    sample = phrases.where(F.col("page") <= pages)
    vectors = position_vectors(sample)
    clusters = materialised(leader_clusters(vectors, k, dealt=dealt))
    if not isinstance(oracle, RuleOracle):  # a model is asked about the sample's clusters once
        big = clusters.withColumn("_size", F.count("*").over(_cluster())).where("_size > 2")
        oracle.prepare([r["phrase"] for r in big.select("phrase").distinct().collect()])
    accepted = accepted_clusters(clusters, oracle, vision)
    fields = accepted.select("doc_id", F.explode("fields").alias("field"))
    more = clusters.join(regrouped(clusters, accepted, k), ["doc_id", "cluster_id"], "left_semi").where(F.col("phrase").isin(list(vision)))
    fields = fields.union(more.select("doc_id", F.col("phrase").alias("field")))
    single = phrases.groupBy("doc_id").agg(F.count_distinct("page").alias("n")).where("n = 1").select("doc_id")
    alone = vectors.where(F.col("phrase").isin(list(vision))).join(single, "doc_id", "left_semi").select("doc_id", F.col("phrase").alias("field"))
    fields = fields.join(single, "doc_id", "left_anti").union(alone).distinct()
    at = vectors.select("doc_id", F.col("phrase").alias("field"), F.col("first_pos").alias("position"))
    return fields.join(at, ["doc_id", "field"])
