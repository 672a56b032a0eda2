"""Quality of documents: boosted trees on the text, shrunk posteriors of host and path."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .boosting import boost, tree_column
from .common import check_columns, cut, hot_keys, meet, placed, row_place, without_rows
from .textarrays import chunks, distinct_sets, shingle_hashes, text_bytes, word_hashes, word_spans

#: Labelled rows that train the classifier at most: those with the least hashes of their ids.
SAMPLE = 6000
#: Log-odds that a site can add or take at most.  A site's posterior is made of the same classifier's
#: scores of its other documents, so it may tip undecided texts but never reject a clearly good one.
SITE_WEIGHT = 1.0
#: Documents that a prior counts for at least: a site of a few documents does not judge them.
LEAST_PRIOR = 20.0
FEATURES = ("words", "word_length", "upper", "symbols", "digits", "marks", "pipes", "distinct_words", "distinct_runs", "same_next", "stops", "line_words")


def _table(codes: str | range) -> np.ndarray:
    found = np.zeros(256, bool)
    found[[ord(c) for c in codes] if isinstance(codes, str) else list(codes)] = True
    return found


_CLASSES = {"upper": _table(range(65, 91)), "symbols": _table("#*$%&<>~^{}="), "digits": _table("0123456789"), "marks": _table("!?"), "pipes": _table("|"), "stops": _table(".,;:"), "lines": _table("\n")}


def text_features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; empty texts have zeros."""
    raw, offsets = text_bytes(column)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for first, last, part, at in chunks(raw, offsets):
        n = last - first
        starts, ends, doc = word_spans(part, at)
        count = np.bincount(doc, minlength=n)
        some = np.maximum(count, 1)
        hashes = word_hashes(part, starts, ends)
        runs, of = shingle_hashes(hashes, doc, n, 3)
        chars = np.bincount(doc, ends - starts, minlength=n)
        sums = {k: np.diff(np.concatenate(([0], np.cumsum(t[part])))[at]) for k, t in _CLASSES.items()}
        same = np.zeros(n)
        if len(doc) > 1:
            same = np.bincount(doc[1:], (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]), minlength=n)
        of_chars = lambda k, sums=sums, chars=chars: sums[k] / np.maximum(chars, 1)
        values = (
            np.log1p(count), chars / some, of_chars("upper"), of_chars("symbols"), of_chars("digits"), of_chars("marks"), of_chars("pipes"),
            np.diff(distinct_sets(hashes, doc, n)[1]) / some, np.diff(distinct_sets(runs, of, n)[1]) / np.maximum(np.bincount(of, minlength=n), 1),
            same / some, sums["stops"] / some, np.log1p(count / (sums["lines"] + 1)),
        )
        out[first:last] = np.stack(values, 1)
    return np.round(out, 6)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = text_features(batch.column(4))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *[pa.array(np.ascontiguousarray(x[:, j])) for j in range(len(FEATURES))]], names=["row", "id", "host", "path", *FEATURES])


def _judged(docs: DataFrame, place: Column, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, label_col: str) -> DataFrame:
    """(row, id, text_score, site_prior, score, kept) for every row of docs; row is its place."""
    plain = docs.select(
        place.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text")
    )
    kinds = ", ".join(f"{n} double" for n in FEATURES)
    rows = cut(plain.mapInArrow(_features, f"row long, id long, host string, path string, {kinds}"))
    x, y = training_sample(rows, labels, id_col, label_col)
    if not len(y) or y.min() == y.max():
        return rows.select("row", "id", *[F.lit(0.5).alias(c) for c in ("text_score", "site_prior", "score")], F.lit(True).alias("kept"))
    odds = tree_column(classifier(x, y), list(FEATURES))
    scored = cut(rows.select("row", "id", "host", "path", odds.alias("odds")).withColumn("p", 1 / (1 + F.exp(-F.col("odds")))))

    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    if not n:
        return scored.select("row", "id", *[F.col("p").alias(c) for c in ("text_score", "site_prior", "score")], (F.col("p") >= 0.5).alias("kept"))
    mean = min(max(s / n, 0.01), 0.99)
    spread = lambda frame, size, total: frame.agg(F.sum(F.col(size) * (F.col(total) / F.col(size) - mean) ** 2) / F.sum(size), F.sum(size) / F.count("*")).first()
    host_prior, path_prior = strength(mean, *spread(hosts, "hn", "hs")), strength(mean, *spread(paths, "n", "s"))
    key = ["site", "h", "h0", "q", "q0"]
    named = [F.coalesce("host", F.lit("")).alias("h"), F.col("host").isNull().alias("h0"), F.coalesce("path", F.lit("")).alias("q"), F.col("path").isNull().alias("q0"), F.xxhash64("host", "path").alias("site")]
    sites = _with_hosts(paths, hosts).select(*named, "n", "s", "hn", "hs")
    joined = meet(scored.select("row", "id", "odds", "p", *named), sites, key, "row", hot_keys(sites, "site", "n", n))
    host_mean = (F.col("hs") - F.col("p") + host_prior * mean) / (F.col("hn") - 1 + host_prior)
    prior = (F.col("s") - F.col("p") + path_prior * host_mean) / (F.col("n") - 1 + path_prior)
    prior = F.least(F.greatest(prior, F.lit(0.001)), F.lit(0.999))
    shift = F.log(prior / (1 - prior)) - float(np.log(mean / (1 - mean)))
    shift = F.least(F.greatest(shift, F.lit(-SITE_WEIGHT)), F.lit(SITE_WEIGHT))
    score = 1 / (1 + F.exp(-(F.col("odds") + shift)))
    return joined.select("row", "id", F.col("p").alias("text_score"), prior.alias("site_prior"), score.alias("score")).withColumn("kept", F.col("score") >= 0.5)


def training_sample(rows: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most SAMPLE labelled rows, those with the least hashes of their ids; labels of an id average."""
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.avg(label_col).alias("y"))
    sample = rows.join(known, "id").select(F.xxhash64("id").alias("order"), "id", F.col("y") >= 0.5, *FEATURES).orderBy("order", *FEATURES).limit(SAMPLE).collect()
    return np.array([r[3:] for r in sample], float).reshape(-1, len(FEATURES)), np.array([r[2] for r in sample], float)


def classifier(x: np.ndarray, y: np.ndarray) -> list:
    """Boosted trees whose sum is the log-odds of good quality."""
    return boost(x, y, rounds=30, depth=3, least=max(4, len(y) // 200))


def strength(mean: float, between: float, size: float) -> float:
    """Documents that a prior counts for: within variance over the variance between groups beyond chance."""
    extra = max(between - mean * (1 - mean) / max(size, 1.0), 1e-5)
    return float(min(max(mean * (1 - mean) / extra - 1, LEAST_PRIOR), 1e6))


def _with_hosts(paths: DataFrame, hosts: DataFrame) -> DataFrame:
    """Paths with their hosts' sums; a null host is a host."""
    hosts = hosts.withColumnRenamed("host", "_host")
    return paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")


def site_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality"
) -> DataFrame:
    """(id_col, text_score, site_prior, score, kept) for every row.

    ``text_score`` is the boosted trees' probability of good quality.  A host's
    posterior mean shrinks its documents' scores to the global mean, a path's (the
    pair of host and path column) to its host's, each document left out of its own;
    strengths come from the spread between hosts (moments).  The score adds the
    path's log-odds against the global ones, at most SITE_WEIGHT, to the text's.

    The trees see at most SAMPLE labelled rows; statistics of sites cover all rows.
    Null or empty texts are judged by their zero features; null hosts and paths are
    groups of their own; repeated labels of an id average, and count for each row of
    the id.  Rows are judged by their own texts, also if they share an id or have none.
    A score of exactly one half is kept.  Without labels of both kinds every document
    is kept with that score; an empty table gives no rows.
    """
    check_columns(docs, id_col, text_col, host_col, path_col)
    check_columns(labels, id_col, label_col)
    return _judged(docs, row_place(), labels, id_col, text_col, host_col, path_col, label_col).drop("row").withColumnRenamed("id", id_col)


def without_rejected(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality"
) -> DataFrame:
    """docs without the rows that ``site_quality`` rejects, by their places (``common.placed``): rows that share an id, or have none, go or stay alone.

    Null and empty texts are judged by their zero features; a score of exactly one half stays; an empty table stays empty.
    """
    check_columns(docs, id_col, text_col, host_col, path_col)
    check_columns(labels, id_col, label_col)
    table, place = placed(docs)
    return without_rows(table, place, _judged(table, F.col(place), labels, id_col, text_col, host_col, path_col, label_col).where("not kept"))
