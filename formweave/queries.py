"""Queries over the driver's tables, one or more for each operator, with the SQL that tells their rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from formweave.api import Engine
from formweave.functions import present as V
from formweave.functions.lineage import materialised, shared_folder
from formweave.functions.scans import prefix_sums, with_next
from formweave.functions.tokens import token_counter
from formweave.operators import edit as U, extract as X, fields as K, layouts as Y, learn as L, phrases as P, questions as Q, rows as R
from formweave.operators.oracle import RuleOracle, answered, call_cost, metadata_strings as metadata_by_recurrence, total_cost as cost_in_sum
from formweave.plans import template as T
from formweave.plans.render import BILL_COLUMNS, BILL_FIELDS, DEEP_FIELDS, DUCK_SOURCE, KV_FIELDS, PER_PAGE, TABLE_FIELDS, form_documents, forms, two_layouts
from formweave.plans.template import LEAF, Node
from formweave.sources import artifacts as S
from formweave.sources.folder import PUSHDOWN, PhraseFolder
from formweave.streaming.pages import extract_page_stream, read_page_stream

FORM = (Node("kv", KV_FIELDS, 0), Node("table", TABLE_FIELDS, 1))
NESTED = (Node("kv", KV_FIELDS, 0), Node("table", TABLE_FIELDS, 1, child=2), Node("table", ("Mode", "Flag"), 2, child=LEAF))
#: The header and footer strings of the forms; page labels are registered as rows.
METADATA = ["Order Report", "Sheet"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE_COLUMNS = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def source(rest: str) -> str:
    return "WITH " + DUCK_SOURCE.replace("ALL_LINE_COLUMNS", LINE_COLUMNS) + rest


def _cells(spark: SparkSession, sf_dir: str, variant: str = "", template=FORM, kind: str = "") -> DataFrame:
    phrases = forms(spark, sf_dir, variant)
    return X.extract_cells(phrases, template, METADATA, [["Order Report", f"Sheet {p}"] for p in range(1, 26)], dealt=True, kind=kind)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visual rows of the forms, which are dealt by document as they are rendered."""
    return R.visual_rows(forms(spark, sf_dir), dealt=True)


_LINES = ", ".join(f"v{c}" for c in range(7))
_TABLE = source(f""", x AS (SELECT doc_id, record_id, row_no, unnest([{', '.join(f"{{'c': {c}, 'k': '{k}', 'v': v{c}}}" for c, k in enumerate(TABLE_FIELDS))}]) AS x FROM lines)
SELECT doc_id, record_id::INT AS record_id, 1 AS block_id, row_no::INT AS row_no, x.c::INT AS col_no, x.k AS key, coalesce(x.v, 'missing') AS value FROM x""")
_KV = source(f""", x AS (SELECT doc_id, record_id, unnest([{', '.join(f"{{'c': {c}, 'k': '{k}', 'v': v{c}}}" for c, k in enumerate(KV_FIELDS))}]) AS x FROM heads)
SELECT doc_id, record_id::INT AS record_id, 0 AS block_id, x.c::INT AS col_no, x.k AS key, x.v AS value FROM x""")


def _table(cells: DataFrame) -> DataFrame:
    return cells.where("block_type = 'table'").select("doc_id", "record_id", "block_id", "row_no", "col_no", "key", F.coalesce("value", F.lit(X.MISSING)).alias("value"))


@query(_TABLE)
def form_extract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every table cell of every form (rows, records, labels, blocks, cells)."""
    return _table(_cells(spark, sf_dir, kind="table"))


@query(_KV)
def form_extract_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir, kind="kv").select("doc_id", "record_id", "block_id", "col_no", "key", "value")


@query(_TABLE)
def form_extract_shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells beside their header come back by the column bounds."""
    return _table(_cells(spark, sf_dir, "shifted", kind="table"))


_NESTED = source(f""", t AS (SELECT doc_id, record_id, row_no, unnest([{', '.join(f"{{'c': {c}, 'k': '{k}', 'v': v{c}}}" for c, k in enumerate(TABLE_FIELDS))}]) AS x FROM lines),
  h AS (SELECT doc_id, record_id, unnest([{', '.join(f"{{'c': {c}, 'k': '{k}', 'v': v{c}}}" for c, k in enumerate(KV_FIELDS))}]) AS x FROM heads),
  i AS (SELECT 'forms_' || d AS doc_id, rk AS record_id, unnest([{{'c': 0, 'k': 'Mode', 'v': 'mode ' || l_linestatus}}, {{'c': 1, 'k': 'Flag', 'v': 'flag ' || l_returnflag}}]) AS x FROM o JOIN l ON l_orderkey = o_orderkey WHERE n = 1),
  u AS (SELECT doc_id, record_id, 0 AS block_id, 'kv' AS block_type, 1 AS row_no, x FROM h UNION ALL SELECT doc_id, record_id, 1, 'table', row_no, x FROM t UNION ALL SELECT doc_id, record_id, 2, 'table', 1, x FROM i)
SELECT doc_id, record_id::INT AS record_id, block_id, block_type, row_no::INT AS row_no, x.c::INT AS col_no, x.k AS key, coalesce(x.v, 'missing') AS value FROM u""")


@query(_NESTED)
def form_extract_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inner table between the rows of the outer one; all cells of both."""
    return _cells(spark, sf_dir, "nested", NESTED).select("doc_id", "record_id", "block_id", "block_type", "row_no", "col_no", "key", F.coalesce("value", F.lit(X.MISSING)).alias("value"))


@query(source(" SELECT doc_id, record_id::INT AS record_id, row_no::INT AS row_no, 'Discount' AS key FROM lines WHERE v5 IS NULL"))
def form_extract_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that a form leaves out."""
    return _cells(spark, sf_dir).where("value IS NULL").select("doc_id", "record_id", "row_no", "key")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    return X.label_rows(X.records(rows, FORM), FORM, METADATA, [["Order Report", f"Sheet {p}"] for p in range(1, 26)])


_COUNTS = source(""", r AS (SELECT doc_id, record_id, count(*) AS n FROM lines GROUP BY ALL), p AS (SELECT doc_id, count(*) AS records, sum(n) AS n, ceil(count(*) / 2) AS pages FROM r GROUP BY ALL)
""")


@query(_COUNTS + "SELECT doc_id, records::BIGINT AS records FROM p")
def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.records(_rows(spark, sf_dir), FORM).groupBy("doc_id").agg(F.count_distinct("record_id").alias("records"))


@query(
    _COUNTS
    + """, s AS (SELECT doc_id, record_id, 4 + n + CASE WHEN record_id % 2 = 0 THEN 1 ELSE 0 END AS rows FROM r),
  t AS (SELECT doc_id, record_id, sum(rows) OVER (PARTITION BY doc_id ORDER BY record_id) - rows + CASE WHEN record_id % 2 = 0 THEN 1 ELSE 0 END AS a, sum(rows) OVER (PARTITION BY doc_id ORDER BY record_id) - 1 AS b, max(record_id) OVER (PARTITION BY doc_id) AS top FROM s)
SELECT doc_id, record_id::INT AS record_id, CASE WHEN record_id = 0 THEN 0 ELSE a END::INT AS first_row, (b + CASE WHEN record_id % 2 = 1 AND record_id < top THEN 1 ELSE 0 END)::INT AS last_row FROM t"""
)
def record_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page header above a record belongs to the record before it."""
    return X.records(_rows(spark, sf_dir), FORM).groupBy("doc_id", "record_id").agg(F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


@query(_COUNTS + "SELECT doc_id, unnest([{'label': 'K', 'n': records}, {'label': 'KV', 'n': 3 * records}, {'label': 'M', 'n': pages::BIGINT}, {'label': 'V', 'n': n::BIGINT}], recursive := true) FROM p")
def row_labels_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).groupBy("doc_id", "label").agg(F.count("*").alias("n"))


@query(_COUNTS + "SELECT doc_id, pages::BIGINT AS metadata_rows FROM p")
def metadata_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).where("label = 'M'").groupBy("doc_id").agg(F.count("*").alias("metadata_rows"))


@query(_COUNTS + "SELECT doc_id, (4 * records + n + pages)::BIGINT AS n_rows FROM p")
def rows_from_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_rows"))


#: The rendered phrases themselves in DuckDB.
_PHRASES = source(
    f""", h AS (SELECT d, floor(rk / {PER_PAGE})::INT + 1 AS page, (rk % {PER_PAGE}) * 24 AS top, rk, o_orderkey FROM o),
c AS (SELECT d, page, 0 AS r, unnest([{{'c': 0, 'text': 'Order Report'}}, {{'c': 1, 'text': 'Sheet ' || page}}], recursive := true) FROM h WHERE rk % {PER_PAGE} = 0
  UNION ALL SELECT h.d, page, top + 1 + x // 4, x % 4, CASE WHEN x % 2 = 0 THEN [{', '.join(f"'{k}'" for k in KV_FIELDS)}][x // 2 + 1] ELSE [v0, v1, v2, v3, v4, v5][x // 2 + 1] END
    FROM h JOIN heads ON heads.doc_id = 'forms_' || h.d AND heads.record_id = h.rk, (SELECT unnest(range(12)) AS x)
  UNION ALL SELECT d, page, top + 4, x, [{', '.join(f"'{k}'" for k in TABLE_FIELDS)}][x + 1] FROM h, (SELECT unnest(range(7)) AS x)
  UNION ALL SELECT h.d, page, top + 4 + row_no, x, [v0, v1, v2, v3, v4, v5, v6][x + 1] FROM h JOIN lines ON lines.doc_id = 'forms_' || h.d AND lines.record_id = h.rk, (SELECT unnest(range(7)) AS x)),
f AS (SELECT 'forms_' || d AS doc_id, (row_number() OVER (PARTITION BY d ORDER BY page, r, c) - 1)::INT AS phrase_idx, page, text, 40.0::DOUBLE + 90 * c AS x0, 40.0::DOUBLE + 14 * r AS y0,
  40.0::DOUBLE + 90 * c + least(80, 6 * length(text)) AS x1, 50.0::DOUBLE + 14 * r AS y1 FROM c WHERE text IS NOT NULL)
"""
)


@query(_PHRASES + "SELECT doc_id, phrase_idx, page, text, x0, y0, x1, y1 FROM f")
def rendered_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(spark, sf_dir)


@query(_PHRASES + "SELECT doc_id, text, min(phrase_idx) AS first_idx, count(*) AS n, string_agg(x0::INT || ' ' || y0::INT || ' ' || page, ',' ORDER BY phrase_idx) AS boxes FROM f GROUP BY ALL")
def phrase_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.phrase_boxes(forms(spark, sf_dir))
    boxes = F.expr("array_join(transform(boxes, b -> concat_ws(' ', CAST(b.x0 AS INT), CAST(b.y0 AS INT), b.page)), ',')")
    return found.select("doc_id", "text", "first_idx", F.size("boxes").cast("long").alias("n"), boxes.alias("boxes"))


@query(_PHRASES + "SELECT doc_id, text AS phrase, string_agg(phrase_idx::VARCHAR, ',' ORDER BY phrase_idx) AS vec, min(phrase_idx) AS first_pos FROM f GROUP BY ALL")
def position_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.position_vectors(forms(spark, sf_dir)).select("doc_id", "phrase", F.array_join("vec", ",").alias("vec"), "first_pos")


@query(_PHRASES + "SELECT doc_id, text AS phrase, count(*) AS n FROM f GROUP BY ALL HAVING count(*) > 3")
def frequent_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.frequent(K.position_vectors(forms(spark, sf_dir))).select("doc_id", "phrase", F.size("vec").cast("long").alias("n"))


_VECTORS = _PHRASES + ", v AS (SELECT doc_id, text, list(phrase_idx ORDER BY phrase_idx) AS vec FROM f WHERE page <= 5 GROUP BY ALL HAVING count(*) > 3)\n"


@query(
    _VECTORS
    + """, j AS MATERIALIZED (SELECT a.doc_id, a.text AS p, b.text AS q, a.vec AS x, b.vec AS y FROM v a JOIN v b ON a.doc_id = b.doc_id AND len(a.vec) = len(b.vec))
SELECT doc_id, p, q FROM j WHERE x[1] < y[1] AND len(list_filter(list_zip(x, y), lambda z: abs(abs(z[1] - z[2]) - abs(x[1] - y[1])) > 1)) = 0"""
)
def perfect_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.matching_pairs(K.frequent(K.position_vectors(forms(spark, sf_dir).where("page <= 5"))))


#: Greedy clusters: a step takes the first vector left of each document and length, and what matches it.
_CLUSTERS = (
    _VECTORS.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, g AS (SELECT doc_id, len(vec) AS n, list({'t': text, 'v': vec} ORDER BY vec[1], text) AS rem FROM v GROUP BY ALL),
r AS (SELECT doc_id, n, rem FROM g UNION ALL SELECT doc_id, n, list_filter(rem, lambda x: len(list_filter(list_zip(rem[1].v, x.v), lambda z: abs(abs(z[1] - z[2]) - abs(rem[1].v[1] - x.v[1])) > 1)) > 0) FROM r WHERE len(rem) > 0),
m AS (SELECT doc_id, rem[1].t AS leader, rem[1].v[1] AS place, unnest(list_filter(rem, lambda x: len(list_filter(list_zip(rem[1].v, x.v), lambda z: abs(abs(z[1] - z[2]) - abs(rem[1].v[1] - x.v[1])) > 1)) = 0)) AS x FROM r WHERE len(rem) > 0),
k AS (SELECT doc_id, x.t AS phrase, x.v AS vec, (dense_rank() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS cluster_id, leader FROM m)
"""
)


@query(_CLUSTERS + "SELECT doc_id, phrase, cluster_id, leader FROM k")
def leader_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.leader_clusters(K.position_vectors(forms(spark, sf_dir).where("page <= 5")), dealt=True)
    return found.select("doc_id", "phrase", "cluster_id", "leader")


# 97.5 % quantiles of Student's t for 1 to 16 degrees of freedom, the most that an order of the given tables has.
_QUANTILES = (
    12.706204736174694, 4.302652729749462, 3.1824463052837078, 2.7764451051977934, 2.5705818356363146, 2.4469118511449697,
    2.36462425159, 2.3060041352, 2.2621571628, 2.22813885199, 2.20098516009, 2.17881282967, 2.16036865646, 2.14478668792, 2.13144954556, 2.11990529922,
)
_T = ", ".join(f"({n}, {q!r})" for n, q in enumerate(_QUANTILES, 2))


@query(
    f"""WITH t(n, q) AS (VALUES {_T}), g AS (SELECT l_orderkey, count(l_quantity) AS n, avg(l_quantity) AS mean, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY ALL)
SELECT l_orderkey, g.n, round(mean, 9) AS mean, round(sd / sqrt(g.n) * q, 4) AS half FROM g LEFT JOIN t ON t.n = g.n"""
)
def cluster_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of all orders, with a null half width where there is one line."""
    found = K.confidence(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_orderkey"], "l_quantity")
    return found.select("l_orderkey", "n", F.round("mean", 9).alias("mean"), F.round("half", 4).alias("half"))


#: Accepted clusters by the rule oracle: more than half keywords, and among several clusters an interval of less than a half.
_T_ALL = ", ".join(f"({n}, {K.student_quantile(n - 1)!r})" for n in range(2, 80))
_ACCEPTED = (
    _CLUSTERS
    + f""", t(n, q) AS (VALUES {_T_ALL}),
s AS (SELECT doc_id, cluster_id, count(*) AS n, avg(key) AS mean, stddev_samp(key) AS sd FROM (SELECT *, regexp_matches(phrase, '^[A-Za-z][A-Za-z .#/()&''-]{{1,40}}$')::INT AS key FROM k) GROUP BY ALL HAVING count(*) > 2),
a AS (SELECT doc_id, cluster_id FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS clusters FROM s LEFT JOIN t USING (n)) WHERE mean > 0.5 AND (clusters = 1 OR sd / sqrt(n) * q < 0.5))
"""
)
_FOUND = ", p AS (SELECT doc_id, phrase AS field, vec[1] AS position FROM k JOIN a USING (doc_id, cluster_id) WHERE regexp_matches(phrase, '^[A-Za-z][A-Za-z .#/()&''-]{1,40}$'))\n"


@query(_ACCEPTED + _FOUND + "SELECT doc_id, field, position FROM p JOIN (SELECT doc_id FROM f GROUP BY ALL HAVING max(page) > 1) USING (doc_id)")
def predicted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of every document by positions and the rule oracle."""
    return K.predict_field(forms(spark, sf_dir), RuleOracle(), dealt=True)


@query(_ACCEPTED + "SELECT doc_id, cluster_id, list_sort(list(phrase))::VARCHAR AS phrases FROM k JOIN a USING (doc_id, cluster_id) GROUP BY ALL")
def accepted_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword clusters with all their phrases."""
    clusters = materialised(K.leader_clusters(K.position_vectors(forms(spark, sf_dir).where("page <= 5")), dealt=True))
    kept = clusters.join(K.accepted_clusters(clusters, RuleOracle()).select("doc_id", "cluster_id"), ["doc_id", "cluster_id"])
    return kept.groupBy("doc_id", "cluster_id").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("phrase")), ", "), F.lit("]")).alias("phrases"))


#: How far a vector a, moved to the start of b, goes along b: two pointers as a running fold.
_ALONG = "list_reduce(list_prepend(0, {b}), lambda i, x: CASE WHEN i < len({a}) AND abs({a}[i + 1] + {b}[1] - {a}[1] - x) <= 1 THEN i + 1 ELSE i END)"


@query(
    _ACCEPTED
    + f""", j AS MATERIALIZED (SELECT r.doc_id, r.cluster_id, r.vec AS b, g.vec AS a FROM (SELECT * FROM k ANTI JOIN a USING (doc_id, cluster_id)) r
    JOIN (SELECT * FROM k JOIN a USING (doc_id, cluster_id)) g ON r.doc_id = g.doc_id)
SELECT DISTINCT doc_id, cluster_id FROM j WHERE len(b) >= len(a) AND {_ALONG.format(a="a", b="b")} = len(a)"""
)
def reclustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = materialised(K.leader_clusters(K.position_vectors(forms(spark, sf_dir).where("page <= 5")), dealt=True))
    return K.regrouped(clusters, K.accepted_clusters(clusters, RuleOracle()))


@query(
    f"""WITH o AS (SELECT l_orderkey, list(l_partkey % 40 ORDER BY l_partkey % 40, l_linenumber) AS a FROM lineitem GROUP BY ALL), n AS (SELECT l_orderkey, a, lead(a) OVER (ORDER BY l_orderkey) AS b FROM o)
SELECT l_orderkey, list_reduce(list_prepend(0::BIGINT, b), lambda i, x: CASE WHEN i < len(a) AND abs(a[i + 1] - x) <= 1 THEN i + 1 ELSE i END) = len(a) AS follows, {_ALONG.format(a="a", b="b").replace("(0,", "(0::BIGINT,")} = len(a) AS matches FROM n WHERE b IS NOT NULL"""
)
def partial_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the part numbers of an order follow in those of the next, in place and moved to their start."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", (F.col("l_partkey") % 40).cast("int").alias("part"))
    orders = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("part")).alias("a"))
    near = with_next(orders, ["l_orderkey"], {"b": "a"}).where("b IS NOT NULL")
    return near.select("l_orderkey", K.is_subsequence(F.col("a"), F.col("b")).alias("follows"), K.partial_match(F.col("a"), F.col("b")).alias("matches"))


@query(
    _PHRASES
    + """, w AS (SELECT list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM (SELECT DISTINCT text FROM f)),
i AS (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM w), j AS (SELECT t, i, unnest(range(i, len(t) + 1)) AS j FROM i)
SELECT DISTINCT array_to_string(t[i:j], ' ') AS sub FROM j"""
)
def subphrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of tokens of every different phrase of the forms, all pages, whole."""
    return P.subphrases(forms(spark, sf_dir).select("text").distinct())


_PAIRS = (
    _PHRASES
    + """, n AS (SELECT a.doc_id, a.page, a.phrase_idx AS a, b.phrase_idx AS b, a.text AS a_text, b.text AS b_text, CASE WHEN a.y1 < b.y0 THEN b.y0 - a.y1 WHEN b.y1 < a.y0 THEN a.y0 - b.y1 ELSE 0 END AS distance,
  row_number() OVER (PARTITION BY a.doc_id, a.phrase_idx ORDER BY b.phrase_idx) AS k FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.page = b.page AND a.phrase_idx < b.phrase_idx
  WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 AND least(a.x1, b.x1) - greatest(a.x0, b.x0) >= 0.2 * least(a.x1 - a.x0, b.x1 - b.x0))
"""
)


@query(_PAIRS + "SELECT doc_id, page, a, b, a_text, b_text, distance FROM n WHERE k = 1")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.next_overlaps(forms(spark, sf_dir), dealt=True)


#: Texts that count as known phrases: 'Line 1' never occurs whole, so 'Line' over '1' is a wrapped cell.
GROUND = ["Order Key", "Customer", "Line 1", "Status"]


@query(
    _PAIRS
    + """, lab AS (SELECT distance, NOT a_text IN ('Order Key', 'Customer', 'Line 1', 'Status') AND a_text || ' ' || b_text IN ('Order Key', 'Line 1') AS pos FROM n WHERE k = 1),
e AS (SELECT max(distance) FILTER (pos) AS p, min(distance) FILTER (NOT pos) AS m FROM lab), z AS (SELECT CASE WHEN p IS NULL OR m IS NULL THEN -1 ELSE p END AS p, CASE WHEN p IS NULL OR m IS NULL THEN -1 ELSE m END AS m FROM e)
SELECT p::DOUBLE AS max_positive, m::DOUBLE AS min_negative, round(least(m - 0.001, (p + m) / 2), 9) AS threshold FROM z"""
)
def distance_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.distance_threshold(P.labelled_pairs(forms(spark, sf_dir), GROUND, dealt=True))
    return found.select("max_positive", "min_negative", F.round("threshold", 9).alias("threshold"))


def _words(phrases: DataFrame) -> DataFrame:
    """Every phrase cut into its words, a little less than a character apart."""
    parts = phrases.select("*", F.posexplode(F.split("text", " ")).alias("k", "w"))
    ahead = F.expr("length(array_join(slice(split(text, ' '), 1, k), ' ')) + CASE WHEN k > 0 THEN 1 ELSE 0 END")
    unit = (F.col("x1") - F.col("x0")) / F.length("text")
    parts = parts.withColumn("a", F.col("x0") + ahead * unit - F.when(F.col("k") > 0, 0.01).otherwise(0.0)).withColumn("z", F.col("x0") + (ahead + F.length("w")) * unit)
    order = Window.partitionBy("doc_id").orderBy("phrase_idx", "k")
    return parts.select("doc_id", (F.row_number().over(order) - 1).alias("word_idx"), "page", F.col("w").alias("text"), F.col("a").alias("x0"), "y0", F.col("z").alias("x1"), "y1")


@query(_PHRASES + "SELECT doc_id, phrase_idx, page, text, round(x0, 6) AS x0, y0, round(x1, 6) AS x1, y1 FROM f")
def words_to_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases cut into words grow together again."""
    return _rounded(P.words_to_phrases(_words(forms(spark, sf_dir))))


_IS_PAIR = f"text IN ({', '.join(repr(k) for k in KV_FIELDS)})"


@query(
    _PHRASES
    + f""", n AS (SELECT *, length(split_part(text, ' ', -1)) AS last, (x1 - x0) / (length(text) + 1) AS unit FROM f),
a AS (SELECT *, x0 + (length(text) - last) * unit - CASE WHEN length(text) > last THEN 0.01 ELSE 0 END AS a FROM n)
SELECT doc_id, phrase_idx, page, text, round(x0, 6) AS x0, y0, round(CASE WHEN {_IS_PAIR} THEN a + (x1 - a) * last / (last + 1) ELSE x1 END, 6) AS x1, y1 FROM a"""
)
def words_split_at_colons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names with a colon at their last word, which is cut off and ends the phrase."""
    marked = forms(spark, sf_dir).withColumn("text", F.when(F.col("text").isin(*KV_FIELDS), F.concat("text", F.lit(":"))).otherwise(F.col("text")))
    return _rounded(P.words_to_phrases(P.split_words(_words(marked))))


@query(_PHRASES + "SELECT doc_id, phrase_idx, page, text, round(x0, 6) AS x0, y0, round(x1, 6) AS x1, y1 FROM (SELECT * REPLACE ((row_number() OVER (PARTITION BY doc_id ORDER BY phrase_idx) - 1)::INT AS phrase_idx) FROM f WHERE text <> 'Order Report')")
def line_phrases_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rule where each page's title is of a header's size, three times as wide, and goes."""
    wide = forms(spark, sf_dir).withColumn("x1", F.when(F.col("text") == "Order Report", F.col("x0") + 14.0 * F.length("text")).otherwise(F.col("x1")))
    return _rounded(P.line_phrases(_words(wide), gap=7.0))


@query(_PHRASES + "SELECT doc_id, text AS field, min(phrase_idx) AS position FROM f WHERE page = 1 AND text IN ('Order Key', 'Customer', 'Mode') GROUP BY ALL")
def single_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of one page has the fields that its image names, as far as they are among its phrases."""
    return K.predict_field(forms(spark, sf_dir).where("page = 1"), RuleOracle(), vision=["Order Key", "Customer", "Mode"])


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "phrase_idx", "page", "text", F.round("x0", 6).alias("x0"), "y0", F.round("x1", 6).alias("x1"), "y1")


@query(_PHRASES + "SELECT doc_id, phrase_idx, page, text, round(x0, 6) AS x0, y0, round(x1, 6) AS x1, y1 FROM (SELECT *, max(phrase_idx) OVER (PARTITION BY doc_id) AS last FROM f) WHERE phrase_idx < last")
def words_to_phrases_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the last phrase of a document left out, as usual elsewhere."""
    return _rounded(P.words_to_phrases(_words(forms(spark, sf_dir)), parity=True))


@query(_PHRASES + "SELECT doc_id, phrase_idx, page, text, round(x0, 6) AS x0, y0, round(x1, 6) AS x1, y1 FROM f")
def words_to_phrases_fixed_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.words_to_phrases(_words(forms(spark, sf_dir)), gap=7.0))


@query(_PHRASES + "SELECT doc_id, phrase_idx, page, text, round(x0, 6) AS x0, y0, round(x1, 6) AS x1, y1 FROM f")
def line_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rule on the same words; none is as large as a header's."""
    return _rounded(P.line_phrases(_words(forms(spark, sf_dir)), gap=7.0))


@query(_PHRASES + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, y0, x0) - 1)::INT AS phrase_idx, page, text, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM f")
def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases as lines of an OCR service, in shares of the page, and back; other blocks are ignored."""
    share = [((F.col(c)) / n).alias(name) for c, n, name in (("x0", 612, "left"), ("y0", 792, "top"))]
    lines = forms(spark, sf_dir).select("doc_id", "page", F.lit("LINE").alias("block_type"), "text", *share, ((F.col("x1") - F.col("x0")) / 612).alias("w"), ((F.col("y1") - F.col("y0")) / 792).alias("h"))
    blocks = lines.union(lines.withColumn("block_type", F.lit("WORD")))
    found = S.ocr_lines(blocks, 612, 792)
    return found.select("doc_id", "phrase_idx", "page", "text", *[F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(_PHRASES + """SELECT doc_id, phrase_idx, '{"text":"' || text || '","bbox":{"x0":' || x0 || ',"y0":' || y0 || ',"x1":' || x1 || ',"y1":' || y1 || ',"page":' || page || '}}' AS json FROM f""")
def phrase_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.phrases_json(forms(spark, sf_dir))


@query(_PHRASES + "SELECT doc_id, phrase_idx, page, text, x0, y0, x1, y1 FROM f")
def parsed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as an array of objects, and back."""
    objects = S.phrases_json(forms(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("phrase_idx", "json"))).alias("o"))
    whole = objects.select("doc_id", F.concat(F.lit("["), F.expr("array_join(transform(o, x -> x.json), ',')"), F.lit("]")).alias("payload"))
    return S.parse_boxes(whole, "doc_id", "payload")


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cells of two lines: 'Customer' over the key, 40 to a page."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    lines = c.select("c_custkey", F.explode(F.expr("array(named_struct('k', 0, 't', 'Customer'), named_struct('k', 1, 't', concat('No ', c_custkey)))")).alias("x"))
    y = 40 + (F.col("c_custkey") % 40) * 40 + F.col("x.k") * 12
    page = F.floor(F.col("c_custkey") / 40).cast("int") + 1
    order = Window.partitionBy("page").orderBy("c_custkey", "k")
    rows = lines.select("c_custkey", F.col("x.k").alias("k"), page.alias("page"), F.col("x.t").alias("text"), F.lit(40.0).alias("x0"), y.cast("double").alias("y0"), F.lit(100.0).alias("x1"), (y + 10).cast("double").alias("y1"))
    return rows.select(F.concat(F.lit("cards_"), F.col("page")).alias("doc_id"), (F.row_number().over(order) - 1).alias("phrase_idx"), "page", "text", "x0", "y0", "x1", "y1")


_CARDS = "SELECT 'cards_' || (c_custkey // 40 + 1) AS doc_id, 'Customer No ' || c_custkey AS text, (40 + c_custkey % 40 * 40)::DOUBLE AS y0, (62 + c_custkey % 40 * 40)::DOUBLE AS y1 FROM customer"


@query(_CARDS)
def merge_lines_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merge_by_distance(_wrapped(spark, sf_dir), 5.0).select("doc_id", "text", "y0", "y1")


@query(_CARDS)
def merge_lines_ground(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.merge_by_ground(_wrapped(spark, sf_dir), _card_texts(spark, sf_dir)).select("doc_id", "text", "y0", "y1")


def _card_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("Customer No "), "c_custkey").alias("text"))


@query(_CARDS)
def merge_lines_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance threshold is learned from all customers' texts, then applied."""
    return P.apply_rules(_wrapped(spark, sf_dir), _card_texts(spark, sf_dir)).select("doc_id", "text", "y0", "y1")


@query("SELECT s_suppkey, s_name || ' ' || s_nationkey || ' ' || s_suppkey AS text, (s_suppkey % 7)::DOUBLE AS x0, 0.0::DOUBLE AS y0, (s_suppkey % 7 + 25)::DOUBLE AS x1, 34.0::DOUBLE AS y1, 1 AS page FROM supplier")
def joined_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three phrases as one."""
    at = F.col("s_suppkey") % 7
    part = lambda k, t: F.struct(t.cast("string").alias("text"), (at + 10.0 * k).alias("x0"), F.lit(12.0 * k).alias("y0"), (at + 10.0 * k + 5).alias("x1"), F.lit(12.0 * k + 10).alias("y1"), F.lit(1).alias("page"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select("s_suppkey", P.join_three(part(0, F.col("s_name")), part(1, F.col("s_nationkey")), part(2, F.col("s_suppkey"))).alias("j")).select("s_suppkey", "j.*")


@query(
    """SELECT event_id, CASE event_id % 7 WHEN 0 THEN event_type WHEN 1 THEN '9:30AM' WHEN 2 THEN 'Courtesy: ' || user_id WHEN 3 THEN 'Date | ' || user_id || ' | Action | ' || event_type
  WHEN 4 THEN 'F/P | Action' WHEN 5 THEN 'a:b:' || user_id ELSE event_type || ' | ' || user_id END AS parts, CASE event_id % 7 WHEN 3 THEN 4 WHEN 4 THEN 2 WHEN 6 THEN 2 ELSE 1 END AS n FROM events"""
)
def colon_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases without a colon, times, courtesy lines, an action after a date, a header that runs together, two colons, one colon."""
    text = F.expr("""CASE event_id % 7 WHEN 0 THEN event_type WHEN 1 THEN '9:30AM' WHEN 2 THEN concat('Courtesy: ', user_id) WHEN 3 THEN concat('Date: ', user_id, ' Action: ', event_type)
        WHEN 4 THEN concat('F/PAction ', user_id) WHEN 5 THEN concat('a:b:', user_id) ELSE concat(event_type, ': ', user_id) END""")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", P.split_colons(text).alias("p"))
    return rows.select("event_id", F.array_join("p", " | ").alias("parts"), F.size("p").alias("n"))


@query(
    _PHRASES
    + """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY phrase_idx, k) - 1)::INT AS phrase_idx, page, text FROM (
  SELECT doc_id, phrase_idx, page, 0 AS k, text FROM f WHERE text NOT LIKE 'Sheet %' UNION ALL SELECT doc_id, phrase_idx, page, unnest([0, 1]), unnest(['Sheet', page::VARCHAR]) FROM f WHERE text LIKE 'Sheet %')"""
)
def legacy_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rule as a whole, where page labels hold a colon."""
    phrases = forms(spark, sf_dir).withColumn("text", F.regexp_replace("text", "^Sheet ", "Sheet: "))
    return P.legacy_phrases(_words(phrases), gap=7.0).select("doc_id", "phrase_idx", "page", "text")


@query(
    """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 12 + 1) || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') || 'AM' WHEN 1 THEN '13:30PM' WHEN 2 THEN value::VARCHAR ELSE props END AS text FROM events)
SELECT event_id, coalesce(regexp_full_match(text, '(1[0-2]|0?[1-9]):[0-5][0-9](AM|PM|am|pm)'), false) AS is_time, try_cast(text AS DOUBLE) IS NOT NULL AS is_number FROM t"""
)
def valid_time_and_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE event_id % 4 WHEN 0 THEN concat(event_id % 12 + 1, ':', lpad(CAST(event_id % 60 AS STRING), 2, '0'), 'AM') WHEN 1 THEN '13:30PM' WHEN 2 THEN CAST(value AS STRING) ELSE props END")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", P.is_time(text).alias("is_time"), P.is_number(text).alias("is_number"))


_FIELDS = ", ".join(f"'{f}'" for f in (*KV_FIELDS, *TABLE_FIELDS))


@query(
    _PHRASES
    + f""", seen AS (SELECT doc_id, text, phrase_idx, row_number() OVER (PARTITION BY doc_id, text ORDER BY phrase_idx) AS k FROM f WHERE text IN ({_FIELDS})),
cuts AS (SELECT doc_id, max(phrase_idx) AS cut, count(*) AS n FROM seen WHERE k = 2 GROUP BY ALL)
SELECT f.doc_id, count(*) AS n FROM f LEFT JOIN (SELECT * FROM cuts WHERE n = 13) q ON f.doc_id = q.doc_id WHERE (cut IS NOT NULL AND phrase_idx <= cut + 31) OR (cut IS NULL AND page < 2) GROUP BY ALL"""
)
def learning_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.learning_prefix(forms(spark, sf_dir), [*KV_FIELDS, *TABLE_FIELDS]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query(
    _PHRASES
    + f""", w AS (SELECT doc_id, page, y0, phrase_idx, text IN ({_FIELDS}) AS k, lead(text IN ({_FIELDS})) OVER (PARTITION BY doc_id, page, y0 ORDER BY phrase_idx) AS k2 FROM f),
g AS (SELECT doc_id, page, y0, count(*) FILTER (k AND k2) AS kk, count(*) FILTER (k AND NOT k2) AS kv, count(*) FILTER (NOT k AND NOT k2) AS vv FROM w GROUP BY ALL)
SELECT doc_id, page, y0, CASE WHEN kk + kv + vv = 0 THEN 0.001 ELSE round(kk / (kk + kv + vv) + 0.001, 9) END AS k, CASE WHEN kk + kv + vv = 0 THEN 0.001 ELSE round(vv / (kk + kv + vv) + 0.001, 9) END AS v,
  CASE WHEN kk + kv + vv = 0 THEN 0.001 ELSE round(kv / (kk + kv + vv) + 0.001, 9) END AS kv FROM g"""
)
def pair_label_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.row_probabilities(_rows(spark, sf_dir), [*KV_FIELDS, *TABLE_FIELDS])
    return rows.select("doc_id", "page", F.expr("cells[0].y0").alias("y0"), *[F.round(c, 9).cast("double").alias(c.lower()) for c in ("K", "V", "KV")])


@query(_PHRASES + "SELECT doc_id, count(DISTINCT page) AS metadata_rows FROM f GROUP BY ALL")
def header_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = [["Order Report", f"Sheet {p}"] for p in range(1, 26)]
    rows = L.smooth_headers(L.row_probabilities(_rows(spark, sf_dir), [*KV_FIELDS, *TABLE_FIELDS], METADATA, pages))
    return rows.where("M >= 1").groupBy("doc_id").agg(F.count("*").alias("metadata_rows"))


@query(
    source(
        f""", x AS (SELECT doc_id, record_id, row_no, unnest([{', '.join(f"{{'c': {c}, 'v': v{c}}}" for c in range(7))}], recursive := true) FROM lines)
SELECT doc_id, record_id::INT AS record_id, c::INT AS col_no, max(least(80, 6 * length(v)))::DOUBLE AS width FROM x WHERE v IS NOT NULL GROUP BY ALL"""
    )
)
def column_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of columns over the cells of a block."""
    cells = _cells(spark, sf_dir, kind="table").where("value IS NOT NULL")
    return cells.groupBy("doc_id", "record_id", "col_no").agg(F.max(F.least(F.lit(80.0), 6.0 * F.length("value"))).alias("width"))


def _engine() -> Engine:
    return Engine(metadata=METADATA, metadata_rows=[["Order Report", f"Sheet {p}"] for p in range(1, 26)])


def _sample(spark: SparkSession, sf_dir: str, engine: Engine, variant: str = "") -> DataFrame:
    """The phrases of the documents that the engine learns from, rendered once; of the others the keys are read."""
    first = [r["doc_id"] for r in form_documents(spark, sf_dir).orderBy("doc_id").limit(engine.documents).collect()]
    return materialised(forms(spark, sf_dir, variant).where(F.col("doc_id").isin(first)))


def _learned(spark: SparkSession, sf_dir: str, variant: str = "") -> DataFrame:
    """Nodes of the template that is learned from the first documents, fields and all."""
    engine = _engine()
    sample = _sample(spark, sf_dir, engine, variant)
    found = engine.predict_template(sample, engine.predict_field(sample))
    return spark.createDataFrame([(n.node_id, n.type, "|".join(n.fields), n.child) for n in found], "node_id int, type string, fields string, child int")


def _extracted(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    """All cells by the template that is learned from the same forms."""
    engine = _engine()
    sample = _sample(spark, sf_dir, engine, variant)
    cells = engine.extract_data(forms(spark, sf_dir, variant), engine.predict_template(sample, engine.predict_field(sample)), dealt=True)
    return cells.select("doc_id", "record_id", "block_id", "block_type", "row_no", "col_no", "key", F.coalesce("value", F.lit(X.MISSING)).alias("value"))


def _nodes(*nodes: tuple) -> str:
    values = ", ".join(f"({k}, '{kind}', '{'|'.join(fields)}', {child})" for k, (kind, fields, child) in enumerate(nodes))
    return f"SELECT * FROM (VALUES {values}) t(node_id, type, fields, child)"


@query(_nodes(("kv", KV_FIELDS, -1), ("table", TABLE_FIELDS, -1)))
def template_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(spark, sf_dir)


@query(_nodes(("kv", KV_FIELDS, -1), ("table", TABLE_FIELDS, 2), ("table", ("Mode", "Flag"), -1)))
def template_learned_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inner table leaves the outer one open and is its child."""
    return _learned(spark, sf_dir, "nested")


@query(_nodes(("kv", KV_FIELDS, -1), ("table", TABLE_FIELDS, 3), ("table", DEEP_FIELDS[0], 3), ("table", DEEP_FIELDS[1], -1)))
def template_learned_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table within a table within a table."""
    return _learned(spark, sf_dir, "deep")


@query(_NESTED)
def form_extract_learned_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is given but the phrases: fields, the nested template and all cells."""
    return _extracted(spark, sf_dir, "nested")


def _deep_rows(block: int, row: str, keys: tuple, values: list[str], where: str = "n = 1") -> str:
    pairs = ", ".join(f"{{'c': {c}, 'k': '{k}', 'v': {v}}}" for c, (k, v) in enumerate(zip(keys, values, strict=True)))
    return f"SELECT 'forms_' || d AS doc_id, rk AS record_id, {block} AS block_id, 'table' AS block_type, {row} AS row_no, unnest([{pairs}]) AS x FROM o JOIN l ON l_orderkey = o_orderkey WHERE {where}"


_DEEP = source(
    f""", h AS (SELECT doc_id, record_id, unnest([{', '.join(f"{{'c': {c}, 'k': '{k}', 'v': v{c}}}" for c, k in enumerate(KV_FIELDS))}]) AS x FROM heads),
  t AS (SELECT doc_id, record_id, row_no, unnest([{', '.join(f"{{'c': {c}, 'k': '{k}', 'v': v{c}}}" for c, k in enumerate(TABLE_FIELDS))}]) AS x FROM lines),
  u AS (SELECT doc_id, record_id, 0 AS block_id, 'kv' AS block_type, 1 AS row_no, x FROM h UNION ALL SELECT doc_id, record_id, 1, 'table', row_no, x FROM t
    UNION ALL {_deep_rows(2, '1', DEEP_FIELDS[0], ["'mode ' || l_suppkey", "'flag ' || l_partkey", "'tax ' || l_suppkey", "'batch ' || l_partkey"])}
    UNION ALL {_deep_rows(2, '2', DEEP_FIELDS[0], ["'again ' || l_suppkey", "'more ' || l_partkey", "'rate ' || l_suppkey", "'last ' || l_partkey"])}
    UNION ALL {_deep_rows(3, '1', DEEP_FIELDS[1], ["'grade ' || l_suppkey", "'lot ' || l_partkey"])})
SELECT doc_id, record_id::INT AS record_id, block_id, block_type, row_no::INT AS row_no, x.c::INT AS col_no, x.k AS key, coalesce(x.v, 'missing') AS value FROM u"""
)


@query(_DEEP)
def form_extract_learned_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, "deep")


def _bill_engine() -> Engine:
    rows = [[name, f"Sheet {p}"] for name in ("Order Report", "Bill Report") for p in range(1, 26)]
    return Engine(metadata=[*METADATA, "Bill Report"], metadata_rows=rows)


@query(
    _PHRASES
    + """SELECT doc_id, CASE WHEN regexp_extract(doc_id, '[0-9]+$')::INT % 2 = 0 THEN 'forms' ELSE 'bills' END AS layout FROM (
  SELECT DISTINCT CASE WHEN d % 2 = 0 THEN 'forms_' ELSE 'bills_' END || d AS doc_id FROM h)"""
)
def document_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two interleaved layouts, told apart by what recurs; a layout is named by its least document."""
    return Y.group_layouts(two_layouts(spark, sf_dir)).select("doc_id", F.split("layout", "_")[0].alias("layout"))


_BILL_KV = ", ".join(f"{{'c': {c}, 'k': '{k}', 'v': v{c}}}" for c, k in enumerate(BILL_FIELDS))
_BILL_TABLE = ", ".join(f"{{'c': {c}, 'k': '{k}', 'v': v{o}}}" for c, (o, k) in enumerate(BILL_COLUMNS.items()))
_FORM_KV = ", ".join(f"{{'c': {c}, 'k': '{k}', 'v': v{c}}}" for c, k in enumerate(KV_FIELDS))
_FORM_TABLE = ", ".join(f"{{'c': {c}, 'k': '{k}', 'v': v{c}}}" for c, k in enumerate(TABLE_FIELDS))


@query(
    source(
        f""", h AS (SELECT *, split_part(doc_id, '_', 2)::INT AS d FROM heads), t AS (SELECT *, split_part(doc_id, '_', 2)::INT AS d FROM lines),
u AS (SELECT doc_id, record_id, 0 AS block_id, 1 AS row_no, unnest([{_FORM_KV}]) AS x FROM h WHERE d % 2 = 0 UNION ALL SELECT 'bills_' || d, record_id, 0, 1, unnest([{_BILL_KV}]) FROM h WHERE d % 2 = 1
  UNION ALL SELECT doc_id, record_id, 1, row_no, unnest([{_FORM_TABLE}]) FROM t WHERE d % 2 = 0 UNION ALL SELECT 'bills_' || d, record_id, 1, row_no, unnest([{_BILL_TABLE}]) FROM t WHERE d % 2 = 1)
SELECT doc_id, record_id::INT AS record_id, block_id, row_no::INT AS row_no, x.c::INT AS col_no, x.k AS key, coalesce(x.v, 'missing') AS value FROM u"""
    )
)
def extract_two_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts, a template for each and all cells, from the phrases alone."""
    # rendered again by each step: orders and lines are a fraction of what their phrases, kept, would take of the disk
    phrases, engine = two_layouts(spark, sf_dir), _bill_engine()
    cells = engine.extract_layouts(phrases, *engine.predict_layouts(phrases), dealt=True)
    return cells.select("doc_id", "record_id", "block_id", "row_no", "col_no", "key", F.coalesce("value", F.lit(X.MISSING)).alias("value"))


@query(_PHRASES + "SELECT DISTINCT doc_id, unnest(['Order Key', 'Customer', 'status']) AS field FROM f")
def edit_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add 'status' (a phrase in another case) and 'Nowhere' (no phrase), remove 'Quantity'."""
    phrases = forms(spark, sf_dir)
    docs = phrases.select("doc_id").distinct()
    having = lambda *names: docs.select("doc_id", F.explode(F.array(*map(F.lit, names))).alias("field"))
    return U.field_edits(having("Order Key", "Customer", "Quantity"), having("status", "Nowhere"), having("Quantity"), phrases)


@query("SELECT * FROM (VALUES (0, 'table', 'A|B', -1), (2, 'kv', 'Mode|Flag', -1)) t(node_id, type, fields, child)")
def edit_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of the template that is learned from nested forms: a type turned, a node removed, another rewritten."""
    engine = _engine()
    sample = _sample(spark, sf_dir, engine, "nested")
    learned = engine.predict_template(sample, engine.predict_field(sample))
    found = T.modify_node(T.remove_nodes(T.toggle_type(learned, 2), [1]), 0, "table", ["A", "B"])
    return spark.createDataFrame([(n.node_id, n.type, "|".join(n.fields), n.child) for n in found], "node_id int, type string, fields string, child int")


@query(
    """SELECT conv_id, turn, round(CASE turn % 3 WHEN 0 THEN (length(text) * 5 + 100 * 20) / 1e6 WHEN 1 THEN (length(text) * 0.3 + 100 * 2.4) / 1e6 ELSE (2 * 1105 * 0.3 + 100 * 2.4) / 1e6 END, 12) AS cost FROM conversations"""
)
def llm_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    model = F.expr("CASE turn % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' ELSE 'gpt-4o-mini-vision' END")
    return rows.select("conv_id", "turn", F.round(call_cost(model, F.length("text"), F.lit(100), F.lit(2)), 12).alias("cost"))


@query()
def llm_token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of the conversations as model calls: each turn's text is the prompt, the next turn's the reply."""
    count = token_counter(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", count("text").alias("tokens_in"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = turns.withColumn("tokens_out", F.coalesce(F.lead("tokens_in").over(order), F.lit(0)))
    return turns.withColumn("cost", F.round(call_cost(F.lit("gpt-4o-mini"), F.col("tokens_in"), F.col("tokens_out"), F.lit(0)), 12))


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(_TABLE)
def form_extract_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table cell again, from a stream of files over which the pages of all documents are scattered."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    phrases = forms(spark, sf_dir)
    pages = F.max("page").over(Window.partitionBy("doc_id"))
    scattered = F.pmod(F.xxhash64("doc_id", "page"), F.lit(12))
    phrases.withColumn("pages", pages).repartition(12, scattered).write.parquet(f"{folder}/in")
    kept = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        pages = [["Order Report", f"Sheet {p}"] for p in range(1, 26)]
        run = extract_page_stream(read_page_stream(spark, f"{folder}/in", files=4), FORM, f"{folder}/out", f"{folder}/checkpoint", METADATA, pages)
        run.awaitTermination()
    finally:
        if kept is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, kept)
    return _table(spark.read.parquet(f"{folder}/out"))


@query(source(" SELECT doc_id, record_id::INT AS record_id, row_no::INT AS row_no, " + ", ".join(f"coalesce(v{c}, 'missing') AS \"{k}\"" for c, k in enumerate(TABLE_FIELDS)) + " FROM lines"))
def table_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table_pivot(_cells(spark, sf_dir, kind="table"), list(TABLE_FIELDS)).drop("block_id")


@query(_KV.replace("0 AS block_id, x.c::INT AS col_no, ", "").replace("record_id::INT AS record_id", "record_id::INT AS id"))
def kv_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs out of the nested records."""
    return V.explode_pairs(X.nest(_cells(spark, sf_dir, kind="kv")))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 5 = 1 THEN 'undecoded' WHEN regexp_matches(url, '^https?://') THEN 'url' ELSE 'text' END AS class FROM pages")
def render_value_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("CASE page_id % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN concat('(cid:', page_id, ')') ELSE url END")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", V.value_class(value).alias("class"))


@query(
    """WITH t AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>'), lambda x: trim(x)), lambda x: x <> '') AS t FROM pages)
SELECT page_id::VARCHAR AS doc_id, (unnest(range(len(t))))::INT AS word_idx, 1 AS page, unnest(t) AS text FROM t"""
)
def page_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts between the tags of web pages."""
    return S.html_words(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query(
    _PHRASES
    + """, r AS (SELECT doc_id, page, y0, string_agg(regexp_replace(text, '[0-9]+', '#', 'g'), '|' ORDER BY phrase_idx) AS shape, list(text) AS texts FROM f GROUP BY ALL),
n AS (SELECT doc_id, count(DISTINCT page) AS pages FROM f GROUP BY ALL), s AS (SELECT doc_id, shape, y0, count(DISTINCT page) AS n, flatten(list(texts)) AS texts FROM r GROUP BY ALL)
SELECT DISTINCT s.doc_id, unnest(texts) AS text FROM s JOIN n ON s.doc_id = n.doc_id WHERE s.n >= 0.5 * pages AND s.n >= 3"""
)
def metadata_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of rows that recur on half of a document's pages at one height, digits apart."""
    return metadata_by_recurrence(_rows(spark, sf_dir))


@query(_PHRASES + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, y0) - 1)::INT AS row_id, page, string_agg(text, ' | ' ORDER BY phrase_idx) AS text FROM f GROUP BY doc_id, page, y0")
def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.row_texts(_rows(spark, sf_dir))


@query(_COUNTS + "SELECT doc_id, (4 * records + n + pages - 1)::BIGINT AS n_rows FROM p")
def rows_without_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.without_last_row(_rows(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_rows"))


@query("SELECT conv_id, round(sum(CASE turn % 3 WHEN 0 THEN (length(text) * 5 + 100 * 20) / 1e6 WHEN 1 THEN (length(text) * 0.3 + 100 * 2.4) / 1e6 ELSE (2 * 1105 * 0.3 + 100 * 2.4) / 1e6 END), 9) AS cost FROM conversations GROUP BY ALL")
def total_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of a conversation in sum."""
    return cost_in_sum(llm_cost(spark, sf_dir), ["conv_id"]).select("conv_id", F.round("cost", 9).alias("cost"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice::DECIMAL(18,2)::VARCHAR AS price, '0.00' AS absent FROM lineitem")
def two_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", V.two_decimals(F.col("l_extendedprice").cast("decimal(18,2)")).alias("price"), V.two_decimals(F.lit(None).cast("double")).alias("absent"))


@query("SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_nationkey % 2, n_name) AS phrases FROM nation GROUP BY ALL")
def flattened_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of names of a region as one list."""
    half = lambda k: F.sort_array(F.collect_list(F.when(F.col("n_nationkey") % 2 == k, F.col("n_name"))))
    groups = spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").agg(F.create_map(F.lit("even"), half(0), F.lit("odd"), half(1)).alias("g"))
    return groups.select("n_regionkey", F.array_join(V.flatten_groups(F.col("g")), "|").alias("phrases"))


@query("""SELECT c_custkey, '{"segment":"' || c_mktsegment || '","name":"' || c_name || '","key":"' || c_custkey || '"}' AS json FROM customer""")
def ordered_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given keys first, absent ones left out, others after them."""
    record = F.create_map(F.lit("name"), F.col("c_name"), F.lit("key"), F.col("c_custkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", V.ordered_json(record, ["segment", "absent", "name"]).alias("json"))


@query(source(f""" SELECT DISTINCT doc_id, record_id::INT AS id, 1 AS block_no, '{"|".join(TABLE_FIELDS)}' AS columns FROM lines"""))
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table_columns(X.nest(_cells(spark, sf_dir))).select("doc_id", "id", "block_no", F.array_join("columns", "|").alias("columns"))


_JSON_KV = " || ',' || ".join(f"""'{{"{k}":"' || v{c} || '"}}'""" for c, k in enumerate(KV_FIELDS))
_JSON_ROW = " || ',' || ".join(f"""'"{k}":"' || coalesce(v{c}, 'missing') || '"'""" for c, k in enumerate(TABLE_FIELDS))


@query(
    source(f""", t AS (SELECT doc_id, record_id, string_agg('{{' || {_JSON_ROW} || '}}', ',' ORDER BY row_no) AS rows FROM lines GROUP BY ALL)
SELECT doc_id, record_id::INT AS id, '[{{"type":"kv","content":[' || {_JSON_KV} || ']}},{{"type":"table","content":[' || rows || ']}}]' AS content FROM heads JOIN t USING (doc_id, record_id)""")
)
def downloaded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole nested records as JSON text."""
    nested = X.nest(_cells(spark, sf_dir))
    return V.download(nested.select("*", F.struct("doc_id", "id").alias("at")).drop("doc_id").withColumnRenamed("at", "doc_id")).select("doc_id.doc_id", "doc_id.id", "content")


@query("SELECT conv_id, turn, CASE WHEN turn < 2 THEN 'reply ' || turn END AS reply FROM conversations")
def answered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded replies met by prompt; others have none."""
    prompts = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.concat(F.lit("turn "), "turn").alias("prompt"))
    answers = spark.createDataFrame([("turn 0", "reply 0"), ("turn 1", "reply 1"), ("turn 1", "reply 1"), ("turn x", "?")], "prompt string, reply string")
    return answered(prompts, answers).select("conv_id", "turn", "reply")


_KEYWORD = "^[A-Za-z][A-Za-z .#/()&'-]{1,40}$"


def recorded_model(prompt: str, image: str | None = None) -> str:
    """What a model said of the forms: keywords in its own spelling, yes or no, the first row's texts as the header."""
    asked, _, listed = prompt.rpartition(": ")
    texts = listed.split("|")
    if asked.startswith("Which of these phrases"):
        return " | ".join(t.upper() for t in texts if re.match(_KEYWORD, t)) or "NO"
    if asked.startswith("Is this row"):
        return "Yes." if texts[0] == "Order Report" else "No."
    if asked.startswith("Is the second phrase"):
        fields = {*KV_FIELDS, *TABLE_FIELDS}
        return "yes" if texts[0] in fields and texts[1] not in fields else "no"
    return f"{texts[0]} | {texts[1]} |"


def _asked(questions: DataFrame, memo: str | None = None) -> DataFrame:
    return Q.answer_all(questions, memo or f"{shared_folder(questions.sparkSession)}/memo-{uuid.uuid4().hex}", recorded_model)


def _keyword_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept as a table: they are read for their different prompts and again for the replies, and the forms need not be rendered twice."""
    return materialised(Q.keyword_questions(K.frequent(K.position_vectors(forms(spark, sf_dir))), ["doc_id"], ["first_pos", "phrase"]))


@query(_PHRASES + "SELECT doc_id, text AS phrase FROM f WHERE regexp_matches(text, '^[A-Za-z][A-Za-z .#/()&''-]{1,40}$') GROUP BY ALL HAVING count(*) > 3")
def asked_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that a model calls keywords, a hundred to a question."""
    return _asked(_keyword_questions(spark, sf_dir)).select("doc_id", F.explode(Q.named(F.col("reply"), F.col("phrases"))).alias("phrase"))


@query(_PHRASES + "SELECT doc_id, upper(text) AS spelled FROM f WHERE regexp_matches(text, '^[A-Za-z][A-Za-z .#/()&''-]{1,40}$') GROUP BY doc_id, text HAVING count(*) > 3")
def asked_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as the replies spell them."""
    return _asked(_keyword_questions(spark, sf_dir)).select("doc_id", F.explode(Q.cleaned(F.col("reply"), F.col("phrases"))).alias("spelled"))


@query(_PHRASES + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, y0) - 1)::INT AS row_id, min_by(text, phrase_idx) = 'Order Report' AS is_metadata FROM f GROUP BY doc_id, page, y0")
def asked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a model calls a row a header or a footer, for every row."""
    return _asked(Q.row_questions(_rows(spark, sf_dir))).select("doc_id", "row_id", Q.says_yes(F.col("reply")).alias("is_metadata"))


_SIDES = "transform(filter(sequence(0, size(cells) - 1), i -> i % 2 = 0 AND i < size(cells) - 1), i -> named_struct('key', cells[i].text, 'value', cells[i + 1].text))"


def _pair_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.pair_questions(_rows(spark, sf_dir).select("doc_id", "row_id", F.expr(f"inline({_SIDES})")))


@query(
    _PHRASES
    + f""", r AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY page, y0) - 1 AS row_id, text, lead(text) OVER w AS after, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY doc_id, page, y0 ORDER BY phrase_idx))
SELECT doc_id, row_id::INT AS row_id, avg((text IN ({_FIELDS}) AND after NOT IN ({_FIELDS}))::INT) AS share FROM r WHERE k % 2 = 1 AND after IS NOT NULL GROUP BY ALL"""
)
def asked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of a row's neighbours that a model calls a field and its value, for every row."""
    judged = _asked(_pair_questions(spark, sf_dir)).withColumn("yes", Q.says_yes(F.col("reply")).cast("int"))
    return judged.groupBy("doc_id", "row_id").agg(F.avg("yes").alias("share"))


@query(_PHRASES + "SELECT DISTINCT doc_id, unnest(['Order Report', 'Sheet 1']) AS text FROM f")
def asked_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header's strings of every document's first page, as a model lists them."""
    replies = _asked(Q.header_questions(_rows(spark, sf_dir)))
    return replies.select("doc_id", F.explode(F.array_distinct(F.filter(Q.reply_parts(F.col("reply")), lambda x: x != ""))).alias("text"))


@query(
    _PHRASES
    + f""", r AS (SELECT doc_id, page, y0, string_agg(text, '|' ORDER BY phrase_idx) AS t FROM f GROUP BY ALL),
p AS (SELECT text, lead(text) OVER w AS after, row_number() OVER w AS k FROM f WINDOW w AS (PARTITION BY doc_id, page, y0 ORDER BY phrase_idx))
SELECT 'pairs' AS kind, count(DISTINCT text || '|' || after) AS prompts, count(DISTINCT text || '|' || after) AS calls, 0::BIGINT AS again FROM p WHERE k % 2 = 1 AND after IS NOT NULL
UNION ALL SELECT 'rows', count(DISTINCT t), count(DISTINCT t), 0 FROM r"""
)
def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different prompts, calls that were made for all rows, and calls of a second run over the same memo."""
    found = []
    for kind, questions in (("rows", Q.row_questions(_rows(spark, sf_dir))), ("pairs", _pair_questions(spark, sf_dir))):
        folder = f"{shared_folder(spark)}/calls-{uuid.uuid4().hex}"
        # both runs and the count read the prompts of one rendering; these and the memo go once all is counted
        questions.select("prompt").write.parquet(f"{folder}/prompts", compression="zstd")
        asked, calls = spark.read.schema("prompt string").parquet(f"{folder}/prompts"), []
        for _ in range(2):
            _asked(asked, f"{folder}/memo")
            calls.append(spark.read.schema(Q.MEMO).parquet(f"{folder}/memo").agg(F.coalesce(F.sum("attempts"), F.lit(0))).first()[0])
        found.append((kind, asked.agg(F.count_distinct("prompt")).first()[0], calls[0], calls[1] - calls[0]))
        S.delete_artifact(spark, folder)
    return spark.createDataFrame(found, "kind string, prompts long, calls long, again long")


@query(_nodes(("kv", KV_FIELDS, -1), ("table", TABLE_FIELDS, -1)))
def template_learned_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template that is learned with a model's replies, asked as tables."""
    oracle = Q.TableOracle(recorded_model, memo=f"{shared_folder(spark)}/memo-{uuid.uuid4().hex}", spark=spark)
    engine = Engine(oracle, METADATA, [["Order Report", f"Sheet {p}"] for p in range(1, 26)])
    sample = _sample(spark, sf_dir, engine)
    found = engine.predict_template(sample, engine.predict_field(sample))
    return spark.createDataFrame([(n.node_id, n.type, "|".join(n.fields), n.child) for n in found], "node_id int, type string, fields string, child int")


@query(_PHRASES + "SELECT doc_id, phrase_idx, page, text, x0, y0, x1, y1 FROM f WHERE page <= 3 AND doc_id <> 'forms_1'")
def exchange_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All phrases written as files of a run and read back through the data source, which skips pages itself."""
    folder = f"{shared_folder(spark)}/exchange-{uuid.uuid4().hex}"
    S.write_phrases(forms(spark, sf_dir), folder, dealt=True)
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(PhraseFolder)
    return spark.read.format("phrase_folder").load(folder).where("page <= 3 AND doc_id <> 'forms_1'")


@query(_PHRASES + "SELECT doc_id, phrase_idx AS word_idx, page, text, x0, y0, x1, y1 FROM f")
def exchange_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a word table, by Spark's own reader; a folder names its document."""
    folder = f"{shared_folder(spark)}/exchange-{uuid.uuid4().hex}"
    S.write_phrases(forms(spark, sf_dir), folder, dealt=True)
    return S.read_words(spark, f"{folder}/*/*.csv", in_place=True)


@query(_PHRASES + "SELECT DISTINCT text FROM f")
def exchange_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases as a file of lines, and the different ones of it as ground phrases."""
    folder = f"{shared_folder(spark)}/exchange-{uuid.uuid4().hex}"
    S.write_lines(forms(spark, sf_dir), folder, order="phrase_idx")
    return S.ground_phrases(spark, folder)


@query(_KV.replace("0 AS block_id, x.c::INT AS col_no, ", "").replace("record_id::INT AS record_id", "record_id::INT AS id"))
def exchange_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records written as JSON by document, with the template beside them, and read again."""
    folder = f"{shared_folder(spark)}/exchange-{uuid.uuid4().hex}"
    S.write_template(spark, FORM, f"{folder}/template")
    nested = X.nest(_cells(spark, sf_dir, template=S.read_template(spark, f"{folder}/template"), kind="kv"))
    S.write_nested(nested, f"{folder}/records", "gzip")
    back = spark.read.schema(nested.schema).json(f"{folder}/records")
    return V.explode_pairs(back.select(nested.columns))


@query(_PHRASES + "SELECT 'merged' AS doc_id, count(*) AS phrases, (SELECT sum(p) FROM (SELECT max(page) AS p FROM f GROUP BY doc_id))::INT AS pages, (count(*) - 1)::INT AS last FROM f")
def merged_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_documents(forms(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("phrases"), F.count_distinct("page").cast("int").alias("pages"), F.max("phrase_idx").alias("last"))


@query("SELECT o_orderkey, (row_number() OVER w - 1)::BIGINT AS place, coalesce(sum((o_totalprice * 100)::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cents, coalesce(lead(o_orderkey) OVER w, -1)::BIGINT AS following FROM orders WINDOW w AS (ORDER BY o_orderdate, o_orderkey)")
def ordered_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, running sums and next rows of all orders by date, no task of which sees all."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"), F.lit(1).cast("long").alias("one"))
    summed = prefix_sums(orders, ["o_orderdate", "o_orderkey"], {"place": "one", "cents": "c"})
    return with_next(summed, ["o_orderdate", "o_orderkey"], {"following": "o_orderkey"}).select("o_orderkey", "place", "cents", F.coalesce("following", F.lit(-1)).alias("following"))


@query(_PHRASES + "SELECT doc_id, phrase_idx, row_number() OVER (PARTITION BY doc_id, text ORDER BY phrase_idx)::INT AS nth FROM f")
def phrase_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.occurrences(forms(spark, sf_dir)).select("doc_id", "phrase_idx", "nth")


@query("SELECT n_nationkey, 'Report: ' || n_name || ' X' AS meta, true AS whole, false AS part FROM nation")
def metadata_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name counts in a header as a whole, its beginning does not."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.expr("concat('Report: ', n_name, ' X')").alias("meta"), "n_name")
    part = "substring(n_name, 1, length(n_name) - 1)"
    return rows.select("n_nationkey", "meta", F.expr(R.holds_words("meta", "n_name")).alias("whole"), F.expr(R.holds_words("meta", part)).alias("part"))
