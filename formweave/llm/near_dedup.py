"""Near-duplicate documents: bottom-k sketches of one hash, inverted lists, exact verification.

1. Every row becomes its set of hashed word shingles and the sketch of its k least
   hashes.  Rows with equal sets form a class at once; a class is one node.
2. Sketch values are ordered rarest first.  Two sets as similar as asked share
   at least ``need`` of k sketch values but for a chance of 1e-6, so both hold
   one of them among their k - need + 1 rarest; only these enter the inverted
   lists.  Values of common passages come last and rarely enter.
3. Within a list, members meet the member with the most widely shared sketch (the
   hub), not each other.  The union sketch of a pair estimates its similarity and
   drops hopeless pairs; the full sets decide the rest.
4. Lists that their hub does not hold together are refined: the rarest shingles of
   the members' full sets, as many as an exact bound asks, make new lists.  Their
   members are compared by their differences to what most of them hold, again
   through lists of the rarest differences (``_around_hubs``).  No list is capped.

Keys that hold more than a share of all rows (a value, a class, a hub) are dealt
over many tasks wherever two tables meet on them (``common.meet``).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import check_columns, cut, hot_keys, meet, placed, without_rows
from .components import connected_components
from .textarrays import mix, shingle_sets


def required_overlap(size: int, k: int, percent: int, loss: float = 1e-6) -> int:
    """Sketch values that two sets share at least if 100 * intersection >= percent * union.

    A sketch that is the whole set obeys the exact bound.  Else the shared values
    number binomial(k, percent / 100) at the threshold; fewer than the result come
    with a chance below ``loss``, and much less for more similar sets.
    """
    if size < k:
        return -(-percent * size // 100)
    p, below, need = percent / 100, 0.0, 0
    while need < k and (below := below + comb(k, need) * p**need * (1 - p) ** (k - need)) < loss:
        need += 1
    return max(1, need)


def _sketcher(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, sets, at in shingle_sets(batch.column(2), width):
                n = np.diff(at)
                one, two = np.zeros((2, last - first), np.uint64)
                full = np.flatnonzero(n > 0)
                if len(full):
                    one[full] = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), at[full])
                    two[full] = np.add.reduceat(mix(sets + np.uint64(0x14057B7EF767814F)), at[full])
                taken = np.minimum(n, k)
                ends = np.concatenate(([0], np.cumsum(taken)))
                pick = np.arange(ends[-1]) + np.repeat(at[:-1] - ends[:-1], taken)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, last - first) for c in batch.columns[:2]), pa.array(n), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sets[pick].view(np.int64)))],
                    names=["row", "id", "n", "s1", "s2", "sketch"],
                )

    return run


def _setter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            for first, last, sets, at in shingle_sets(batch.column(1), width):
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([rows.slice(first, last - first), lists], names=["row", "set"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, sketch: DataFrame, k: int, percent: int, need: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough; the union sketch drops the rest early."""
    pairs = cut(pairs)
    hot = hot_keys(pairs.groupBy("b").agg(F.count("*").alias("c")), "b", "c", pairs.count())
    left, right = (sketch.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}")) for x in "ab")
    least = F.slice(F.array_sort(F.array_union("ka", "kb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect("ka", "kb"), least))
    # both sketches whole: the estimate is exact; else the bound of required_overlap holds
    enough = F.when((F.col("na") <= k) & (F.col("nb") <= k), 100 * shared >= percent * F.size(F.array_union("ka", "kb"))).otherwise(
        shared >= F.least(F.lit(need), F.ceil(F.least("na", "nb") * (percent / 100) - 1))
    )
    close = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & enough
    pairs = meet(pairs.join(left, "a"), right, ["b"], "a", hot).where(close).select("a", "b", "na", "nb")
    left, right = (sets.select(F.col("row").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    pairs = meet(pairs.join(left, "a"), right, ["b"], "a", hot)
    return pairs.where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _rarest(sets: DataFrame, values: str, size, allowed) -> DataFrame:
    """(v, row, n, weight): of each set, the values among its ``allowed`` rarest that other sets hold too."""
    total = sets.agg(F.sum(F.size(values))).first()[0] or 0
    values = sets.select("row", "n", F.explode(values).alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("row", "n")
    return (
        meet(values, common, ["v"], "row", hot_keys(common, "v", "df", total))
        .withColumn("pos", F.row_number().over(own.orderBy("df", "v")))
        .withColumn("seen", F.count("*").over(own))
        .withColumn("weight", F.sum("df").over(own))
        .where(F.col("pos") + size - F.col("seen") <= allowed)
        .select("v", "row", "n", "weight")
    )


def _with_hubs(members: DataFrame) -> DataFrame:
    """The members of lists of two or more, with the list's hub, its most widely shared member."""
    lists = members.groupBy("v").agg(F.count("*").alias("c"), F.max(F.struct("weight", (-F.col("row")).alias("minus"))).alias("hub")).where("c > 1")
    found = meet(members, lists, ["v"], "row", hot_keys(lists, "v", "c", members.count()))
    return found.select("v", "row", "n", (-F.col("hub.minus")).alias("hub"))


def _around_hubs(around: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within the groups (hub, row, n) that connect all that any links of members connect.

    A member x is held as its difference d to the group's middle, the set of what more
    than half of the members hold.  Members x and y differ in |dx| + |dy| - 2 |dx and dy|
    shingles.  With a = 100 - percent, b = 100 + percent and E = b |d| - a n they are
    linked if and only if Ex + Ey <= 2 b |dx and dy|.

    Let y0 have the least E, and M be that E or 0 if it is positive.  Every x with
    Ex + M <= 0 is attached: it is linked with y0, whatever they share.  Attached
    members need no comparison with each other, and neither do those that are linked
    with the hub.  Of any other pair one at least is not attached, so that both share
    a difference: (Ex + M) / 2b of them at least if x is not attached, more than
    (Ex - M) / 2b if it is.  Hence they share one among the rarest of their differences
    but for as many.  A family whose members each have words of their own shares none
    of these and costs nothing more, however large it is.
    """
    a, b = 100 - percent, 100 + percent
    around = cut(around)
    sizes = cut(around.groupBy("hub").agg(F.count("*").alias("c")))
    hot = hot_keys(sizes, "hub", "c", around.count())
    own, hubs = sets.select("row", "set"), sets.select(F.col("row").alias("hub"), F.col("set").alias("hub_set"))
    hubs = hubs.join(sizes, "hub")
    d = F.concat(F.array_except("set", "hub_set"), F.array_except("hub_set", "set"))
    held = meet(around.join(own, "row"), hubs, ["hub"], "row", hot).select("hub", "row", "n", F.size("hub_set").alias("m"), "c", d.alias("d"))
    held = cut(held.withColumn("linked", a * (F.col("n") + F.col("m")) >= b * F.size("d")).drop("m"))

    # the middle is the hub's set but for what more than half of the members have otherwise
    turned = held.select("hub", "c", F.explode("d").alias("v")).groupBy("hub", "v").agg(F.count("*").alias("df"), F.first("c").alias("c")).where("2 * df > c")
    turned = sizes.join(turned.groupBy("hub").agg(F.collect_list("v").alias("turned")), "hub", "left").select("hub", F.coalesce("turned", F.array().cast("array<long>")).alias("turned"))
    held = meet(held, turned, ["hub"], "row", hot).withColumn("d", F.concat(F.array_except("d", "turned"), F.array_except("turned", "d")))
    held = cut(held.select("hub", "row", "n", "d", "linked", F.size("d").alias("size"), (b * F.size("d") - a * F.col("n")).alias("e")))
    best = held.groupBy("hub").agg(F.min(F.struct("e", "row", "linked")).alias("best"))
    held = meet(held, best, ["hub"], "row", hot).withColumn("least", F.least(F.col("best.e"), F.lit(0)))
    attached = F.col("e") + F.col("least") <= 0
    side = F.when(F.col("linked"), 0).when(attached, F.when(F.col("best.linked"), 0).otherwise(1))
    need = F.when(attached, F.floor((F.col("e") - F.col("least")) / (2 * b)) + 1).otherwise(F.greatest(F.ceil((F.col("e") + F.col("least")) / (2 * b)), F.lit(1)))
    held = cut(held.select("hub", "row", "n", "d", "size", "e", "linked", attached.alias("attached"), F.coalesce(side, F.lit(-1)).alias("side"), need.alias("need"), F.col("best.row").alias("y0")))
    found = held.where("linked and row <> hub").select("row", F.col("hub").alias("other")).union(held.where("attached and row <> y0").select("row", "y0"))

    values = held.where("size >= need").select("hub", "row", "need", "size", F.explode("d").alias("v"))
    common = values.groupBy("hub", "v").agg(F.count("*").alias("df")).where("df > 1")
    total = held.agg(F.sum("size")).first()[0] or 0
    each = Window.partitionBy("hub", "row")
    shared = hot_keys(common, "v", "df", total)
    prefix = meet(values, common, ["hub", "v"], "row", shared).withColumn("pos", F.row_number().over(each.orderBy("df", "v"))).withColumn("seen", F.count("*").over(each))
    prefix = prefix.where("pos + size - seen <= size - need + 1").select("hub", "row", "v")
    rows = prefix.join(held.select("hub", "row", "d", "e", "attached", "side"), ["hub", "row"])
    x, y = (rows.select("hub", "v", *[F.col(c).alias(c + end) for c in ("row", "d", "e", "attached", "side")]) for end in "xy")
    pairs = meet(y, x.where("not attachedx"), ["hub", "v"], "rowy", shared).where("attachedy or rowx < rowy").where("sidex <> sidey or sidex < 0")
    pairs = pairs.where(F.col("ex") + F.col("ey") <= 2 * b * F.size(F.array_intersect("dx", "dy")))
    found = found.union(pairs.select("rowx", "rowy")).toDF("x", "y")
    return found.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def near_groups(docs: DataFrame, place: str, id_col: str, text_col: str, width: int, percent: int, k: int) -> DataFrame:
    """(row, id, n, component_id, first) for every row of docs, a table with places.

    component_id is the least id that a row's links reach, first the row that stands for
    the group: the one with the least id, nulls last.
    """
    need = required_overlap(k, k, percent)
    plain = docs.select(F.col(place).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    all_rows = cut(plain.mapInArrow(_sketcher(width, k), "row long, id long, n long, s1 long, s2 long, sketch array<long>"))
    rows = all_rows.where("n > 0")
    key, many = ["n", "s1", "s2"], rows.count()
    classes = rows.groupBy(*key).agg(F.min("row").alias("rep"), F.count("*").alias("c"))
    classes = meet(rows, classes, key, "row", hot_keys(classes, "s1", "c", many))
    named = cut(classes.select("row", "id", "n", F.when(F.col("rep") == F.col("row"), F.col("sketch")).alias("sketch"), "rep", "c"))
    sketch = named.where("rep = row").select("row", "n", "sketch")

    size = F.least("n", F.lit(k))
    bound = F.when(F.col("n") < k, F.ceil(F.col("n") * percent / 100)).otherwise(need)
    members = cut(_rarest(sketch, "sketch", size, size - bound + 1))
    members = cut(_with_hubs(members))
    wanted = members.select("row").distinct()
    texts = plain.select("row", "text").join(wanted, "row", "left_semi")
    sets = cut(texts.mapInArrow(_setter(width), "row long, set array<long>"))
    pairs = members.where("row <> hub").select(F.col("row").alias("a"), F.col("hub").alias("b")).distinct()
    links = cut(_verified(pairs, sets, sketch.join(wanted, "row", "left_semi"), k, percent, need))

    # lists that their hub does not hold together: the exact prefixes of their members' full sets
    loose = members.join(links.select(F.col("a").alias("row"), F.col("b").alias("hub"), F.lit(True).alias("held")), ["row", "hub"], "left")
    loose = loose.where("row <> hub and held is null").select("v").distinct()
    unsettled = members.join(loose, "v", "left_semi").select("row").distinct()
    whole = cut(sets.join(unsettled, "row", "left_semi").withColumn("n", F.size("set").cast("long")))
    exact = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    around = _with_hubs(cut(_rarest(whole, "set", F.col("n"), exact))).select("hub", "row", "n").distinct()
    links = links.union(_around_hubs(around, sets, percent))
    parts = cut(connected_components(links).select(F.col("node").alias("rep"), "component"))

    # classes of one row without a link are groups of their own; the rows of the others learn their group's least id
    nodes = named.where("rep = row").select("rep", "c").join(parts, "rep", "left").where("c > 1 or component is not null")
    nodes = cut(nodes.select("rep", "c", F.coalesce("component", "rep").alias("group")))
    crowd = meet(named.select("row", "id", "rep"), nodes, ["rep"], "row", hot_keys(nodes, "rep", "c", many)).select("row", "id", "group")
    crowd = cut(crowd)
    heads = crowd.groupBy("group").agg(F.count("*").alias("c"), F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("head"))
    crowd = meet(crowd, heads, ["group"], "row", hot_keys(heads, "group", "c", crowd.count())).select("row", "component_id", F.col("head.row").alias("first"))
    out = all_rows.select("row", "id", "n").join(crowd, "row", "left")
    return out.select("row", "id", "n", F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("first", "row").alias("first"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, k: int = 48
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Null or blank texts have no shingles and are components of their own; a text
    with fewer than ``width`` words has one shingle, the whole sequence.  Equal texts
    share a component.  Rows that share an id are judged by their own texts.  A row
    whose id is null links others like any row; it is not kept, and its component is
    null if no linked row has an id.  An empty table gives no rows.  Other columns of
    docs are ignored.  docs is read twice; rows are known by their places (``common.placed``).
    """
    check_columns(docs, id_col, text_col)
    table, place = placed(docs)
    found = near_groups(table, place, id_col, text_col, width, percent, k)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, k: int = 48) -> DataFrame:
    """docs with one row of each group of near copies: the one with the least id, nulls last.

    Rows are told apart by their place, so null and repeated ids lose no text; blank
    and null texts are no copies of each other.
    """
    check_columns(docs, id_col, text_col)
    table, place = placed(docs)
    gone = near_groups(table, place, id_col, text_col, width, percent, k).where("row <> first")
    return without_rows(table, place, gone)


#: The same components in DuckDB: all pairs that share a shingle, and the closure of the links among them.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id > b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 85 * (nx.n + ny.n - shared)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS lowest FROM r GROUP BY ALL)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(lowest, doc_id), doc_id) AS component_id, coalesce(least(lowest, doc_id), doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
