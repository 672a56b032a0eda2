"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, check_columns, cut, fresh, placed, row_place

#: Salts of one size class of a source; ids are scattered over them by a multiplication modulo a prime.
SALTS, PRIME, FACTOR = 61, 1_000_003, 618_041


def offset_of(seed: int) -> float:
    """The one random offset of a mix."""
    return random.Random(seed).random()


def source_targets(totals: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size) with each source's weight and target.

    Sources by code point, null last, take the weights in turn.  Targets share the
    total by weight; a target stops at ``most`` times its source's size and the excess
    is shared again, which one pass in order of size / weight settles.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    exact = "decimal(38,0)"
    in_order = Window.orderBy("fill", "rank")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    after = in_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", cycle.cast("long")).withColumn("cap", F.col("source_size") * most)
    ranked = ranked.withColumn("fill", F.col("cap") / F.col("weight")).withColumn("all", F.sum("source_size").over(everything))
    room = F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    full = room.cast(exact) * F.col("weight") >= F.col("cap").cast(exact) * F.sum("weight").over(after)
    ranked = ranked.withColumn("full", full)
    left = F.col("all") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything)
    share = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise((F.col("weight") * left).cast("double") / share)
    return ranked.withColumn("target", target).select("source", "source_size", "weight", "target")


def _class(size: Column) -> Column:
    """Two leading digits of a size: documents of a class differ by a tenth at most."""
    step = F.pow(F.lit(10), F.greatest(F.length(size.cast("string")) - 2, F.lit(0))).cast("long")
    return size - size % step


def _mixed(docs: DataFrame, place: Column, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """(row, id, size, source_size, target, copies, source) for every row of docs; row is its place."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut(docs.select(place.alias("row"), F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size.alias("size")))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, tuple(weights), most)
    salt = F.coalesce(F.pmod(F.pmod("id", F.lit(PRIME)) * FACTOR, F.lit(PRIME)) % SALTS, F.lit(SALTS))
    cell = [F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), _class(F.col("size")).alias("class"), salt.alias("salt")]
    rows = rows.select("row", "id", "source", "size", *cell)
    keys = ["s", "none", "class", "salt"]
    cells = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    own = Window.partitionBy("s", "none")
    ahead = F.sum("n").over(own.orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("ahead", F.coalesce(ahead, F.lit(0))).withColumn("all", F.sum("n").over(own))
    placed = cells.join(targets.withColumns({"s": F.coalesce("source", F.lit("")), "none": F.col("source").isNull()}).drop("source", "weight"), ["s", "none"])
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("size", "id", "row"))
    rows = rows.withColumn("nth", within).join(placed.drop("n"), keys).withColumn("nth", F.col("ahead") + F.col("nth"))
    at = F.when(F.col("nth") % 2 == 1, F.expr("(nth + 1) div 2")).otherwise(F.col("all") + 1 - F.expr("nth div 2"))
    each = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("at", at).withColumn("each", each)
    start = F.lit(offset_of(seed))
    crossed = F.floor(F.col("at") * F.col("each") + start) - F.floor((F.col("at") - 1) * F.col("each") + start)
    return rows.select("row", "id", "size", "source_size", "target", F.least(crossed, F.lit(most)).cast("long").alias("copies"), "source")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 20240301
) -> DataFrame:
    """(id_col, size, source_size, target, taken, copies, source) for every row of docs.

    A null or blank text has size 0 and takes no words whatever its copies; a null
    source is a source of its own, last; a null id is a row like others.  Repeated
    rows count each.  An empty table gives no rows.  Other columns are ignored.

    Every document of a source expects target / source_size copies; the prefix sum of
    these and the one random offset of the seed give a document a copy for each integer
    that it crosses.  A source's documents stand in order of size, every second one going
    up and the others coming down again, so that neighbours are alike and what the short
    half takes too much, the other half leaves.  The order is counted by (source, size
    class, salt) and never sorts a source in one task.  Ties go by id, then place.
    """
    check_columns(docs, id_col, text_col, source_col)
    rows = _mixed(docs, row_place(), id_col, text_col, source_col, weights, most, seed)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 20240301
) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it, by its place (``common.placed``): null and repeated ids are rows like others.

    Null and blank texts have size 0 and stay as often as a crossing says; of documents of one source
    and size the one with the lesser id stands first.  An empty table stays empty.
    """
    check_columns(docs, id_col, text_col, source_col)
    table, place = placed(docs)
    copies = fresh(table, "_copies")
    taken = _mixed(table, F.col(place), id_col, text_col, source_col, weights, most, seed).where("copies > 0")
    taken = taken.select(F.col("row").alias(place), F.sequence(F.lit(1).cast("long"), "copies").alias(copies))
    return table.join(taken, place).withColumn(copies, F.explode(copies)).drop(place, copies)


#: The same mix in DuckDB.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM t),
c AS (SELECT *, 1 + rank % 3 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM r),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT * weight
        >= cap::HUGEINT * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS is_full
      FROM c WINDOW o AS (ORDER BY cap / weight, rank)),
g AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (weight * (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()))::DOUBLE
        / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () END AS target FROM f),
p AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS each,
        count(*) OVER (PARTITION BY d.source) AS n,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size - d.size % (10 ** greatest(length(d.size::VARCHAR) - 2, 0))::BIGINT,
          coalesce((d.doc_id % {PRIME} + {PRIME}) % {PRIME} * {FACTOR} % {PRIME} % {SALTS}, {SALTS}), d.size, d.doc_id) AS nth
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
o AS (SELECT *, CASE WHEN nth % 2 = 1 THEN (nth + 1) // 2 ELSE n + 1 - nth // 2 END AS place, {offset_of(20240301)!r}::DOUBLE AS start FROM p),
k AS (SELECT *, least(floor(place * each + start) - floor((place - 1) * each + start), 3)::BIGINT AS copies FROM o)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies, source FROM k
"""
