"""Extraction by a template: records, row labels, blocks and cells, as one plan keyed by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from formweave.functions.sql import aligned, center_distance, outside, strings, x_overlap
from formweave.operators.rows import known_row, metadata_share, visual_rows
from formweave.plans.template import LEAF, Template

MISSING = "missing"
#: Share of a row's phrases in metadata strings that makes it a metadata row.
METADATA = 0.7


def _visits(node) -> str:
    """A table row holds nothing but the node's fields, a kv row some of them."""
    texts, fields = "cells.text", strings(node.fields)
    return f"size(array_except({texts}, {fields})) = 0" if node.type == "table" else f"arrays_overlap({texts}, {fields})"


def records(rows: DataFrame, template: Template) -> DataFrame:
    """rows with record_id: a record starts at each row that holds the boundary fields.

    The boundary are the fields of the first node in the first row that visits it;
    rows before belong to the first record, and a document without one is one record.
    """
    if not template:
        raise ValueError("a template needs a node")
    node = template[0]
    texts = "cells.text"
    first = F.expr(f"CASE WHEN {_visits(node)} THEN array_intersect({texts}, {strings(node.fields)}) END")
    whole = Window.partitionBy("doc_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_visit", first).withColumn("_boundary", F.first("_visit", ignorenulls=True).over(whole))
    starts = F.expr(f"CASE WHEN size(array_except(_boundary, {texts})) = 0 THEN 1 ELSE 0 END")
    rows = rows.withColumn("record_id", F.greatest(F.sum(starts).over(Window.partitionBy("doc_id").orderBy("row_id")), F.lit(1)) - 1)
    return rows.withColumn("record_id", F.col("record_id").cast("int")).drop("_visit", "_boundary")


def label_rows(rows: DataFrame, template: Template, metadata: list[str] = (), metadata_rows: list[list[str]] = ()) -> DataFrame:
    """rows with label (K header, V values, KV pairs, M metadata) and node, the first template node that fits."""
    nodes = " ".join(f"WHEN {_visits(n)} THEN {k}" for k, n in enumerate(template))
    kinds = strings("K" if n.type == "table" else "KV" for n in template)
    rows = rows.withColumn("_m", F.expr(f"{known_row(list(metadata_rows))} OR {metadata_share(list(metadata))} >= {METADATA}"))
    rows = rows.withColumn("node", F.expr(f"CASE WHEN _m THEN NULL {nodes} END"))
    return rows.withColumn("label", F.expr(f"CASE WHEN _m THEN 'M' WHEN node IS NULL THEN 'V' ELSE {kinds}[node] END")).drop("_m")


def _one_to_one(k: str, v: str, columns: int) -> str:
    """SQL: whether each value stands under its own header and touches no other: then the row is aligned, and nothing is to be chosen.

    Rows of up to ``columns`` values, as wide as the template's tables, are compared without a lambda, which Spark interprets.
    """
    side = lambda a, i: f"get({a}, {i})"
    own = lambda i: f"{side(v, i)}.x0 <= {side(k, i)}.x1 AND {side(k, i)}.x0 <= {side(v, i)}.x1"
    apart = lambda i, before: f"{side(v, i)}.x0 > {side(k, before)}.x1 AND {side(k, i)}.x0 > {side(v, before)}.x1"
    each = " AND ".join([own(0), *(f"(size({v}) <= {i} OR {own(i)} AND {apart(i, i - 1)})" for i in range(1, columns))])
    wide = f"forall(sequence(0, size({v}) - 1), i -> {own('i')} AND CASE WHEN i > 0 THEN {apart('i', 'i - 1')} ELSE true END)"
    return f"(size({k}) = size({v}) AND CASE WHEN size({v}) <= {columns} THEN {each} ELSE {wide} END)"


def blocks(rows: DataFrame, template: Template) -> DataFrame:
    """Rows of blocks (doc_id, record_id, block_id, block_type, row_id, role, node, cells, header, plain).

    A header row opens a table.  A value row goes to one of the headers above it that it is
    aligned with: the nearest one or, of each node with an inner table, that node's nearest one.
    Of these it takes the one that fewest of its values lie beside, and of equals the lowest, so that
    a row of an outer table is no row of a narrower one within it.  Without one it is dropped.  Pair rows without a header row between them are one kv block.
    ``plain`` rows have one value under each header.
    """
    own = Window.partitionBy("doc_id", "record_id").orderBy("row_id")
    outer = [k for k, n in enumerate(template) if n.child != LEAF]
    columns = max((len(n.fields) for n in template if n.type == "table"), default=1)
    rows = rows.withColumn("_header", F.expr("CASE WHEN label = 'K' THEN named_struct('row', row_id, 'cells', arrays_zip(cells.text, cells.x0, cells.x1), 'node', node) END"))
    # (headers are copied to every row below: their texts and sides are all that is asked of them)
    # of each node with an inner table the last header so far; one pass over the record serves all
    last = {"_near": "_header"} | {f"_outer{k}": f"CASE WHEN node = {k} THEN _header END" for k in outer}
    rows = rows.select("*", *(F.last(F.expr(x), ignorenulls=True).over(own).alias(name) for name, x in last.items()))
    chosen = f"CASE WHEN {aligned('_near.cells', 'cells')} THEN _near END"
    if outer:
        # the nearest first
        held = ", ".join(f"_outer{k}" for k in outer)
        above = f"concat(filter(array(_near), h -> h IS NOT NULL), filter(reverse(array_sort(filter(array({held}), h -> h IS NOT NULL))), h -> h.row < _near.row))"
        ranked = f"transform(filter({above}, h -> {aligned('h.cells', 'cells')}), (h, i) -> named_struct('beside', {outside('h.cells', 'cells')}, 'i', i, 'h', h))"
        chosen = f"array_min({ranked}).h"
    rows = rows.withColumn("plain", F.expr(f"label = 'V' AND _near IS NOT NULL AND {_one_to_one('_near.cells', 'cells', columns)}"))
    fits = F.expr(f"CASE WHEN label = 'K' THEN _header WHEN plain THEN _near WHEN label = 'V' THEN {chosen} END")
    place = F.expr("CASE WHEN label = 'KV' THEN 2 * coalesce(_near.row, -1) + 1 ELSE 2 * header.row END")
    rows = rows.withColumn("header", fits).withColumn("_place", place)
    # rows without a place come last and go once the others are numbered: a filter before would find each row's header a second time
    number = (F.dense_rank().over(Window.partitionBy("doc_id", "record_id").orderBy(F.col("_place").asc_nulls_last())) - 1).cast("int")
    kind = F.expr("CASE WHEN label = 'KV' THEN 'kv' ELSE 'table' END")
    role = F.expr("CASE label WHEN 'KV' THEN 'kv' WHEN 'K' THEN 'header' ELSE 'value' END")
    found = rows.select("doc_id", "record_id", number.alias("block_id"), kind.alias("block_type"), "row_id", role.alias("role"), "node", "cells", "header", "plain", "_place")
    return found.where("_place IS NOT NULL").drop("_place")


def _chosen(block_rows: DataFrame) -> DataFrame:
    """block_rows with ``taken``, for each header of a value row the place of its value, and ``free``, the values that none took.

    1. Each key takes the x-overlapping value with the nearest centre, the first on ties; keys may share one.
    2. Keys still missing take, left to right, the nearest free value strictly between their neighbours' values,
       if the neighbours were found in step 1.
    """
    rows = block_rows.withColumn("k", F.expr("header.cells")).withColumnRenamed("cells", "v")
    near = f"transform(k, a -> array_min(filter(transform(v, (b, j) -> CASE WHEN {x_overlap('a', 'b')} THEN named_struct('d', {center_distance('a', 'b')}, 'j', j) END), z -> z IS NOT NULL)).j)"
    rows = rows.withColumn("first", F.expr(f"CASE WHEN role = 'value' THEN CASE WHEN plain THEN sequence(0, size(v) - 1) ELSE {near} END END"))
    # the span of values open to a missing key, from the first step's neighbours
    low = "CASE WHEN p = 0 THEN -1 ELSE get(first, p - 1) END"
    high = "CASE WHEN p = size(k) - 1 THEN size(v) ELSE get(first, p + 1) END"
    choice = f"array_min(filter(transform(v, (b, j) -> CASE WHEN j > {low} AND j < {high} AND NOT array_contains(s.used, j) THEN named_struct('d', {center_distance('k[p]', 'b')}, 'j', j) END), z -> z IS NOT NULL)).j"
    fold = f"""aggregate(sequence(0, size(k) - 1), named_struct('out', CAST(array() AS ARRAY<INT>), 'used', filter(first, j -> j IS NOT NULL)),
        (s, p) -> CASE WHEN get(first, p) IS NOT NULL THEN named_struct('out', array_append(s.out, get(first, p)), 'used', s.used)
            ELSE aggregate(array({choice}), s, (q, j) -> named_struct('out', array_append(q.out, j), 'used', CASE WHEN j IS NULL THEN q.used ELSE array_append(q.used, j) END)) END)"""
    rows = rows.withColumn("chosen", F.expr(f"CASE WHEN role = 'value' AND NOT plain AND exists(first, j -> j IS NULL) THEN {fold} END"))
    rows = rows.withColumn("taken", F.expr("coalesce(chosen.out, first)"))
    free = "CASE WHEN exists(chosen.out, j -> j IS NULL) THEN filter(v, (b, j) -> NOT array_contains(chosen.used, j)) END"
    return rows.withColumn("free", F.expr(free)).drop("first", "chosen")


def block_cells(block_rows: DataFrame, template: Template) -> DataFrame:
    """Cells (doc_id, record_id, block_id, block_type, row_no, col_no, key, value) of all blocks, value null if missing.

    Tables: a key that took no value (``_chosen``) takes the last free value that lies wholly
    in its column, which reaches over the cells found so far in the block; columns are as many
    as the largest table node has fields.  Pairs: a label followed by a phrase of its block
    that is no label is its key, otherwise its value is null.  One sort by block serves
    all of it, and every row is taken apart once.
    """
    labels = strings(f for n in template for f in n.fields)
    rows = _chosen(block_rows).withColumn("marks", F.expr(f"CASE WHEN role = 'kv' THEN transform(v, c -> array_contains({labels}, c.text)) END"))
    rows = rows.withColumn("n_labels", F.expr("size(filter(marks, m -> m))"))
    block = Window.partitionBy("doc_id", "record_id", "block_id")
    order = block.orderBy("row_id")
    columns = max((len(n.fields) for n in template if n.type == "table"), default=0)
    cell = "get(v, get(taken, {c}))"
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # one pass over the sorted block: a window more for each column would copy all rows once more
    numbers = [F.sum(F.expr("CASE WHEN role = 'value' THEN 1 ELSE 0 END")).over(order).cast("int").alias("row_no"), (F.sum("n_labels").over(order).cast("int") - F.col("n_labels")).alias("ahead")]
    after = F.lead(F.expr("named_struct('text', v[0].text, 'is_label', marks[0])")).over(order).alias("next")
    sides = [
        f(F.expr(f"CASE WHEN role = 'value' THEN {cell.format(c=c)}.{of} END")).over(whole).alias(f"{side}{c}")
        for c in range(columns) for side, of, f in (("low", "x0", F.min), ("high", "x1", F.max))
    ]
    rows = rows.select("*", *numbers, after, *sides)
    bounds = f"array({', '.join(f'named_struct({chr(39)}low{chr(39)}, low{c}, {chr(39)}high{chr(39)}, high{c})' for c in range(columns))})" if columns else "array(named_struct('low', CAST(NULL AS DOUBLE), 'high', CAST(NULL AS DOUBLE)))"
    inside = f"element_at(filter(free, b -> b.x0 >= get({bounds}, p).low AND b.x1 <= get({bounds}, p).high), -1)"
    found = f"CASE WHEN get(taken, p) IS NOT NULL THEN get(v, get(taken, p)).text WHEN size(free) > 0 AND size(filter(free, b -> b.x0 >= get({bounds}, p).low AND b.x1 <= get({bounds}, p).high)) > 0 THEN {inside}.text END"
    table = f"transform(k, (a, p) -> named_struct('col_no', p, 'key', a.text, 'value', {found}))"
    after = "CASE WHEN i < size(v) - 1 THEN CASE WHEN NOT marks[i + 1] THEN v[i + 1].text END WHEN NOT next.is_label THEN next.text END"
    numbered = "transform(v, (c, i) -> named_struct('i', i, 'is_label', marks[i]))"
    pairs = f"transform(transform(filter({numbered}, z -> z.is_label), z -> z.i), (i, p) -> named_struct('col_no', ahead + p, 'key', v[i].text, 'value', {after}))"
    plain = "CAST(arrays_zip(sequence(0, size(v) - 1), k.text, v.text) AS ARRAY<STRUCT<col_no: INT, key: STRING, value: STRING>>)"
    rows = rows.where("role <> 'header'")
    flat = rows.select("doc_id", "record_id", "block_id", "block_type", F.expr("CASE WHEN role = 'kv' THEN 1 ELSE row_no END").alias("row_no"), F.expr(f"inline_outer(CASE WHEN role = 'kv' THEN {pairs} WHEN plain THEN {plain} ELSE {table} END)"))
    return flat.where("col_no IS NOT NULL")


def extract_cells(phrases: DataFrame, template: Template, metadata: list[str] = (), metadata_rows: list[list[str]] = (), dealt: bool = False, kind: str = "") -> DataFrame:
    """All cells of all documents in long form; phrases are dealt once, by document, unless they are ``dealt`` so already.

    Of blocks of one ``kind`` (kv or table) alone, if given: the others are numbered, but not sorted and taken apart.
    """
    rows = label_rows(records(visual_rows(phrases, dealt=dealt), template), template, metadata, metadata_rows)
    found = blocks(rows, template)
    return block_cells(found.where(F.col("block_type") == kind) if kind else found, template)


def nest(cells: DataFrame, missing: str = MISSING) -> DataFrame:
    """(doc_id, id, content): each record's blocks with rows as maps of text; a repeated key keeps its last value."""
    entry = F.struct("col_no", "key", F.coalesce("value", F.lit(missing)).alias("value"))
    rows = cells.groupBy("doc_id", "record_id", "block_id", "block_type", "row_no").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    last = "filter(e, (x, i) -> NOT exists(slice(e, i + 2, size(e)), y -> y.key = x.key))"
    whole = f"CASE WHEN block_type = 'table' THEN array(map_from_entries(transform({last}, x -> struct(x.key, x.value)))) ELSE transform(e, x -> map(x.key, x.value)) END"
    rows = rows.withColumn("maps", F.expr(whole))
    in_order = "array_sort(collect_list(named_struct('row_no', row_no, 'json', to_json(maps))))"
    content = F.expr(f"flatten(transform({in_order}, x -> from_json(x.json, 'array<map<string,string>>')))")
    by_block = rows.groupBy("doc_id", "record_id", "block_id", "block_type").agg(content.alias("content"))
    block = F.struct("block_id", F.struct(F.col("block_type").alias("type"), "content").alias("b"))
    parts = by_block.groupBy("doc_id", F.col("record_id").alias("id")).agg(F.collect_list(block).alias("bs"))
    return parts.select("doc_id", "id", F.expr("transform(array_sort(bs, (x, y) -> x.block_id - y.block_id), x -> x.b)").alias("content"))

