"""Product codes of vectors: integer codebooks learned in rounds, nearest entries found through an approximation file.

An entry's coordinates are kept as cells of a few bits.  For a vector, one table a
coordinate gives the least and the greatest squared distance to each cell; sums of
them bound the distance to every entry, and only entries whose lower bound does not pass
the least upper bound are measured in full, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import check_columns, hot_keys, meet

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a cell.
BITS = 3
#: Integer components stay below this, so that a squared distance fits 64 bits.
LIMIT = 1 << 24
#: Rows whose bounds are worked out at once.
BLOCK = 4096


@dataclass(frozen=True)
class Codebooks:
    """For each part an array (entries, width) of integers; their size is that of ``entries`` vectors."""

    parts: tuple[np.ndarray, ...]

    @property
    def width(self) -> int:
        return self.parts[0].shape[1]

    @property
    def size(self) -> int:
        return len(self.parts) * self.width

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place, in decimal, joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.parts for x in book.ravel().tolist()).encode()).hexdigest()


class CellFile:
    """The entries of one part as cells: ``marks`` bound the cells of a coordinate, ``cells`` holds each entry's."""

    def __init__(self, book: np.ndarray, bits: int = BITS):
        self.book = book
        n, width = book.shape
        count = min(1 << bits, n)
        ranked = np.sort(book, axis=0)
        cuts = (np.arange(1, count) * n) // count
        #: (count + 1, width): a cell holds the coordinates from its mark up to the next one.
        self.marks = np.concatenate([ranked[:1], ranked[cuts], ranked[-1:]])
        self.cells = np.stack([np.searchsorted(self.marks[1:-1, j], book[:, j], "right") for j in range(width)], 1)

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of every row to every entry, as the cells tell."""
        low = np.zeros((len(rows), len(self.book)), np.int64)
        high = np.zeros_like(low)
        for j in range(rows.shape[1]):
            x, start, stop = rows[:, j, None], self.marks[:-1, j], self.marks[1:, j]
            near = np.maximum(np.maximum(start - x, x - stop), 0)
            far = np.maximum(np.abs(x - start), np.abs(x - stop))
            low += (near * near)[:, self.cells[:, j]]
            high += (far * far)[:, self.cells[:, j]]
        return low, high

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every row, the lower one of equals, and the squared distance."""
        low, high = self.bounds(rows)
        row, entry = np.nonzero(low <= high.min(axis=1, keepdims=True))  # every row keeps one at least
        apart = rows[row] - self.book[entry]
        exact = np.einsum("ij,ij->i", apart, apart)
        starts = np.searchsorted(row, np.arange(len(rows)))
        least = np.minimum.reduceat(exact, starts) if len(rows) else exact
        hits = np.flatnonzero(exact == least[row])
        return entry[hits[np.searchsorted(row[hits], np.arange(len(rows)))]], least


def whole_numbers(column: pa.Array, size: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a list column are kept (neither null nor with null or non-finite components),
    which of these can be coded (``size`` components, all within LIMIT), and the integers of the latter."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    faults = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    kept = lists.is_valid().to_numpy(zero_copy_only=False) & (faults[offsets[1:]] == faults[offsets[:-1]])
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * scale)
        large = np.concatenate(([0], np.cumsum(~(np.abs(scaled) < LIMIT))))
    fit = kept & (sizes == size) & (large[offsets[1:]] == large[offsets[:-1]])
    takes = np.repeat(fit, sizes)
    return kept, fit, scaled[takes].astype(np.int64).reshape(-1, size) if size else np.zeros((int(fit.sum()), 0), np.int64)


def assign(rows: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances) of integer rows, a column for each part."""
    codes, errors = np.zeros((len(rows), len(books.parts)), np.int64), np.zeros((len(rows), len(books.parts)), np.int64)
    for p, book in enumerate(books.parts):
        file, own = CellFile(book), rows[:, p * books.width : (p + 1) * books.width]
        for a in range(0, len(rows), BLOCK):
            codes[a : a + BLOCK, p], errors[a : a + BLOCK, p] = file.nearest(own[a : a + BLOCK])
    return codes, errors


def _kept(vectors: DataFrame, vector_col: str):
    return F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def first_codebooks(vectors: DataFrame, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks | None:
    """The parts of the kept vectors with the least ids, ascending; None where no vector can be coded."""
    grid = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    fits = F.forall(vector_col, lambda x: F.abs(F.floor(x.cast("double") * scale)) < LIMIT) & (F.size(vector_col) > 0) & (F.size(vector_col) % parts == 0)
    able = vectors.where(_kept(vectors, vector_col)).where(fits).where(F.col(id_col).isNotNull())
    first = able.select(F.col(id_col).alias("id"), grid.alias("v")).orderBy("id", "v").limit(entries).collect()
    if not first:
        return None
    size = len(first[0]["v"])
    rows = np.array([r["v"] for r in first if len(r["v"]) == size], np.int64)
    return Codebooks(tuple(np.ascontiguousarray(part) for part in np.split(rows, parts, axis=1)))


def _sums(vectors: DataFrame, vector_col: str, books: Codebooks, scale: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """For each entry in use its vectors' count and componentwise sum: summed in the tasks, then by key, exact at any size."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        n, width = len(books.parts), books.width
        most = max(map(len, books.parts))
        totals, counts = np.zeros((n, most, width), np.int64), np.zeros((n, most), np.int64)
        for batch in batches:
            _, _, rows = whole_numbers(batch.column(0), books.size, scale)
            codes, _ = assign(rows, books)
            for p in range(n):
                np.add.at(totals[p], codes[:, p], rows[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(codes[:, p], minlength=most)
        part, entry = np.nonzero(counts)
        place = np.tile(np.arange(width), len(part))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(part, width), pa.int32()), pa.array(np.repeat(entry, width), pa.int32()), pa.array(place, pa.int32()), pa.array(np.repeat(counts[part, entry], width)), pa.array(totals[part, entry].ravel())],
            names=["part", "entry", "place", "n", "total"],
        )

    partial = vectors.select(vector_col).mapInArrow(run, "part int, entry int, place int, n long, total long")
    whole = partial.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found: dict[tuple[int, int], tuple[int, list[int]]] = {}
    for r in whole.collect():  # one row for each component of a codebook
        _, sums = found.setdefault((r["part"], r["entry"]), (r["n"], [0] * books.width))
        sums[r["place"]] = int(r["total"])
    return found


def train_codebooks(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codebooks | None:
    """Codebooks after ``rounds`` rounds over all vectors: each entry becomes the floored mean of the parts nearest to it.

    Each round reads the table once and sends one row for each component of a codebook to the
    driver; a round that loses an executor is counted again from the table, which must hold still.
    An entry that no part is nearest to stays.
    """
    books = first_codebooks(vectors, id_col, vector_col, parts, entries, scale)
    for _ in range(rounds if books else 0):
        fresh = [book.copy() for book in books.parts]
        for (p, e), (n, sums) in _sums(vectors, vector_col, books, scale).items():
            fresh[p][e] = [s // n for s in sums]
        if all(np.array_equal(a, b) for a, b in zip(fresh, books.parts, strict=True)):
            break  # the other rounds would change nothing
        books = Codebooks(tuple(fresh))
    return books


def encode_vectors(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector_col: str = "embedding", others: tuple[str, ...] = (), scale: int = SCALE) -> DataFrame:
    """(id_col, code, error, others) for every kept vector; code has two hexadecimal digits a part."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    plain = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), *(F.col(c).alias(f"other{k}") for k, c in enumerate(others)))
    carried = plain.columns[2:]
    digits = np.array([f"{i:02x}" for i in range(256)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            kept, fit, rows = whole_numbers(batch.column(1), books.size if books else 0, scale)
            code, error = np.full(len(kept), None, object), np.full(len(kept), None, object)
            if books:
                codes, errors = assign(rows, books)
                code[fit] = ["".join(line) for line in digits[codes].tolist()]
                error[fit] = errors.sum(axis=1).tolist()
            found = [batch.column(0), pa.array(code, pa.string()), pa.array(error, pa.int64()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(found, names=["id", "code", "error", *carried]).filter(pa.array(kept))

    kind = {f.name: f.dataType.simpleString() for f in plain.schema}
    schema = ", ".join([f"id {kind['id']}", "code string", "error long", *(f"{c} {kind[c]}" for c in carried)])
    found = plain.mapInArrow(run, schema)
    return found.select(F.col("id").alias(id_col), "code", "error", *(F.col(f"other{k}").alias(c) for k, c in enumerate(others)))


def decode_vectors(codes: DataFrame, books: Codebooks, code_col: str = "code", scale: int = SCALE) -> DataFrame:
    """codes with a column ``decoded``: the entries that a code names, on the vectors' own scale."""
    tables = [F.array(*(F.array(*(F.lit(float(x) / scale) for x in entry)) for entry in book.tolist())) for book in books.parts]
    index = [F.conv(F.substring(code_col, 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(tables))]
    return codes.withColumn("decoded", F.flatten(F.array(*(F.get(t, i) for t, i in zip(tables, index, strict=True)))))


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """(id_col, code, error, label_error, codebooks_sha256) for every kept vector.

    A vector that is null or holds null or non-finite components is dropped.  A vector that
    differs in length from the one with the least id, whose length the parts do not divide, or
    with an integer component of LIMIT or more is kept with a null code and a null error: it
    takes no part in the codebooks.  Rows with null ids are coded but found no entries; of
    repeated ids the lesser vector comes first.  Fewer vectors than entries give fewer
    entries; equal distances go to the lower entry.  Null labels are one label; a label
    without a coded vector has the sum 0.  An empty table gives no rows.

    Labels are summed in the tasks first; rows of a label with more than a 1024th of all are
    dealt over many tasks where they meet the sums.
    """
    check_columns(vectors, id_col, vector_col, label_col)
    if entries > 256:
        raise ValueError("a code has two digits a part: 256 entries at most")
    books = train_codebooks(vectors, id_col, vector_col, parts, entries, rounds, scale)
    coded = encode_vectors(vectors, books, id_col, vector_col, (label_col,), scale)
    rows = coded.select(F.col(id_col).alias("id"), "code", "error", F.col(label_col).alias("label"))
    rows = rows.withColumn("none", F.col("label").isNull()).withColumn("key", F.xxhash64("label"))
    sums = rows.groupBy("label", "none", "key").agg(F.coalesce(F.sum("error"), F.lit(0)).alias("label_error"), F.count("*").alias("rows"))
    total = vectors.count()
    plain = F.coalesce(F.col("label").cast("string"), F.lit(""))
    met = meet(rows.withColumn("s", plain).drop("label"), sums.withColumn("s", plain).drop("label"), ["s", "none", "key"], "id", hot_keys(sums, "key", "rows", total))
    return met.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.digest() if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same codes in DuckDB, by measuring every entry."""
    near = """
  SELECT vec_id, part, entry, far FROM (
    SELECT v.vec_id, v.part, b.entry, list_sum(list_transform(list_zip(v.x, b.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS far
    FROM v JOIN {books} b USING (part))
  QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1"""
    steps = []
    for k in range(rounds):
        steps.append(f"n{k} AS MATERIALIZED ({near.format(books=f'b{k}')})")
        steps.append(f"""m{k} AS MATERIALIZED (
  SELECT part, entry, list(mean ORDER BY place) AS x FROM (
    SELECT v.part, n.entry, place, floor(sum(v.x[place])::DOUBLE / count(*))::BIGINT AS mean
    FROM v JOIN n{k} n USING (vec_id, part), (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM v))) AS place) GROUP BY ALL) GROUP BY part, entry)""")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m USING (part, entry))")
    return f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor({scale} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS MATERIALIZED (SELECT vec_id, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS x FROM e, (SELECT unnest(range({parts})) AS part)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM e QUALIFY entry < {entries}),
b0 AS MATERIALIZED (SELECT part, entry, x FROM v JOIN s USING (vec_id)),
{", ".join(steps)},
f AS MATERIALIZED ({near.format(books=f'b{rounds}')}),
c AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM f GROUP BY vec_id),
d AS (SELECT sha256(string_agg(list_aggregate(x, 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN e USING (vec_id), d
"""
