"""Groups of sorted rows folded in Python, many to a batch, or worked on as columns of whole groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows that are given on at a time, about.
ROWS = 10_000


def group_starts(rows: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Places where the groups of sorted rows start, of one row at least."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    for key in keys:
        column = rows.column(key)
        new[1:] |= np.asarray(pc.not_equal(column[1:], column[:-1]))
    return np.flatnonzero(new)


def map_groups(frame: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, dealt: bool = False) -> DataFrame:
    """What ``work`` makes of sorted tables of whole groups and the places where these start; no value becomes a Python object on the way.

    Dealt and sorted as by ``fold_groups``; a task holds one group at a time, beside a batch.
    """
    found: StructType = _parse_datatype_string(schema)
    target = to_arrow_schema(found)
    rows = (frame if dealt else frame.repartition(keys[0])).sortWithinPartitions(*keys, *order)

    def done(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(pieces).combine_chunks()
        if whole.num_rows:
            yield from work(whole, group_starts(whole, keys)).select(target.names).cast(target).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = int(group_starts(batch, keys)[-1])
            if not last and held and all(held[-1].column(k)[-1].as_py() == batch.column(k)[0].as_py() for k in keys):
                held.append(batch)
                continue
            yield from done([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield from done(held)

    return rows.mapInArrow(run, found)


def fold_groups(frame: DataFrame, keys: list[str], order: list[str], fold: Callable[[dict[str, list]], dict[str, list]], schema: str, dealt: bool = False) -> DataFrame:
    """What ``fold`` makes of the columns of each group of keys, as lists in order: columns of the schema, of any length.

    Rows are dealt by the first key, unless they are ``dealt`` so already, and sorted; a task walks over
    its groups and holds one of them at a time, beside a batch.  Keys are not null.
    """
    found: StructType = _parse_datatype_string(schema)
    target = to_arrow_schema(found)
    rows = (frame if dealt else frame.repartition(keys[0])).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {c: [] for c in target.names}
        held: dict[str, list] = {}

        def close() -> None:
            for c, values in fold(held).items():
                out[c].extend(values)

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(k).to_pylist() for k, c in enumerate(batch.schema.names)}
            marks = [*group_starts(batch, keys).tolist(), batch.num_rows]
            for a, z in zip(marks, marks[1:]):
                part = {c: v[a:z] for c, v in columns.items()}
                if held and a == 0 and all(held[k][0] == part[k][0] for k in keys):
                    for c, v in part.items():
                        held[c].extend(v)
                    continue
                if held:
                    close()
                held = part
                if len(out[target.names[0]]) >= ROWS:
                    yield pa.RecordBatch.from_pydict(out, target)
                    out = {c: [] for c in target.names}
        if held:
            close()
        yield pa.RecordBatch.from_pydict(out, target)

    return rows.mapInArrow(run, found)
