"""The phrase files of a run as a data source: a part for each file or, of many, for several, filters on documents and pages pushed down.

    spark.dataSource.register(PhraseFolder)
    spark.read.format("phrase_folder").load(path).where("doc_id = 'a' AND page <= 5")

Files lie as ``artifacts.write_phrases`` leaves them: a folder ``doc_id=<name>`` for each document.  Any
file system that Arrow opens by its address will do, if the driver and all executors reach it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from formweave.operators.rows import PHRASES

_PAGES = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
_SCHEMA = pa.schema([("doc_id", pa.string()), ("phrase_idx", pa.int32()), ("page", pa.int32()), ("text", pa.string()), *((c, pa.float64()) for c in ("x0", "y0", "x1", "y1"))])
#: Spark passes filters to a reader only with this set.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


#: Parts at most: a task for each of very many small files costs more than reading them.
PARTS = 1024


@dataclass
class Files(InputPartition):
    """(doc_id, path) of files that one task reads."""

    files: list[tuple[str, str]]


class PhraseFolder(DataSource):
    """phrases of a folder; ``phrase_idx`` is a line's place in its document's files, in order of their names."""

    @classmethod
    def name(cls) -> str:
        return "phrase_folder"

    def schema(self) -> str:
        return PHRASES

    def reader(self, schema: StructType) -> DataSourceReader:
        return PhraseReader(self.options["path"])


class PhraseReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.documents: set[str] | None = None
        self.pages: list[tuple[type, int]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of a page with a number, and a document's name or names; leaves the others to Spark."""
        for one in filters:
            column = getattr(one, "attribute", None)
            if column == ("doc_id",) and isinstance(one, EqualTo | In):
                wanted = set(one.value) if isinstance(one, In) else {one.value}
                self.documents = wanted if self.documents is None else self.documents & wanted
            elif column == ("page",) and type(one) in _PAGES:
                self.pages.append((type(one), one.value))
            elif not (isinstance(one, IsNotNull) and column in (("doc_id",), ("phrase_idx",), ("text",))):  # these are never null
                yield one

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.path)
        found: dict[str, list[str]] = {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            folder, _, name = info.path.rpartition("/")
            document = folder.rpartition("/")[2]
            if info.type == fs.FileType.File and name.endswith(".csv") and document.startswith("doc_id="):
                found.setdefault(unquote(document.removeprefix("doc_id=")), []).append(info.path)
        many = [d for d, paths in found.items() if len(paths) > 1]
        if many:
            raise ValueError(f"documents lie in several files: {sorted(many)[:5]}")
        files = [(d, paths[0]) for d, paths in sorted(found.items()) if self.documents is None or d in self.documents]
        each = max(1, -(-len(files) // PARTS))
        return [Files(files[k : k + each]) for k in range(0, len(files), each)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for doc_id, path in partition.files:
            yield from self._lines(store, doc_id, path)

    def _lines(self, store: fs.FileSystem, doc_id: str, path: str) -> Iterator[pa.RecordBatch]:
        kinds = {"text": pa.string()} | {c: pa.float64() for c in ("x0", "y0", "x1", "y1", "page")}
        options = csv.ConvertOptions(column_types=kinds, strings_can_be_null=False)
        place = 0
        with store.open_input_stream(path) as stream:
            for batch in csv.open_csv(stream, parse_options=csv.ParseOptions(newlines_in_values=True), convert_options=options):
                n = batch.num_rows
                columns = {c: batch.column(c) for c in ("text", "x0", "y0", "x1", "y1")}
                columns |= {"doc_id": pa.array([doc_id] * n, pa.string()), "phrase_idx": pa.array(range(place, place + n), pa.int32()), "page": batch.column("page").cast(pa.int32())}
                rows = pa.RecordBatch.from_arrays([columns[f.name] for f in _SCHEMA], schema=_SCHEMA)
                place += n
                for kind, value in self.pages:
                    rows = rows.filter(_PAGES[kind](rows.column("page"), value))
                yield rows
