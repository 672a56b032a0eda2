"""Helpers that the corpus operators share: lineage cuts and set arithmetic on plans."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words of every contract: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as ``btrim`` takes it.
SPACES = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only where none is set, as in local tests."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="formweave-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark can write."""
    gateway = spark.sparkContext._jvm
    target = gateway.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut(frame: DataFrame) -> DataFrame:
    """Materialise a frame once in the shared folder, so that losing an executor never recomputes it."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text) -> object:
    """Array of the words of a text column; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


#: A key is hot if it has more than this share of all rows.
SHARE = 1024
#: Rows of a hot key's part at least, so that what they meet is copied for so many rows once.
LEAST_PART = 256


def row_place() -> Column:
    """A number for each row of one read; another read may number the rows otherwise (see ``placed``)."""
    return F.monotonically_increasing_id()


#: Files of a table at most whose numbers are sent to all tasks.
FILES = 10_000


def fresh(frame: DataFrame, name: str) -> str:
    """The name, longer where a column has it already."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column of places, and its name: every read gives a row the same place, however the cluster deals the files.

    A row of a Parquet table is known by its file, numbered by name, and its index in the file.
    Any other frame, and a table of more than FILES files, is written once in the shared folder with the places.
    """
    name, path, index = (fresh(docs, c) for c in ("_row", "_row_path", "_row_index"))
    files: list[str] = []
    try:
        origin = docs.metadataColumn("_metadata")
        rows = docs.select("*", origin["file_path"].alias(path), origin["row_index"].alias(index))
        files = sorted(r[0] for r in rows.select(path).distinct().limit(FILES + 1).collect())
    except AnalysisException:  # not the rows of a Parquet table
        pass
    if not 0 < len(files) <= FILES:
        return cut(docs.withColumn(name, row_place())), name
    numbers = docs.sparkSession.createDataFrame(list(zip(files, range(len(files)), strict=True)), f"{path} string, {name} long")
    rows = rows.join(F.broadcast(numbers), path, "left")
    number = F.coalesce(name, F.raise_error(F.concat(F.lit("a file came after the others were listed: "), path)))
    return rows.withColumn(name, F.shiftleft(number, 40) + F.col(index)).drop(path, index), name


def without_rows(rows: DataFrame, place: str, gone: DataFrame) -> DataFrame:
    """rows, a table with places, without those whose places are in the column ``row`` of gone; the places go too."""
    return rows.join(gone.select(F.col("row").alias(place)), place, "left_anti").drop(place)


def hot_keys(lists: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """(key, parts) of the values of a column of numbers that have more than a SHARE-th of ``total`` rows: fewer than SHARE, and about as many parts in all."""
    hot = lists.groupBy(key).agg(F.sum(size).alias("_rows")).where(F.col("_rows") * SHARE > total)
    parts = F.least(F.ceil(F.col("_rows") * SHARE / max(total, 1)), F.ceil(F.col("_rows") / LEAST_PART))
    return hot.select(key, parts.cast("int").alias("parts")).where("parts > 1")


def meet(rows: DataFrame, lists: DataFrame, key: list[str], spread_by: str, hot: DataFrame) -> DataFrame:
    """rows joined with lists, which has one row for a key (or a few); rows with a hot value are dealt over its parts.

    Only the hot values, of which there are fewer than SHARE, are broadcast.
    """
    at = hot.columns[0]
    hot = F.broadcast(hot)
    rows = rows.join(hot, at, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("parts")), F.lit(0))).drop("parts")
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)).cast("long") - 1)
    lists = lists.join(hot, at, "left").withColumn("_part", F.explode(parts)).drop("parts")
    return rows.join(lists, [*key, "_part"]).drop("_part")


def check_columns(frame: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; found {frame.columns}")
