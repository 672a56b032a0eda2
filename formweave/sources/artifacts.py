"""Readers and writers of the exchange files: phrases, lists, templates, metadata, extractions."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from formweave.functions.groups import group_starts
from formweave.functions.scans import prefix_sums
from formweave.plans.template import Template, from_json, to_json

#: Scripts, styles and comments, in a form that Java and RE2 read alike.
HIDDEN_HTML = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
PHRASE_CSV = "text string, x0 double, y0 double, x1 double, y1 double, page double"


def doc_name(path) -> F.Column:
    """File name without folder and last extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def merged_name(paths: list[str]) -> str:
    """Name of a run over several files: their stems in order of name."""
    return "_".join(PurePosixPath(p).stem for p in sorted(paths, key=lambda p: PurePosixPath(p).name))


def read_phrases(spark: SparkSession, path: str, in_place: bool = False) -> DataFrame:
    """phrases of CSV files with the header text,x0,y0,x1,y1,page; a file is a document, its line order the reading order.

    A file in a folder ``doc_id=<name>`` belongs to that document, as ``write_phrases`` leaves it.  With ``in_place`` the tasks that read the files
    number their lines as they come and none is moved, if no file is so large that Spark cuts it.
    """
    raw = spark.read.csv(path, header=True, schema=PHRASE_CSV, quote='"', escape='"')
    raw = raw.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("b"))
    if in_place and _uncut(spark, path):
        rows = raw.where(F.assert_true(F.col("b") == 0, F.lit("a file was cut")).isNull()).drop("b").mapInArrow(_numbered_lines, f"{PHRASE_CSV}, path string, k int")
    else:
        order = Window.partitionBy("path").orderBy("b", "o")
        rows = raw.withColumn("o", F.monotonically_increasing_id()).withColumn("k", F.row_number().over(order) - 1)
    folder = F.nullif(F.regexp_extract("path", r"/doc_id=([^/]+)/[^/]*$", 1), F.lit(""))
    for _ in range(2):  # the folder's own escapes, and those of a file's address
        folder = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    return rows.select(F.coalesce(folder, doc_name(F.col("path"))).alias("doc_id"), F.col("k").alias("phrase_idx"), F.col("page").cast("int").alias("page"), F.trim("text").alias("text"), "x0", "y0", "x1", "y1")


def _uncut(spark: SparkSession, path: str) -> bool:
    """Whether all files are small enough that each is read by one task; only their lengths are looked up."""
    conf = spark._jsparkSession.sessionState().conf()
    longest = spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]
    return longest is None or longest <= min(conf.filesMaxPartitionBytes(), conf.filesOpenCostInBytes())


def _numbered_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with k, their places in their files, which lie one after the other."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = group_starts(batch, ["path"])
        k = np.arange(batch.num_rows) - np.repeat(starts, np.diff([*starts, batch.num_rows]))
        if batch["path"][0].as_py() == last:
            k[: starts[1] if len(starts) > 1 else None] += n
        last, n = batch["path"][-1].as_py(), int(k[-1]) + 1
        yield batch.append_column("k", pa.array(k, pa.int32()))


def write_phrases(phrases: DataFrame, path: str, dealt: bool = False) -> None:
    """One CSV folder per document, in reading order; phrases that are ``dealt`` by document already are not moved."""
    ordered = (phrases if dealt else phrases.repartition("doc_id")).sortWithinPartitions("doc_id", "phrase_idx")
    ordered.select("doc_id", "text", "x0", "y0", "x1", "y1", "page").write.partitionBy("doc_id").csv(path, header=True, quote='"', escape='"')


def merge_documents(phrases: DataFrame, name: str = "merged") -> DataFrame:
    """All documents as one, in order of doc_id: pages and phrases go on from document to document.

    For the files of one run, or the sample of a learner; extraction needs no merging.
    What lies ahead of a document are running sums over one row for each document, which no
    single task sees all of; the phrases look them up.  Operators that work by document take the
    result as a single one.
    """
    sizes = phrases.groupBy("doc_id").agg(F.max("page").alias("pages"), (F.max("phrase_idx") + 1).alias("n"))
    sizes = prefix_sums(sizes, ["doc_id"], {"p": "pages", "k": "n"}).select("doc_id", "p", "k")
    joined = phrases.join(sizes, "doc_id")
    return joined.select(F.lit(name).alias("doc_id"), (F.col("phrase_idx") + F.col("k")).cast("int").alias("phrase_idx"), (F.col("page") + F.col("p")).cast("int").alias("page"), "text", "x0", "y0", "x1", "y1")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text): trimmed lines of a text file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("text"))


def ground_phrases(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines that are not empty."""
    return read_lines(spark, path).where("text <> ''").select("text").distinct()


def write_lines(frame: DataFrame, path: str, column: str = "text", order: str | None = None) -> None:
    """One text a line; with an order column in its order, over the files in order of their names."""
    if order:
        frame = frame.orderBy(order)
    frame.select(F.col(column).cast("string").alias("value")).write.text(path)


def read_metadata(spark: SparkSession, path: str) -> list[str]:
    """Header and footer strings, separated by ``|``; lines join with a space, code fences go."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    text = " ".join(part.strip() for whole in lines for part in whole.splitlines() if not part.strip().startswith("```"))
    return [p.strip() for p in text.split("|") if p.strip()]


def read_metadata_rows(spark: SparkSession, path: str) -> list[list[str]]:
    """The registered metadata rows of a run."""
    return [list(r["texts"]) for r in spark.read.schema("place long, texts array<string>").json(path).orderBy("place").collect()]


def write_metadata_rows(spark: SparkSession, rows: list[list[str]], path: str) -> None:
    spark.createDataFrame(list(enumerate(rows)), "place long, texts array<string>").coalesce(1).write.json(path)


def write_string(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def write_records(frame: DataFrame, path: str) -> None:
    """One JSON object a line, fields in the order of the columns."""
    frame.write.json(path)


#: Names of what a run keeps of a document (or of several as one), by kind.
ARTIFACTS = {
    "phrases": "_phrases.csv", "fields": "_fields.txt", "boxes": "_boxes.json", "template": "_template.json", "metadata": "_metadata.txt", "metadata_rows": "_metadata_rows.json",
    "extracted": "_extracted.json", "image": "_page.jpg", "ground": "_ground_phrases.txt",
}


def artifact_path(folder: str, paths: list[str], kind: str) -> str:
    """Where a run over files keeps an artifact."""
    name = merged_name(paths)
    return f"{folder.rstrip('/')}/{name}/{name}{ARTIFACTS[kind]}"


def delete_artifact(spark: SparkSession, path: str) -> bool:
    """Whether there was something to delete, in any file system that Spark can write."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def phrases_json(phrases: DataFrame) -> DataFrame:
    """(doc_id, phrase_idx, json): each phrase as an object of its text and its box."""
    box = F.struct("x0", "y0", "x1", "y1", "page")
    return phrases.select("doc_id", "phrase_idx", F.to_json(F.struct("text", box.alias("bbox"))).alias("json"))


_BOXED = "text string, x0 double, y0 double, x1 double, y1 double, page double, bbox struct<x0:double,y0:double,x1:double,y1:double,page:double>"


def parse_boxes(payloads: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, phrase_idx, page, text, box) of payloads that are an array of JSON objects, one object, or CSV lines with quotes.

    Objects hold a box beside the text or under ``bbox``.  CSV may start with the line of
    names.  A number that is absent or no number is 0, a page 1; lines without a text go.
    """
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    named = F.struct(F.col("o.text").alias("text"), *[F.coalesce(F.col(f"o.{c}"), F.col(f"o.bbox.{c}")).alias(c) for c in ("x0", "y0", "x1", "y1", "page")])
    kind = F.when(text.startswith("["), "array").when(text.startswith("{"), "object").otherwise("csv")
    rows = payloads.select(F.col(id_col).alias("id"), text.alias("text"), kind.alias("kind"))
    arrays = rows.where("kind = 'array'").select("id", F.posexplode(F.from_json("text", f"array<struct<{_json_types(_BOXED)}>>")).alias("k", "o"))
    objects = rows.where("kind = 'object'").select("id", F.lit(0).alias("k"), F.from_json("text", _BOXED).alias("o"))
    lines = rows.where("kind = 'csv'").select("id", F.posexplode(F.split("text", r"\r?\n")).alias("k", "line")).where("trim(line) <> '' AND NOT line LIKE 'text,%'")
    csv = lines.select("id", "k", F.from_csv("line", PHRASE_CSV, {"quote": '"', "escape": '"'}).alias("o"))
    flat = arrays.select("id", "k", named.alias("b")).union(objects.select("id", "k", named.alias("b"))).union(csv.select("id", "k", "o"))
    order = Window.partitionBy("id").orderBy("k")
    flat = flat.where("trim(b.text) <> ''")
    sides = [F.coalesce(F.col(f"b.{c}"), F.lit(0.0)).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return flat.select(F.col("id").alias(id_col), (F.row_number().over(order) - 1).alias("phrase_idx"), F.coalesce(F.col("b.page"), F.lit(1)).cast("int").alias("page"), F.trim("b.text").alias("text"), *sides)


def _json_types(ddl: str) -> str:
    """A list of columns as the fields of a struct type."""
    return ", ".join(part.replace(" ", ":", 1) for part in ddl.split(", ") if part)


def read_words(spark: SparkSession, path: str, in_place: bool = False) -> DataFrame:
    """words of CSV files with the header text,x0,y0,x1,y1,page, a file or folder of files: what a PDF reader wrote."""
    return read_phrases(spark, path, in_place).withColumnRenamed("phrase_idx", "word_idx")


def write_template(spark: SparkSession, template: Template, path: str) -> None:
    spark.createDataFrame([(to_json(template),)], "value string").coalesce(1).write.text(path)


def read_template(spark: SparkSession, path: str) -> Template:
    return from_json(" ".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def write_nested(nested: DataFrame, path: str, compression: str = "none") -> None:
    """One JSON line per record, in folders by document; Spark reads files of any ``compression`` that it can write."""
    nested.write.partitionBy("doc_id").json(path, compression=compression)


def ocr_lines(blocks: DataFrame, width: float, height: float) -> DataFrame:
    """Phrases from cloud-OCR blocks (doc_id, page, block_type, text, left, top, w, h in shares of the page): lines only."""
    order = Window.partitionBy("doc_id").orderBy("page", "top", "left")
    x0, y0 = F.col("left") * width, F.col("top") * height
    return blocks.where("block_type = 'LINE'").select(
        "doc_id", (F.row_number().over(order) - 1).alias("phrase_idx"), "page", "text", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("w") * width).alias("x1"), (y0 + F.col("h") * height).alias("y1")
    )


def read_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, modificationTime, length, content) of a folder and its subfolders, by name."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def html_words(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """words (doc_id, word_idx, page, text): the texts between a page's tags, in order."""
    bare = F.regexp_replace(F.coalesce(html_col, F.lit("")), HIDDEN_HTML, " ")
    parts = F.filter(F.transform(F.split(bare, r"<[^>]*>"), lambda t: F.trim(t)), lambda t: t != "")
    return pages.select(F.col(id_col).cast("string").alias("doc_id"), F.posexplode(parts).alias("word_idx", "text")).select("doc_id", "word_idx", F.lit(1).alias("page"), "text")
