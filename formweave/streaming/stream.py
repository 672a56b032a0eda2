"""Extraction from a stream of phrase files: the template is fixed, so each batch of whole documents stands alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from formweave.operators.extract import extract_cells
from formweave.operators.rows import PHRASES
from formweave.plans.template import Template


def read_phrase_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Phrases from Parquet files as they arrive; a document lies in one file."""
    return spark.readStream.schema(PHRASES).option("maxFilesPerTrigger", files).parquet(path)


def extract_stream(phrases: DataFrame, template: Template, out: str, checkpoint: str, metadata: list[str] = (), metadata_rows: list[list[str]] = ()) -> StreamingQuery:
    """Write the cells of every batch to Parquet, one folder per batch: a batch that runs again replaces its folder."""

    def batch(rows: DataFrame, number: int) -> None:
        extract_cells(rows, template, metadata, metadata_rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return phrases.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
