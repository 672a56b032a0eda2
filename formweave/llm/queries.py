"""Queries over the corpus tables, one for each operator, and the SQL that tells their rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import conversations, html_text, licenses, mixing, near_dedup, quality_rules, url_filter, vector_codes
from .bpe import encode_texts
from .common import documents
from .decontaminate import contaminated
from .html_text import extract_html
from .licenses import license_scan
from .near_dedup import near_duplicates
from .pii import personal_data
from .site_quality import site_quality
from .tokens import count_tokens


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(documents(spark, sf_dir))
    return found.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversations.damaged_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return conversations.conversation_report(conversations.repaired_conversations(damaged, times_col="times"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_bpe_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_texts(documents(spark, sf_dir))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_near_duplicates, op2_mix_sources, op3_quality_rules, op4_html_text, op5_url_filter,
        op6_quality_classifier, op7_personal_data, op8_license_scan, op9_token_counts, op10_decontaminate,
        op11_conversation_repair, op12_vector_codes, op13_bpe_codes,
    )
}

#: The other operators train, draw on a tokenizer or align; tests hold them against plain Python.
ORACLES: dict[str, str] = {
    "op1_near_duplicates": near_dedup.ORACLE,
    "op2_mix_sources": mixing.ORACLE,
    "op3_quality_rules": quality_rules.ORACLE,
    "op4_html_text": html_text.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op8_license_scan": licenses.oracle(),
    "op11_conversation_repair": conversations.ORACLE,
    "op12_vector_codes": vector_codes.oracle(),
}
