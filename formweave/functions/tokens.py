"""Token counts of prompts and replies, which the costs of model calls are made of."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import SparkSession, functions as F

#: A public byte-level vocabulary as ranks; any file of that form may take its place.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    """Tokens and ranks of a file with one base64 token and its rank a line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, Path(path).read_bytes().splitlines())}


def token_counter(spark: SparkSession, path: str = DEFAULT_RANKS, pattern: str = PATTERN):
    """A function of a text column that gives its tokens; a null or empty text has none, special tokens are ordinary text.

    The driver reads the file and sends it once to each executor; a task builds one encoder.
    """
    shared = spark.sparkContext.broadcast(read_ranks(path))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for texts in batches:
            yield texts.map(lambda t: len(encoder.encode_ordinary(t)) if t else 0).astype("int64")

    return count
