"""op8 and op9: token counts, and byte-level encoding and decoding, over the documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.tokenizing import count_tokens, round_trip
from lodestone.plans.runtime import ship


def op8_token_counts(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_50k.json")) -> DataFrame:
    ship(spark)
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)


def op9_byte_bpe(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) -> DataFrame:
    ship(spark)
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.PATTERN)


QUERIES = {"op8_token_counts": op8_token_counts, "op9_byte_bpe": op9_byte_bpe}
