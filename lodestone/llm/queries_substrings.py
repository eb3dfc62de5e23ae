"""op1: removal of repeated passages from the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.substrings import remove_repeats
from lodestone.plans.runtime import Scratch, finished, ship


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scratch = Scratch(spark)
    return finished(remove_repeats(docs, scratch).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")), scratch)


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
