"""op2: near-duplicates of the documents table, on two-word shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.minhash import near_duplicates
from lodestone.plans.runtime import Scratch, finished, ship


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scratch = Scratch(spark)
    return finished(near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch, width=2, percent=80), scratch)


QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}
