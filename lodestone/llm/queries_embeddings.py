"""op5: near-duplicates of the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.embeddings import near_vectors
from lodestone.plans.runtime import Scratch, finished, ship


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scratch = Scratch(spark)
    return finished(near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scratch), scratch)


QUERIES = {"op5_embedding_near_dedup": op5_embedding_near_dedup}
