"""op4: the language of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.langid import identify
from lodestone.plans.runtime import ship


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_language_id": op4_language_id}
