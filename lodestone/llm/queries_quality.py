"""op6: quality rules over the documents table, with cutoffs learnt from the labels table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.quality import judge
from lodestone.plans.runtime import Scratch, finished, ship


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    scratch = Scratch(spark)
    return finished(judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), scratch.save), scratch)


QUERIES = {"op6_quality_rules": op6_quality_rules}
