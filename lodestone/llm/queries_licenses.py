"""op7: license notices in the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.licenses import scan, scan_sql


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_license_scan": op7_license_scan}
ORACLES = {"op7_license_scan": scan_sql()}
