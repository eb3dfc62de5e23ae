"""op10: pseudonyms for the personal data of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.pii import count_kinds, pseudonymise

#: For reproducible queries; a real run passes a secret of its own.
KEY = "lodestone-demo-key"


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str, key: str = KEY) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = pseudonymise(docs, key)
    return done.select("doc_id", "text", F.size("found").cast("long").alias("n_private"), *count_kinds(F.col("found")))


QUERIES = {"op10_pii_pseudonyms": op10_pii_pseudonyms}
