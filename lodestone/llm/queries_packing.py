"""op3: packing of the documents table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.packing import pack
from lodestone.plans.runtime import Scratch, finished, ship


def op3_best_fit_packing(spark: SparkSession, sf_dir: str, path: str = public_tokenizers.path("word_bpe_49k.json")) -> DataFrame:
    ship(spark)
    scratch = Scratch(spark)
    return finished(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, scratch), scratch)


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
