"""A corpus pipeline: quality rules, near-duplicates, repeated passages, personal data, packing.

Every stage reads what its predecessor wrote and returns a DataFrame; all but the last keep the columns of
documents. A stage writes what it needs for itself to the Scratch that it is given, and the caller releases that once
the stage's result is written. A stage that is given none keeps its tables until the next stage is called with a
table that doesn't read them.

Stages take documents as the operators do: null texts and ids, empty texts, ties and repeated rows each have the result
that the operator's docstring states; columns of any names are carried; no documents give no rows.
"""

from __future__ import annotations

import threading

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import minhash, packing, pii, quality, substrings
from lodestone.llm.queries_pii import KEY
from lodestone.plans.runtime import Scratch, finished, ship

_left: dict[tuple, Scratch] = {}


def _scratch(spark: SparkSession, docs: DataFrame, sf_dir: str, given: Scratch | None) -> Scratch:
    ship(spark)
    if given is not None:
        return given
    run = (spark.sparkContext.applicationId, threading.get_ident(), sf_dir)
    last = _left.get(run)
    if last is not None and not any(last.root.rstrip("/").split(":")[-1] in f for f in docs.inputFiles()):
        last.release()
    _left[run] = Scratch(spark)
    return _left[run]


OWN = ("doc_id", "text", "lang", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """Other columns under neutral names, which clash with no operator's."""
    return docs.toDF(*[c if c in OWN else f"c{i}" for i, c in enumerate(docs.columns)])


def _with_text(done: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs`, n_chars (if there) counted anew."""
    plain = _plain(docs)
    return done.select(*[F.length("text").cast(plain.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in plain.columns]).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that the rules reject go; cutoffs come from the table labels."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), _scratch(spark, docs, sf_dir, scratch).save)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group stays (five-word shingles, similarity 0.8)."""
    return minhash.keep_one(docs, _scratch(spark, docs, sf_dir, scratch), width=5, percent=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Words within passages of 35 words or more that repeat go; texts without them stay as they are."""
    done = substrings.remove_repeats(_plain(docs), _scratch(spark, docs, sf_dir, scratch))
    return _with_text(done.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))), docs)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None, key: str = KEY) -> DataFrame:
    """Personal data gives way to pseudonyms under a key; nothing is written."""
    _scratch(spark, docs, sf_dir, scratch)
    return _with_text(pii.pseudonymise(_plain(docs), key), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Sequences of at most 4096 tokens: a row per piece with its place."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), _scratch(spark, docs, sf_dir, scratch))


STAGES = [
    ("quality rules", quality_rules),
    ("minhash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("pii pseudonyms", pii_pseudonyms),
    ("best-fit packing", best_fit_packing),
]

#: Signatures, exact binomial tests and tokenizers are beyond SQL; tests hold run() against a plain-Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, key: str = KEY) -> DataFrame:
    """All stages over the table documents, each written as Parquet and read again for the next; `key` is the secret of
    the pseudonyms. What a stage read goes when its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        work, kept = Scratch(spark), Scratch(spark)
        docs = finished(stage(spark, docs, sf_dir, work, **({"key": key} if stage is pii_pseudonyms else {})), work, kept)
        if before is not None:
            before.release()
        before = kept
    return docs
