"""A corpus pipeline: language, near copies, repeated passages, benchmark leaks, mixture.

Each stage works on all that the one before kept and hands on the columns of `documents`; the last adds domain, n_tokens and
copies. `run` writes every stage as Parquet in the cluster's shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.llm import jaccard, language, leaks, mixing, repeats
from fringeframe.llm.queries import MIXTURE, mixture_domain, mixture_weights
from fringeframe.operators.settle import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that no language model accepts: without a letter, or gibberish to every language learnt."""
    return language.identify(docs.select(*COLUMNS), keep=COLUMNS).filter(~F.col("rejected")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of linked documents; of rows that repeat its doc_id, one; of null ids, all."""
    own = docs.select(*COLUMNS)
    return jaccard.keep_representatives(own)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated 13-word windows out of the texts; a document of nothing else goes. Other texts stay as they are."""
    found = repeats.find_repeats(docs.select(*COLUMNS)).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return found.withColumn("text", text).withColumn(
        "n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("bigint"))
    ).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a test item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks.screen(docs.select(*COLUMNS), benchmark).filter(F.size("leaks") == 0).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, by target weights of domain, language and source."""
    return mixing.mix(docs.select(*COLUMNS), mixture_domain(), mixture_weights(), **MIXTURE)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_leaks),
    ("source_mixture", mix_sources),
]

# Language models and fingerprints have no SQL; tests/llm/test_table_operators.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
