"""From raw documents to packed training windows: five stages, each over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir), docs with the columns of documents, and returns a DataFrame; all but the last
return those columns. run() writes each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from tessitura.llm.common import stored, without


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, scored.where("predicted = 1").select("doc_id"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has; n_chars follows the text. One that loses all its words goes."""
    words = F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    kept = line_dedup.dedup_lines(docs).where((F.col("__td_removed") == 0) | words)
    length = F.when(F.col("__td_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", length).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id."""
    return without(docs, ngram_join.near_duplicates(docs).where("component_id <> doc_id").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("contaminated").select("doc_id"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training windows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]

#: Models, near-duplicate groups and tokenizers are beyond SQL; tests/llm holds the stages against plain versions on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
