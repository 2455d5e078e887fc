"""Corpus pipeline: toxic documents go, poor ones go, one document of each near-duplicate class stays, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet in the shared folder and reads it again as the
next stage's documents. All but the last return the columns of ``docs``. Quality rules also take failing lines out of the documents they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafscan.llm import common, line_quality, lsh_forest, packing, toxicity
from leafscan.session import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.clean_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lsh_forest.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

# Toxicity and packing are a trained model and a tokenizer: no SQL. tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
