"""A training corpus from ``documents``: five stages, each of which works on all that the one before kept.

toxicity drops documents, near-dedup keeps one of each group, suffix-dedup cuts repeated passages out of texts,
decontamination drops documents that hold benchmark items, and packing lays what is left into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifstream.llm.common import documents, materialize
from motifstream.llm.contamination import drop_leaks
from motifstream.llm.neardup import drop_near_duplicates
from motifstream.llm.packing import pack
from motifstream.llm.suffixes import cut_repeats
from motifstream.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near-dedup", near_dedup), ("suffix-dedup", suffix_dedup), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None  # the tokenizer and the learned lexicon are not SQL; tests hold each stage against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
