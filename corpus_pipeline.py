"""A cleaning pipeline over ``documents``: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from edgeloom.llm import stages
from edgeloom.llm.storage import discard, stored, table

STAGES = [
    ("quality", stages.drop_low_quality),
    ("line_dedup", stages.drop_repeated_lines),
    ("near_dedup", stages.keep_one_of_each_group),
    ("decontamination", stages.drop_benchmark_copies),
    ("mixing", stages.mix_sources),
]
ORACLE_SQL = None  # a learned model, edit distances and alignments: tests hold every stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(last)
    return docs
