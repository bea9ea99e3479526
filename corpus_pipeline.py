"""The corpus pipeline: documents in, filtered, de-duplicated, decontaminated and encoded out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import stages
from tidemark.runtime import shared_folder

STAGES = [
    ("quality_rules", stages.quality),
    ("line_dedup", stages.lines),
    ("near_duplicates", stages.near_duplicates),
    ("decontamination", stages.decontaminate),
    ("byte_bpe", stages.tokens),
]

# Near duplicates by covering masks, edit distances and BPE merges are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one's rows are stored and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
