"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir). Its result is written as
Parquet and reread as the next stage's docs, so that a lost executor costs a
stage's tasks and not the run, and so that no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessaria.llm import pipeline_stages as stages
from tessaria.llm.common import drop, keep, table

STAGES = [
    ("language_id", stages.identify_language),
    ("exact_dedup", stages.drop_exact_copies),
    ("near_dedup", stages.drop_near_copies),
    ("decontamination", stages.drop_contaminated),
    ("packing", stages.pack_sequences),
]

#: SQL has no form of the classifier or the sampling; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the whole table of documents."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop(spark, before)
        before = path
    return docs
