"""The corpus pipeline: stages applied to ``documents`` one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from signalspark.llm.shared import landed
from signalspark.llm.stages import STAGES

#: Language proportions by expectation-maximisation and merge-by-merge encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each one returns is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
