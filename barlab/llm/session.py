"""What the operators need of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlab.functions.storage import checkpointed, ensure_checkpoint_dir

__all__ = ["checkpointed", "documents", "ensure_checkpoint_dir"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
