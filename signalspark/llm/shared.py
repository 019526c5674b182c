"""The folder that all executors share, and tables written to it."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalspark.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the session's checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str, partitioned: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back; cuts its lineage.

    The files stay until the folder is cleared, as with any checkpoint folder.
    """
    path = shared_folder(df.sparkSession, name)
    writer = df.write.options(**(options or {}))
    (writer.partitionBy(*partitioned) if partitioned else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, size: str):
    """What runs meanwhile hands batches of at most so many bytes to Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row (all columns), key and text_hash: what lets rows pass through joins whatever their names."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    return docs.select(row.alias("row"), F.col(f"`{key}`").alias("key"), F.xxhash64(body).alias("text_hash"))


def same_row(left: str, right: str):
    """Whether two aliased frames have the same key and text hash; null keys are equal."""
    on = F.col(f"{left}.text_hash") == F.col(f"{right}.text_hash")
    return on & F.col(f"{left}.key").eqNullSafe(F.col(f"{right}.key"))
