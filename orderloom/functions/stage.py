"""Tables that a job writes to the shared folder and reads back, so that what follows starts from files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A folder that executors share: the session's spark.checkpoint.dir; in local mode a temporary one where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or f"file://{tempfile.mkdtemp(prefix='spark-shared-')}").rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: several readers share one computation, and a lost executor costs a re-read."""
    path = f"{folder(df.sparkSession)}/orderloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
