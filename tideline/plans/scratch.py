"""Scratch tables: cut a long lineage, so that work after a lost executor starts from a table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def home(spark: SparkSession) -> str:
    """The shared folder from spark.checkpoint.dir; only a local master may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.gettempdir() + "/checkpoints"
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df under spark.checkpoint.dir, a folder that all executors share, and read it again."""
    spark = df.sparkSession
    path = f"{home(spark)}/scratch-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
