"""Folders for the tables of one run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that ``spark.checkpoint.dir`` names, which all executors share.

    Where none is set, a local session takes a temporary one; a cluster has to set it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            shared = kept.get()
        elif spark.sparkContext.master.startswith("local["):
            shared = tempfile.mkdtemp(prefix="run-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
