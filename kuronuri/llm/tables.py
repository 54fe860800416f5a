"""Reading the given tables and writing intermediate tables where all executors see them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def docs_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null read as empty) and the named columns; all others are left out.

    Operators read their input through this, so extra columns can not clash with theirs.
    """
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isDefined():
            folder = context._jsc.sc().getCheckpointDir().get()
        elif context.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="checkpoint-")
            context.setCheckpointDir(folder)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


#: Rows in an Arrow batch while an intermediate table is made: rows may hold whole texts or sets.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Workers get batches of :data:`BATCH_ROWS` rows in jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kuronuri-{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
