"""Clicks of reviewers as a stream: the decision that stands for every span.

Clicks may come late, repeated and in any order.  The state of a span is an aggregate that does not
depend on the order of its rows (the click with the highest number, and whether one ever forced
a mask), so Spark keeps it by key in its state store and restores it after a restart.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kuronuri.operators.review import last_clicks

ACTION = "doc_id string, span_id string, seq bigint, op string"


def action_stream(spark: SparkSession, path: str, schema: str = ACTION,
                  max_files: int = 1000) -> DataFrame:
    """Clicks as files of a folder arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def write_clicks(actions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the state of clicked spans; every batch writes the spans that it changed.

    A batch that is run again replaces itself.  All that has arrived is worked off, then the query
    ends; started again with the same ``checkpoint`` it goes on.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        last_clicks(actions).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_clicks(spark: SparkSession, path: str, schema: str = "doc_id string, span_id string"
                ) -> DataFrame:
    """The state that stands: of each span what the last batch wrote; none before the first batch.

    ``schema`` has the types of the keys.
    """
    full = f"{schema}, last_seq bigint, last_op string, forced boolean"
    try:
        rows = spark.read.schema(f"{full}, batch bigint").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)
    state = F.struct("last_seq", "last_op", "forced")
    return rows.groupBy("doc_id", "span_id").agg(F.max_by(state, "batch").alias("s")).select(
        "doc_id", "span_id", "s.*")
