"""Masking a stream of documents: the batch plan on a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kuronuri.operators.dictionary import DictMatcher
from kuronuri.operators.report import hits_table
from kuronuri.plans.masking import mask
from kuronuri.policy import Policy


def document_stream(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string",
                    max_files: int = 1000) -> DataFrame:
    """Documents of a table, kept as one file or as a folder of part files."""
    if path[-1:].isalnum():  # as a pattern, since a plain path has to be a folder
        path = f"{path[:-1]}[{path[-1]}]"
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    )


def read_masked(spark: SparkSession, path: str, schema: str = "doc_id bigint, masked string"
                ) -> DataFrame:
    """Masked texts that :func:`write_stream` has written; none before its first batch."""
    try:
        return spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/masked").drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def mask_stream(docs: DataFrame, policy: Policy | None = None,
                matchers: Sequence[DictMatcher] = ()) -> DataFrame:
    """Masked documents in append mode; labels are per document, so no state is kept."""
    return mask(docs, policy, matchers=matchers)


def write_stream(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write masked texts and hits of every batch; a batch that is run again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stored = f"{path}/result/batch={batch_id}"
        batch.write.mode("overwrite").parquet(stored)
        rows = batch.sparkSession.read.parquet(stored)
        rows.select("doc_id", "masked").write.mode("overwrite").parquet(
            f"{path}/masked/batch={batch_id}"
        )
        hits_table(rows).write.mode("overwrite").parquet(f"{path}/hits/batch={batch_id}")

    return (
        result.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
