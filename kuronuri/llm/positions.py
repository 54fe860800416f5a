"""Positions of rows in an order, for tables and groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kuronuri.llm.tables import stored

#: Spark puts the number of the partition above these bits of a row's id.
_ROW_BITS = 33


def in_order(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``, the position of every row from 0 in the given order, and write the table.

    Rows are dealt by ranges and sorted inside them, so no task gets more than a range; rows equal
    in the order are told apart by where they were read, so many of them are split too.  Positions
    are those inside a range plus the sizes of the ranges before it, a table of one row a range.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    sorted_ = (
        tied.repartitionByRange(*order, F.col("__tie")).sortWithinPartitions(*order, F.col("__tie"))
        .withColumn("__id", F.monotonically_increasing_id()).drop("__tie")
    )
    kept = stored(sorted_, "order").withColumn("__part", F.shiftright("__id", _ROW_BITS))
    sizes = stored(kept.groupBy("__part").agg(F.count("*").alias("__n")), "order-sizes")
    # One row a range: bounded by the number of partitions, not by the rows.
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.col("__id").bitwiseAND((1 << _ROW_BITS) - 1)
    return kept.join(F.broadcast(starts), "__part").select(
        *rows.columns, (F.col("__start") + inside).alias(name))
