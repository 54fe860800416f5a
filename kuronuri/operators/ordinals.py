"""Running totals and interval joins inside groups of any size.

A plain window puts a whole group into one task.  Here the order column is cut
into buckets of fixed width: rows are totalled inside (group, bucket), the short
table of bucket totals is totalled over the group, and both parts are combined.
No task holds more of one group than a bucket, and the table of totals is
shorter by the bucket width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WIDTH = 1 << 14


def running(df: DataFrame, group: Sequence[str], order: str, value: Column, name: str,
            how: str = "sum", width: int = WIDTH, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: sum or max of ``value`` over the rows of the group before this one.

    ``order`` is a whole number; rows that share it are ordered by ``ties``.  A
    sum over no rows is 0, a max over no rows is null.  Group columns must not be
    null.  ``df`` is read twice.
    """
    fn = {"sum": F.sum, "max": F.max}[how]
    group, cols = list(group), df.columns
    rows = df.withColumns({"__b": F.floor(F.col(order) / width), "__v": value})
    inner = (
        W.partitionBy(*group, "__b").orderBy(order, *ties)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    outer = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*group, "__b").agg(fn("__v").alias("__t"))
        .withColumn("__base", fn("__t").over(outer))
        .select(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(group)],
                F.col("__b").alias("__kb"), "__base")
    )
    # Plain equality, so that the join takes over the window's partitioning.
    cond = F.col("__b") == F.col("__kb")
    for i, g in enumerate(group):
        cond = (F.col(g) == F.col(f"__k{i}")) & cond
    local = fn("__v").over(inner)
    if how == "sum":
        total = F.coalesce("__local", F.lit(0)) + F.coalesce("__base", F.lit(0))
    else:
        total = F.greatest("__local", "__base")  # skips nulls
    return (
        rows.withColumn("__local", local).join(totals, cond, "left")
        .select(*cols, total.alias(name))
    )


def row_number_in(df: DataFrame, group: Sequence[str], order: str, name: str,
                  width: int = WIDTH, ties: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: the position of the row in its group, from 1."""
    out = running(df, group, order, F.lit(1).cast("long"), name, "sum", width, ties)
    return out.withColumn(name, (F.col(name) + 1).cast("int"))


def interval_join(left: DataFrame, right: DataFrame, key: str, left_span: tuple[str, str],
                  right_span: tuple[str, str], width: int = 1024) -> DataFrame:
    """Pairs of rows of one ``key`` whose half-open spans overlap, each once.

    Both sides are laid on a grid of ``width`` positions and meet per grid cell,
    so a group with many rows spreads over cells and is never paired as a whole.
    A pair counts in the cell that holds the later of the two starts.  Column
    names of the two sides must differ, apart from ``key``.
    """
    ls, le = left_span
    rs, re_ = right_span

    def cells(s: str, e: str) -> Column:
        return F.explode(
            F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))
        )

    a = left.where(F.col(ls) < F.col(le)).withColumn("__cell", cells(ls, le))
    b = right.where(F.col(rs) < F.col(re_)).withColumn("__cell", cells(rs, re_))
    pairs = a.join(b, [key, "__cell"])
    first = F.floor(F.greatest(ls, rs) / width)
    return pairs.where(
        (F.col(ls) < F.col(re_)) & (F.col(le) > F.col(rs)) & (F.col("__cell") == first)
    ).drop("__cell")
