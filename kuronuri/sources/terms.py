"""Term lists: one term per line, ``#`` comments, order kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kuronuri.functions.text import strip
from kuronuri.operators.ordinals import row_number_in

TERM_COLUMNS = ("entity", "term", "score", "bounded", "ord")


def parse_lines(lines: DataFrame, line: str = "value", ord: str = "ord") -> DataFrame:
    """``(ord, term)`` of the lines that hold a term."""
    return (
        lines.select(F.col(ord).alias("ord"), strip(F.col(line)).alias("term"))
        .where((F.col("term") != "") & ~F.startswith(F.col("term"), F.lit("#")))
    )


def read_term_list(spark: SparkSession, path: str) -> DataFrame:
    """Terms of one list file; a missing file gives an empty list.

    Lines of one file are numbered inside the row that holds the file, so order
    does not depend on how tasks split the input.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    try:
        files = spark.read.format("binaryFile").load(path)
    except Exception as e:  # AnalysisException: PATH_NOT_FOUND
        if "PATH_NOT_FOUND" not in str(e):
            raise
        files = spark.createDataFrame([], schema)
    text = F.decode("content", "UTF-8")
    lines = files.select(F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("ord", "value"))
    return parse_lines(lines)


def capped_terms(terms: DataFrame, limit: int, group: str = "entity",
                 ord: str = "ord") -> DataFrame:
    """The first ``limit`` terms of each list, by order."""
    return (
        row_number_in(terms, [group], ord, "rn").where(F.col("rn") <= limit).drop("rn")
    )


def dict_order(term: Column, ord: Column) -> list[Column]:
    """Longest first, then list order."""
    return [F.length(term).desc(), ord.asc()]
