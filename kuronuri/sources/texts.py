"""Reading documents: plain texts of unknown encoding, and review payloads."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Encodings tried, in this order, on bytes that are not UTF-8.
LEGACY = ("cp932", "euc_jp")


@F.pandas_udf(T.StringType())
def _decode_legacy(raw: pd.Series) -> pd.Series:
    def one(b):
        if b is None:
            return None
        if bytes(b[:2]) in (b"\xff\xfe", b"\xfe\xff"):
            return bytes(b).decode("utf-16", errors="replace")
        for enc in LEGACY:
            try:
                return bytes(b).decode(enc)
            except UnicodeDecodeError:
                continue
        return None

    return raw.map(one)


def decode_auto(raw: Column) -> Column:
    """Text of a byte column: UTF-8, else UTF-16 by its mark, else a legacy charset,
    else UTF-8 with repairs.  A byte order mark is not part of the text.

    Valid UTF-8 is decoded in the JVM; Python only sees the other rows.
    """
    bytes_as_text = raw.cast("string")
    valid = F.is_valid_utf8(bytes_as_text)
    return F.when(valid, F.regexp_replace(bytes_as_text, "^\ufeff", "")).otherwise(
        F.coalesce(_decode_legacy(F.when(~valid, raw)), F.make_valid_utf8(bytes_as_text))
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``docs(doc_id, text)`` of the files at ``path``; the base name is the id."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_replace("path", r"(?s)^.*/", "")
    return files.select(F.url_decode(name).alias("doc_id"), decode_auto(F.col("content")).alias("text"))


PAYLOAD_SCHEMA = (
    "doc_id string, party_auto struct<self_names:array<string>,counter_names:array<string>>, "
    "summary struct<total_hits:int,review_hits:int,by_entity:map<string,int>>, "
    "spans array<struct<span_id:string,mark_id:string,doc_id:string,entity_type:string,"
    "start:int,end:int,original:string,replacement:string,score:double,reason:string,"
    "source:string>>, "
    "review_items array<struct<id:string,span_id:string,mark_id:string,entity_type:string,"
    "original:string,replacement:string,score:double,reason:string,context_preview:string,"
    "offset:array<int>>>, warnings struct<docx:array<string>,pdf:array<string>>"
)


def read_payloads(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return spark.read.schema(PAYLOAD_SCHEMA).json(path, multiLine=multi_line)


def payload_spans(payloads: DataFrame) -> DataFrame:
    return _items(payloads, "spans").select("item.*")


def payload_reviews(payloads: DataFrame) -> DataFrame:
    return _items(payloads, "review_items").select("doc_id", "item.*")


def _items(payloads: DataFrame, name: str) -> DataFrame:
    # The outer form keeps the optimizer from copying the array into a filter.
    rows = payloads.select("doc_id", F.explode_outer(name).alias("item"))
    return rows.where(F.col("item").isNotNull())


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan of few files over all cores.

    Detection is bound by the processor, so a scan with fewer partitions than
    cores leaves cores idle.  A large scan has more and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
