"""Query ``op7_language``: the language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuronuri.llm.language import predict_languages, remainder, train_languages
from kuronuri.llm.registry import query
from kuronuri.llm.tables import documents


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train_languages(docs.where(~held_out).select("doc_id", "text", "lang"))
    return predict_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
