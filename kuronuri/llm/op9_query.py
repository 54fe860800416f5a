"""Query ``op9_token_counts``: the length histogram of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kuronuri.llm.registry import query
from kuronuri.llm.tables import documents
from kuronuri.llm.token_counts import encoded_lengths, length_histogram


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return length_histogram(encoded_lengths(documents(spark, sf_dir), path))
