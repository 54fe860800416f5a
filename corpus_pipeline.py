"""From raw documents to token ids: five stages, each on all that the one before kept.

Stages take ``(spark, docs, sf_dir)`` and return a table; all but the last return the columns of
``documents``.  Every stage is written as Parquet and read again before the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuronuri.llm.bpe import encode_docs
from kuronuri.llm.jaccard_join import one_of_each
from kuronuri.llm.language import UNKNOWN, predict_languages, train_languages
from kuronuri.llm.mixing import mixed_documents
from kuronuri.llm.pii import mask_pii
from kuronuri.llm.tables import documents, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A BPE encoder has no SQL form; the stages are tested against brute-force versions.
ORACLE_SQL = None


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter, or undecided between languages and not labelled
    with the one found.  A missing label is filled in."""
    model = train_languages(docs.select("doc_id", "text", "lang"))
    seen = predict_languages(docs, model, 0.2, "text", "lang", "source", "n_chars")
    agrees = F.coalesce(F.col("lang") == F.col("lang_pred"), F.lit(False))
    return seen.where((F.col("lang_pred") != UNKNOWN) & (~F.col("ambiguous") | agrees)).withColumn(
        "lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near copies."""
    return one_of_each(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put labels in the place of personal data."""
    return mask_pii(docs, keep=("lang", "source")).withColumn(
        "n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, keep or drop documents so that sources meet their target weights."""
    return mixed_documents(docs.drop("n_chars")).withColumn(
        "n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids`` of every row of the mix."""
    return encode_docs(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
