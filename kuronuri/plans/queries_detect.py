"""Registered detection queries: one per pattern, both tiers, dictionaries, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.operators.detect import detect, detect_pattern
from kuronuri.plans import fixtures as fx
from kuronuri.plans import oracle as o
from kuronuri.plans.catalog import query


def _register_pattern(key: str, pattern: vocab.Pattern) -> None:
    sql = o.with_corpus(
        f'select doc_id, cast(s as integer) as start, cast(e as integer) as "end",'
        f" {o.q(pattern.entity)} as entity, cast({pattern.score} as double) as score,"
        f" m as original from ({o.detector(key)})"
    )

    @query(key, sql)
    def run(spark, sf_dir):
        return detect_pattern(fx.corpus(spark, sf_dir), pattern)


for _key, _pattern in vocab.PATTERNS.items():
    _register_pattern(_key, _pattern)


@query(
    "detect_fast",
    o.with_corpus(
        'select doc_id, cast(s as integer) as start, cast(e as integer) as "end", entity, score,'
        f" pattern, m as original from ({o.detections()}) where m <> '鈴木 一郎'"
    ),
)
def detect_fast(spark, sf_dir):
    """All patterns over all texts, one raw term on the allow-list."""
    return detect(fx.corpus(spark, sf_dir), allow=F.array(F.lit("鈴木 一郎")))
