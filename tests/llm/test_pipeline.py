"""The stages of the pipeline, each on what the one before kept, and queries against their SQL."""

import os

import duckdb
import pandas as pd
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from kuronuri.llm import registry  # noqa: E402
from tests.conftest import SMALL  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
GOOD = {
    "en": "the cat and the dog went to the house of the old man with a lamp in it number",
    "de": "der Hund und die Katze gingen zu dem Haus des alten Mannes mit der Lampe nummer",
}


def rows():
    out = []
    for k in range(60):
        lang = "en" if k % 2 else "de"
        text = " ".join(f"{w}{k * 70 + i}" if i % 4 == 0 else w
                        for i, w in enumerate((GOOD[lang] + " ") .split() * 3)) + f" id{k} x{k * k}."
        out.append((k, text, lang, f"s{k % 3}", len(text)))
    first = out[4][1]
    out += [(100, first, "de", "s0", len(first)), (101, first + " end", "de", "s1", len(first) + 4),
            (102, None, "en", "s1", None), (103, "12 34 !!", None, None, 8),
            (104, GOOD["en"] + " mail a@b.cd or 10.0.0.1", None, None, 1)]
    return out


def test_stages(spark):
    docs = spark.createDataFrame(rows(), COLUMNS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "mixing", "tokens"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        seen[name] = docs.collect()
        if name != "tokens":
            assert sorted(docs.columns) == sorted(c.split()[0] for c in COLUMNS.split(", "))
    kept = {r.doc_id for r in seen["language"]}
    assert kept == set(range(60)) | {100, 101, 104}
    assert {r.lang for r in seen["language"] if r.doc_id == 104} == {"en"}
    assert {100, 101}.isdisjoint(r.doc_id for r in seen["near_duplicates"])
    assert {4, 59} <= {r.doc_id for r in seen["near_duplicates"]}
    assert 104 in {r.doc_id for r in seen["personal_data"]}
    assert all("@" not in r.text and "10.0.0.1" not in r.text for r in seen["personal_data"])
    assert len(seen["personal_data"]) == len(seen["near_duplicates"])
    words = sum(len(r.text.split()) for r in seen["personal_data"])
    mixed = sum(len(r.text.split()) for r in seen["mixing"])
    assert abs(mixed - 1.5 * words) <= 4
    assert len(seen["tokens"]) == len(seen["mixing"]) and all(r.ids for r in seen["tokens"])


def test_stages_on_nothing(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.collect() == []


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")
def test_queries_equal_their_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    registry.load()

    def plain(df):
        cols = sorted(df.columns)
        return cols, sorted(
            [tuple(None if pd.isna(v) else round(v, 6) if isinstance(v, float) else v for v in r)
             for r in df[cols].itertuples(index=False, name=None)], key=repr)

    for name, sql in registry.ORACLES.items():
        got = plain(registry.QUERIES[name](spark, SMALL).toPandas())
        assert got == plain(con.execute(sql).df()), name
    assert len(registry.QUERIES) == 14
