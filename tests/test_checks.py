"""Registered queries against their SQL on the smallest data set."""

import os

import duckdb
import pytest

from tests.conftest import SMALL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
NAMES = (
    "mask_documents", "mask_overrides", "mask_black", "det_email", "det_address", "chunk_split",
    "party_dedupe", "party_clean_name", "det_dict_company", "fn_address_granular", "join_keep_anti",
    "win_stable_id", "apply_skipped", "forced_dedupe", "splice_segment", "agg_pdf_stats",
    "sink_marked_html", "sink_audit", "stream_mask", "apply_once", "stream_review",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows(df):
    def plain(v):
        return round(v, 9) if isinstance(v, float) else v

    cols = sorted(df.columns)
    out = [tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return cols, sorted(out, key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    import __spark_entry__ as entry

    want = rows(duck.execute(entry.oracle_sql()[name]).df())
    got = rows(entry.queries()[name](spark, SMALL).toPandas())
    assert got == want


def test_every_query_is_registered_once(spark):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    own = {q for q in queries if not q.startswith("op") and q != "pipeline"}
    assert own <= set(sql)
    assert entry.entry(spark).columns == ["doc_id", "masked", "n_hits"]
