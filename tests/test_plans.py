"""Plans of queries: dear columns are built once."""

import __spark_entry__ as entry
from kuronuri.operators import party
from kuronuri.plans import queries_party

SMALL = "/root/testdata/sf0.001"


def test_lists_are_not_built_again_to_filter_on_their_size(spark):
    plan = entry.queries()["allowlist_build"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "という" in line for line in plan.splitlines())


def test_allowlist_rows_are_those_of_the_lists(spark, monkeypatch):
    rows = [("a", "株式会社山田 （以下「甲」という）と"), ("b", None), (None, "x"), ("a", "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    monkeypatch.setattr(queries_party, "docs", lambda *_: df)
    lists = queries_party._allow(spark, SMALL).collect()
    want = sorted(((r.doc_id or "", t or "") for r in lists for t in r.terms or ()))
    got = [(r.doc_id or "", r.term or "") for r in queries_party.allowlist_build(spark, SMALL).collect()]
    assert sorted(got) == want and ("a", "株式会社山田") in got and ("", "") in got
    assert {r.doc_id for r in party.with_parties(df).collect()} == {"a", "b", None}
