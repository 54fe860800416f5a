"""What is found does not depend on the length of a text or of a list."""

from pyspark.sql import functions as F

from kuronuri import keyword_matcher, mask
from kuronuri.functions.spans import company_expand_end
from kuronuri.functions.text import blocks
from kuronuri.operators.dictionary import company_matcher, detect_terms, fold_case

PARTIES = "株式会社山田 （以下「甲」という）と⏎株式会社鈴木 （以下「乙」という）は⏎".replace("⏎", "\n")


def test_terms_and_parties_far_behind_are_found(spark):
    rows = [(n, "あ" * n + "\n" + PARTIES + "Secret Plan の件\n") for n in (0, 8_001, 15_001, 400_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = mask(docs, matchers=[keyword_matcher(["secret plan"])]).select(
        "doc_id", "self_names", "counter_names", "tier",
        F.expr("exists(hits, h -> h.entity_type = 'KEYWORD' and h.original = 'Secret Plan')").alias("k"),
    ).collect()
    assert {tuple(r)[1:] for r in map(lambda r: (r.doc_id, tuple(r.self_names), tuple(r.counter_names),
                                                 r.tier, r.k), out)} == {
        (("株式会社山田",), ("株式会社鈴木",), "full", True)}


def test_case_rule_does_not_depend_on_the_list(spark):
    text = "ſecret Key SECRET Key İx ıx ẞa"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    terms = ["secret", "key", "ix", "ßa"]
    few = detect_terms(docs, keyword_matcher(terms)).collect()
    many = detect_terms(docs, keyword_matcher([*terms, *[f"other{k}" for k in range(70_000)]])).collect()
    assert sorted(few) == sorted(many)
    assert sorted(r.original for r in few) == sorted(text.split())
    assert all(len(fold_case(c)) == 1 for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff")


def test_a_term_behind_fifty_thousand_counts(spark):
    docs = spark.createDataFrame([(1, "名は Last Company です")], "doc_id long, text string")
    terms = [f"company {k}" for k in range(50_001)] + ["last company"]
    assert [r.original for r in detect_terms(docs, company_matcher(terms)).collect()] == ["Last Company"]


def test_full_width_exclamation_mark_does_not_end_a_company_name(spark):
    df = spark.createDataFrame([("株式会社山！田商店、東京", "山！田商店"), ("株式会社山!田", "山")],
                               "text string, name string")
    end = company_expand_end(blocks(F.col("text")), F.length("text"), F.lit("株式会社"), F.lit(4))
    for r in df.select("text", "name", end.alias("e")).collect():
        assert r.text[4 : r.e] == r.name
