"""Dictionary tables and lists against a plain search, letter by letter."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kuronuri import Policy, mask
from kuronuri.operators.dictionary import (
    DictMatcher,
    company_terms,
    detect_term_table,
    detect_terms,
    fold_case,
    keyword_terms,
    possible_terms,
)
from kuronuri.operators.report import hits_table


def brute(text, terms, bounded):
    low, pos, out = fold_case(text), 0, []
    while pos < len(text):
        best = 0
        for t in map(fold_case, terms):
            e = pos + len(t)
            if t and low[pos:e] == t and len(t) > best and not (bounded and (
                    (pos > 0 and re.match(r"\w", text[pos - 1])) or (e < len(text) and re.match(r"\w", text[e])))):
                best = len(t)
        if best:
            out.append((pos, pos + best, text[pos:pos + best]))
        pos += max(best, 1)
    return out


@pytest.mark.parametrize("bounded", [True, False])
def test_tables_and_lists_equal_a_plain_search(spark, bounded):
    rng = random.Random(bounded)
    letters = "aAbß(ſK.İé社株 \n\\$😀"
    word = lambda n: "".join(rng.choices(letters, k=n))
    terms = [word(rng.choice([1, 2, 2, 3, 4])) for _ in range(40)] + ["aa", "aaa", "", "a b", "\\E", "株社"]
    texts = [(f"c{i}", word(rng.choice([0, 1, 5, 60]))) for i in range(60)]
    texts += [("c1", word(50)), (None, word(50)), ("n", None), ("long", word(9000)), ("aaa", "aaaaa aa a aaaa")]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    table = spark.createDataFrame([("X", t, 0.5, bounded) for t in [*terms, terms[0]]] + [("X", None, 0.5, bounded)],
                                  "entity string, term string, score double, bounded boolean")
    want = sorted(((d, *s) for d, t in texts for s in brute(t or "", terms, bounded)), key=str)
    for found in (detect_term_table(docs, table), detect_terms(docs, DictMatcher("X", tuple(terms), 0.5, bounded))):
        assert sorted(((r.doc_id, r.start, r.end, r.original) for r in found.collect()), key=str) == want


def test_a_million_terms(spark):
    """The driver sees none of them, no Python runs, and few wrong candidates reach a text."""
    terms = company_terms(spark.range(1_000_000).select(F.concat(F.lit("株式会社 No"), "id", F.lit("号")).alias("term")))
    rows = [(i, f"契約先は 株式会社 NO{i * 31}号 と 株式会社 ﾅｼ です。" * 3) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = detect_term_table(docs, terms)
    assert "Python" not in found._jdf.queryExecution().toString()
    assert sorted((r.doc_id, r.original) for r in found.collect()) == sorted(
        (i, f"株式会社 NO{i * 31}号") for i in range(200) for _ in range(3))


def test_a_term_waits_at_its_rarest_pairs(spark):
    docs = spark.createDataFrame([(i, f"株式会社 同じ 名{i}") for i in range(50)], "doc_id long, text string")
    terms = company_terms(spark.createDataFrame([(f"株式会社 同じ 名{i}",) for i in range(50)], "term string"))
    assert possible_terms(docs, terms).count() <= 10 * 50


def test_tables_in_the_whole_job(spark):
    docs = spark.createDataFrame([("a", "秘密計画は 山田屋 の件"), ("b", "山田屋さん"), ("c", "なし")], "doc_id string, text string")
    terms = company_terms(spark.createDataFrame([("山田屋",)], "term string")).unionByName(
        keyword_terms(spark.createDataFrame([("秘密計画",), ("秘密",)], "term string")))
    for policy in (Policy(), Policy(chunk_size=6, chunk_overlap=5)):
        hits = hits_table(mask(docs, policy, terms=terms))
        assert {(r.doc_id, r.entity_type, r.original) for r in hits.collect()} == {
            ("a", "KEYWORD", "秘密計画"), ("a", "COMPANY", "山田屋")}
    assert [r.masked for r in mask(docs, terms=terms.limit(0)).orderBy("doc_id").collect()] == [
        r.text for r in docs.orderBy("doc_id").collect()]
