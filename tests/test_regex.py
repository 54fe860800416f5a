"""Spans must be those of Python's own regular expressions."""

import re

import pytest
from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.operators.detect import _matches, detect_fast

TEXTS = [
    "",
    "no match here at all",
    "連絡先 user17@example.com, a.b-c@x.co.jp! é@x.com x@y.z\r\n",
    "電話 03-1234-0017 0312345678 ０３-1234-5678 00312345678901234\n〒100-0017 1000017 12345678 100ー0017",
    "AB1234 aAB12 ABCD12 A1 Z99x S001\nPRIV-2025-Q3-017 AB-12 XX-1234-A-B-C",
    "氏名\n鈴木 一郎\n　佐藤　花子　\n42\n男\n7\n女\n独身\n山田\t太郎",
    "担当：田中(担当:佐藤)（担当:山田）担当:高橋次郎三年齢：42 年齢:120歳",
    "¥42,000 ￥ 1,234.50 42万円 3百万円 12,345円 ¥ 5 円 1,23,456円",
    "2024年3月1日 2024/03/01 2024.3.1 2024 - 3 令和6年 平成元年 R 5 年 H31年 昭和 64年",
    "東京都千代田区丸の内1-2 神奈川県横浜市西区1-2\n京都府京都市 北海道札幌市中央区 XX県YY村",
    "株式会社ABC（以下「甲」という）と\nDEF株式会社 GHI 有限会社 😀会社 合同会社😀 A株式会社B株式会社C",
    "x" * 40 + "株式会社 " + "y" * 29 + "\n\n 株式会社株式会社",
    "（株）XYZ (株) QRS 甲 は 甲乙 丙、丁。甲_ é甲 甲́",
    "emoji 😀😀 user@example.com 😀 AB12\r\n鈴木 一郎\r\n",
    "\x1c株式会社\x1cABC\x1d DEF　株式会社",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").cache()


@pytest.mark.parametrize("key", list(vocab.PATTERNS))
def test_pattern_equals_python(texts, key):
    p = vocab.PATTERNS[key]
    rows = texts.select("text", _matches(F.col("text"), p).alias("ms")).collect()
    for r in rows:
        want = [(m.start(), m.end(), m.group()) for m in re.finditer(p.regex, r.text)]
        assert [(m.s, m.e, m.m) for m in r.ms] == want, r.text


def test_patterns_that_match_nothing(texts):
    rx = r"x*|(?=é)"
    own = vocab.Pattern("X", "x", rx, 0.5)
    rows = texts.select("text", _matches(F.col("text"), own).alias("ms")).collect()
    for r in rows:
        want = [(m.start(), m.end()) for m in re.finditer(rx, r.text) if m.group()]
        assert [(m.s, m.e) for m in r.ms] == want


def test_union_is_sorted_and_skips_allowed_terms(texts):
    allow = F.array(F.lit("鈴木 一郎"))
    rows = texts.select("text", detect_fast(F.col("text"), allow).alias("c")).collect()
    for r in rows:
        want = []
        for i, p in enumerate(vocab.PATTERNS.values()):
            want += [
                (m.start(), -len(m.group()), i) for m in re.finditer(p.regex, r.text)
                if m.group() != "鈴木 一郎"
            ]
        assert [(c.start, c.start - c.end, c.ord) for c in r.c] == sorted(want)


def test_each_pattern_is_in_the_plan_once(spark):
    from kuronuri import Policy, mask

    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = mask(docs, Policy(force_fast=True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("A-Za-z0-9._%+-]+@") == 2 + 1  # filter, matches, gaps
    assert "Exchange" not in plan


def test_company_suffix_on_random_texts(spark):
    import random

    rnd = random.Random(7)
    bits = ["株式会社", "合同会社", "A", "ab", " ", "\n", "　", "x" * 29, "あ", "会社", "株式"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    p = vocab.PATTERNS["det_company_suffix"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", _matches(F.col("text"), p).alias("ms")).collect():
        want = [(m.start(), m.end(), m.group()) for m in re.finditer(p.regex, r.text)]
        assert [(m.s, m.e, m.m) for m in r.ms] == want, repr(r.text)


def test_one_pass_equals_several_also_with_marks_in_the_text(spark):
    from kuronuri.functions.regex import FIELD, MARK, java_regex, matches_and_gaps, match_spans, offsets

    rx = java_regex(vocab.PARTY_DEFINE)
    plain = "社名A（以下「甲」という）、B社😀（以下『乙』という。)\n" * 2
    texts = ["", "以下", plain, MARK + plain, plain.replace("社名", FIELD), plain + MARK + FIELD]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    one = match_spans(F.col("text"), rx, groups=(1, 2))
    many = offsets(F.struct(*matches_and_gaps(F.col("text"), rx, (1, 2))), (1, 2))
    for r in df.select("text", one.alias("one"), many.alias("many")).collect():
        want = [(m.start(), m.end(), m.group(), m.group(1), m.group(2))
                for m in re.finditer(vocab.PARTY_DEFINE, r.text)]
        assert [tuple(x) for x in r.one] == [tuple(x) for x in r.many] == want


def test_parties_of_both_sides_are_read_once(spark):
    """One scan, and no filter that holds a copy of the patterns."""
    import __spark_entry__ as entry
    from tests.conftest import SMALL

    plan = entry.queries()["party_self_counter"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
    assert not any("Filter" in line and "という" in line for line in plan.splitlines())


def test_patterns_pass_the_text_once_in_both_tiers(spark, texts):
    """One pass a pattern, no pass as a filter; spans are Python's, also of texts that hold marks."""
    from kuronuri.functions.regex import FIELD, MARK
    from kuronuri.operators.detect import SUFFIX, pattern_spans

    patterns = [p for p in vocab.PATTERNS.values() if p != SUFFIX]
    more = [MARK + TEXTS[4], TEXTS[5] + FIELD, "ſK12 KK-1234-a h 5 年 ab12 \u212ab-12-x", "０12-3456 x￥５円 _甲 甲"]
    df = texts.select("text").union(spark.createDataFrame([(t,) for t in more], "text string"))
    for flags, own in (("", 0), ("ims", re.I | re.M | re.S)):
        found = df.select("text", pattern_spans(F.col("text"), patterns, flags).alias("c"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "RLIKE" not in plan and "rlike" not in plan.lower()
        for r in found.collect():
            want = [(m.start(), m.end(), m.group(), i) for i, p in enumerate(patterns)
                    for m in re.finditer(p.regex, r.text, own)]
            assert [(c.start, c.end, c.original, c.ord) for c in r.c] == want, r.text
