"""Scalar functions against Python's own."""

import html
import os
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from kuronuri.functions import text as tx
from kuronuri.operators.party import clean_name


def column(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def norm(s):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s or "")).strip()


def test_norm_term(spark):
    values = [
        "", "  a  b ", "ＡＢＣ　１２３", "ｶﾞｷﾞ", "が", "①②", "㈱ABC", "é", "é", "ﬁ",
        "￥100", "（株）", "株式会社　A", "한글", "한", "x\xa0y", None, "Å", "½",
    ]
    assert column(spark, values, tx.norm_term) == [norm(v) for v in values]


def test_plain_characters_need_no_python(spark):
    hard = re.compile(tx._NEEDS_NFKC)
    plain = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not hard.match(chr(c))]
    table = str.maketrans(tx._WIDE, tx._NARROW)
    assert len(plain) > 20_000
    for c in plain:
        assert unicodedata.normalize("NFKC", c) == c.translate(table), hex(ord(c))
        assert unicodedata.combining(c) == 0


def test_safe_name_and_route(spark):
    paths = [
        "a/b/c.txt", "x/..", "a<b>c:d.TXT", "dir/", "..", "a. . ", "p/q?.docx", "b.DOCX", ".pdf", "a.pdf",
        "..x.Pdf", "no_ext", "d.docx/file", "tab\there", "back\\slash.pdf",
    ]

    def safe(p):
        b = os.path.basename(p).replace("..", "_")
        b = re.sub(r'[<>:"/\\|?*\x00-\x1f]', "_", b).rstrip(" .")
        return b or "document"

    def route(p):
        return {".docx": "docx", ".pdf": "pdf"}.get(os.path.splitext(p)[1].lower(), "text")

    assert column(spark, paths, tx.safe_name) == [safe(p) for p in paths]
    assert column(spark, paths, tx.route_ext) == [route(p) for p in paths]


def test_html_short_black(spark):
    values = ["<a href=\"x\">'&'</a>\nline", "", "　" + "長" * 40 + " ", "short\ntext", None]
    assert column(spark, values, tx.html_escape) == [
        html.escape(v or "").replace("\n", "<br>") for v in values
    ]
    lines = [(v or "").replace("\n", " ").strip() for v in values]
    assert column(spark, values, tx.short) == [
        x[:27] + "…" if len(x) > 28 else x for x in lines
    ]
    assert column(spark, ["", "ab", "abcd"], tx.black) == ["■■■", "■■■", "■■■■"]


def test_labels(spark):
    df = spark.range(1).select(
        tx.label("[PERSON_{n:02d}]", F.lit(7)), tx.label("<{n}>", F.lit(7)), tx.label("100%", F.lit(7)),
        tx.label("", F.lit(7)), tx.label("{n:03d}%", F.lit(1234)),
    )
    assert list(df.first()) == ["[PERSON_07]", "<7>", "100%", "", "1234%"]


@pytest.mark.parametrize(
    ("value", "until_city", "until_pref"),
    [
        ("東京都千代田区丸の内1-2", "東京都千代田区", "東京都"),
        ("奈川県横浜市西区1-2", "奈川県横浜市", "奈川県"),
        ("京都府京都市左京区", "京都府京都市", "京都府"),
        ("北海道函館町", "北海道函館町", "北海道"),
        ("大阪府どこか", "大阪府", "大阪府"),
        ("nothing", "[ADDRESS]", "[ADDRESS]"),
        ("  ", "", ""),
    ],
)
def test_addresses(spark, value, until_city, until_pref):
    assert column(spark, [value], tx.address_granular) == [until_city]
    assert column(spark, [value], lambda c: tx.address_granular(c, "UNTIL_PREF")) == [until_pref]


def brute_clean(s):
    s = s.strip()
    s = re.sub(r"^(?:委託者|受託者|売主|買主|貸主|借主|甲|乙)[・:：]?\s*", "", s).strip()
    while True:
        before = s
        for w in ("と", "及び", "および", "・", "、", "，", "）", ")"):
            while s.startswith(w) and len(s) > len(w):
                s = s[len(w):].strip()
        for w in "はがのをにと":
            if s.endswith(w) and len(s) > 2:
                s = s[:-1].strip()
        if s == before:
            return s


def test_clean_name(spark):
    import random

    rnd = random.Random(11)
    bits = ["と", "及び", "および", "・", "、", "）", ")", "は", "が", "の", "に", "甲", "売主", "A", "社", " ", "　"]
    names = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12))) for _ in range(500)]
    assert column(spark, names, clean_name) == [brute_clean(n) for n in names]
