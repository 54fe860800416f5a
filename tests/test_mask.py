"""The whole job on small documents."""

import pytest
from pyspark.sql import functions as F

from kuronuri import Overrides, Policy, company_matcher, keyword_matcher, load_policy, mask
from kuronuri.operators import report, review
from kuronuri.operators.detect import chunk_bounds

CONTRACT = (
    "株式会社青空 （以下「甲」という）と\n株式会社緑野 （以下「乙」という）は\n"
    "連絡先 user1@example.com\n氏名\n鈴木 一郎\n鈴木　一郎\n田中 花子\n金額 ¥42,000 \n"
    "東京都千代田区丸の内1-2\n契約日 2024年3月1日\n"
)


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")


def hits(result):
    return {
        (r.entity_type, r.original): (r.replacement, r.reason)
        for r in report.hits_table(result).collect()
    }


FAST = Policy(force_fast=True)


def test_labels_and_reasons(spark):
    r = mask(docs(spark, CONTRACT), FAST).cache()
    h = hits(r)
    assert h["EMAIL", "user1@example.com"] == ("[EMAIL]", "mask:stable_id")
    assert h["PERSON", "鈴木 一郎"] == h["PERSON", "鈴木　一郎"] == ("[PERSON_01]", "mask:stable_id")
    assert h["PERSON", "田中 花子"][0] == "[PERSON_02]"
    assert h["MONEY", "¥42,000"] == ("[MONEY]", "mask:stable_id")
    assert h["ADDRESS", "東京都千代田区丸の内1-2"] == ("東京都千代田区", "mask:address_granular")
    assert h["DATE", "2024年3月1日"] == ("2024年", "mask:date_granular")
    row = r.first()
    assert row.self_names == ["株式会社青空"] and row.counter_names == ["株式会社緑野"]
    assert "株式会社青空" in row.masked and "user1" not in row.masked
    assert {x.original for x in row.review} == {
        x.original for x in row.hits if x.score < 0.8
    }


def test_black_mode_hides_everything(spark):
    row = mask(docs(spark, CONTRACT), Policy(force_fast=True, mode="BLACK")).first()
    for h in row.hits:
        if h.reason.startswith("mask"):
            assert h.replacement == "■" * max(3, len(h.original))


def test_empty_null_and_plain_texts(spark):
    out = {r.doc_id: (r.masked, len(r.hits)) for r in mask(docs(spark, "", None, "plain")).collect()}
    assert out == {"d0": ("", 0), "d1": ("", 0), "d2": ("plain", 0)}


def test_overrides(spark):
    d = docs(spark, "mail a@example.com and b@example.com or c@example.com end")
    forced = spark.createDataFrame(
        [("d0", "0", "4", "X", None, None), ("d0", "5", "9", None, "HERE", "forced:ui_override"),
         ("d0", "9", "9", "X", "no", None), ("d0", "bad", "9", "X", "no", None),
         ("d0", "40", "90", "PERSON", None, None)],
        "doc_id string, start string, end string, entity string, label string, reason string",
    )
    keep = spark.createDataFrame([("d0", 30, 31), ("d0", 8, 2)], "doc_id string, start int, end int")
    once = spark.createDataFrame([("d0", "Ｘ"), ("d0", "c@example.com")], "doc_id string, term string")
    r = mask(d, FAST, Overrides(forced, keep, once)).first()
    got = [(h.start, h.end, h.replacement, h.reason, h.source) for h in r.hits]
    assert got == [
        (0, 4, "[X_01]", "forced:mask_once", "forced"),
        (5, 9, "HERE", "forced:ui_override", "forced"),
        (40, 90, "[PERSON_01]", "forced:mask_once", "forced"),
    ]
    assert r.masked == "[X_01] HEREample.com and b@example.com or [PERSON_01]"
    assert [h.source for h in r.review] == ["forced"] * 3


def test_dictionaries_and_expansion(spark):
    m = company_matcher(["合資会社", "アカデミー"])
    text = "取引先は 合資会社\n明和工業、そして アカデミー です。秘密計画の件"
    r = mask(docs(spark, text), Policy(), matchers=[m, keyword_matcher(["秘密計画", "秘密"])])
    h = {(x.entity_type, x.original) for x in r.first().hits}
    assert ("COMPANY", "アカデミー") in h and ("KEYWORD", "秘密計画") in h
    assert ("COMPANY", "合資会社\n明和工業") in h
    fast = mask(docs(spark, text), FAST, matchers=[m]).first()
    assert "アカデミー" in fast.masked  # dictionaries belong to the full tier


def test_long_lists_equal_short_ones(spark):
    terms = [f"term{i}" for i in range(40)] + ["a+b", "Straße"]
    more = terms + [f"unused{i}" for i in range(60)]
    text = docs(spark, "term1 term12x term12 TERM3,term3 a+b a+bc xterm4 Straße strasse term39term38")
    for make in (company_matcher, keyword_matcher):
        small = text.select(make(terms).spans(F.col("text")).alias("s")).first().s
        large = text.select(make(more).spans(F.col("text")).alias("s")).first().s
        assert [(x.start, x.end, x.original) for x in small] == [
            (x.start, x.end, x.original) for x in large
        ]


def test_chunks(spark):
    def brute(text, size, overlap):
        if len(text) <= size:
            return [(0, len(text))]
        out, pos = [], 0
        while pos < len(text):
            end = min(pos + size, len(text))
            if end < len(text):
                at = text.rfind("\n", pos + size // 2, end)
                end = at + 1 if at > pos else end
            out.append((pos, end - pos))
            pos = end - overlap if end - overlap > pos else end
        return out

    texts = ["", "a" * 25, "ab\n" * 30, "x" * 10, ("y" * 7 + "\n") * 9 + "z" * 40]
    for size, overlap in ((10, 3), (10, 0), (20, 19), (8, 6)):
        rows = docs(spark, *texts).select("text", chunk_bounds(F.col("text"), size, overlap).alias("c"))
        for r in rows.collect():
            assert [tuple(c) for c in r.c] == brute(r.text, size, overlap), (size, overlap, r.text)


def test_huge_document_is_folded_whole(spark):
    text = " ".join(f"user{i}@example.com" for i in range(3000))
    r = mask(docs(spark, text), FAST).first()
    assert len(r.hits) == 3000 and r.masked == " ".join(["[EMAIL]"] * 3000)
    names = "\n".join(f"{chr(0x4E00 + i)}山 太郎" for i in range(500)) * 2
    r = mask(docs(spark, names), FAST).first()
    labels = [h.replacement for h in r.hits]
    assert labels[:2] == ["[PERSON_01]", "[PERSON_02]"] and len(set(labels)) >= 500


def test_contained_spans(spark):
    import random

    from kuronuri.functions.spans import candidate
    from kuronuri.operators.detect import dedupe_contained

    rnd = random.Random(8)
    rows = []
    for d in range(60):
        cs = []
        for i in range(rnd.randint(0, 20)):
            s = rnd.randint(0, 20)
            cs.append((s, s + rnd.randint(1, 8), rnd.choice("AB"), rnd.choice([0.5, 0.7, 0.9]), i))
        rows.append((d, cs))
    df = spark.createDataFrame(
        rows, "doc_id int, cs array<struct<s:int,e:int,entity:string,score:double,ord:int>>"
    )
    cands = F.transform("cs", lambda c: candidate(c.s, c.e, c.entity, c.score, ord=c.ord))
    for r in df.select("cs", dedupe_contained(cands).alias("out")).collect():
        kept = []
        for c in sorted(r.cs, key=lambda c: (-c.score, c.s, c.s - c.e, c.ord)):
            if not any(k.entity == c.entity and k.s <= c.s and k.e >= c.e for k in kept):
                kept.append(c)
        assert sorted(o.ord for o in r.out) == sorted(k.ord for k in kept)


def test_policy_file(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "policy.yaml"
    path.write_text("output:\n  label_format:\n    EMAIL: '<{n}>'\nreview:\n  threshold: 1.0\n")
    p = load_policy(str(path))
    assert p.priorities == {} and p.allow_terms == () and p.review_threshold == 1.0
    r = mask(docs(spark, "a@example.com b@example.com a@example.com"), p).first()
    assert r.masked == "<1> <2> <1>" and len(r.review) == 3
    empty = tmp_path / "empty.yaml"
    empty.write_text("")
    assert load_policy(str(empty)).chunk_size == 0


def test_review_loop_round_trip(spark):
    d = docs(spark, CONTRACT)
    p = report.payload(mask(d, FAST), FAST)
    from kuronuri.sources.texts import payload_reviews, payload_spans

    dets = review.detections(payload_spans(p), payload_reviews(p).select("doc_id", "span_id"))
    mail = dets.where("entity_type = 'EMAIL'").first()
    acts = spark.createDataFrame(
        [("d0", 1, mail.span_id, "KEEP_ONCE")], "doc_id string, seq int, span_id string, op string"
    )
    dets = review.apply_once(dets, acts)
    assert "user1@example.com" in review.mask_reviewed(d, dets).first().masked
    again = mask(d, FAST, Overrides(review.forced_masks(dets), review.keep_spans(dets)))
    assert "user1@example.com" in again.first().masked

    manual = spark.createDataFrame(
        [("d0", 4, 6, "青空", "COMPANY")], "doc_id string, start int, end int, sel string, entity string"
    )
    spans = review.expand_manual_company(review.relocate(manual, d))
    dets = review.add_manual(dets, spans)
    new = dets.where("source = 'forced'").first()
    assert (new.original, new.start, new.reason) == ("株式会社青空", 0, "forced:manual_add")
