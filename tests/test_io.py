"""Sources, sinks, layout and streaming."""

import random

from pyspark.sql import functions as F

from kuronuri import Policy, mask
from kuronuri.operators import layout
from kuronuri.sources import sinks
from kuronuri.sources.terms import capped_terms, read_term_list
from kuronuri.sources.texts import payload_spans, read_payloads, read_texts
from kuronuri.streaming.mask_stream import (
    document_stream,
    mask_stream,
    read_masked,
    write_stream,
)

FAST = Policy(force_fast=True)


def test_encodings(spark, tmp_path):
    text = "契約書\n株式会社青空"
    for name, enc in (
        ("a.txt", "utf-8"), ("b.txt", "cp932"), ("c.txt", "euc_jp"), ("e.txt", "utf-8-sig"), ("f.txt", "utf-16"),
    ):
        (tmp_path / name).write_bytes(text.encode(enc))
    (tmp_path / "d.txt").write_bytes(b"ok \x81")
    got = {r.doc_id: r.text for r in read_texts(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == got["b.txt"] == got["c.txt"] == got["e.txt"] == got["f.txt"] == text
    assert got["d.txt"].startswith("ok ") and "�" in got["d.txt"]


def test_term_lists(spark, tmp_path):
    path = tmp_path / "terms.txt"
    path.write_text("# head\n 青空 \n\nb\r\nc#\n", encoding="utf-8")
    terms = read_term_list(spark, str(path))
    assert [r.term for r in terms.orderBy("ord").collect()] == ["青空", "b", "c#"]
    assert read_term_list(spark, str(tmp_path / "none.txt")).count() == 0
    two = capped_terms(terms.withColumn("entity", F.lit("X")), 2)
    assert {r.term for r in two.collect()} == {"青空", "b"}


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a.txt", 'x "q", a@example.com\nend'), ("b.txt", "none")], "doc_id string, text string")
    r = sinks.write_result(mask(d, FAST), str(tmp_path / "result"))
    sinks.write_hits_csv(r, str(tmp_path / "csv"))
    csv = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert tuple(csv.columns) == sinks.CSV_FIELDS and csv.first().original == "a@example.com"
    sinks.write_payloads(r, str(tmp_path / "payload"), FAST)
    back = read_payloads(spark, str(tmp_path / "payload"))
    assert back.count() == 2
    span = payload_spans(back).first()
    assert (span.span_id, span.mark_id, span.doc_id) == ("span_000001", "m000001", "a.txt")
    sinks.write_audit(r, str(tmp_path / "audit"))
    audit = spark.read.json(str(tmp_path / "audit"))
    assert audit.count() == 2 and set(audit.columns) == {"ts", "action", "doc_id", "total_hits", "review_hits"}
    sinks.write_masked_text(r, str(tmp_path / "text"))
    texts = {t.doc_id: (t.name, t.text) for t in spark.read.json(str(tmp_path / "text")).collect()}
    assert texts == {m.doc_id: (f"masked_{m.doc_id}", m.masked) for m in r.collect()}
    sinks.write_html(r, str(tmp_path / "html"), F.array(F.lit("w<1>")))
    page = spark.read.parquet(str(tmp_path / "html")).where("doc_id = 'a.txt'").first()
    assert page.left_html == 'x &quot;q&quot;, <mark id="m000001" class="mk">a@example.com</mark><br>end'
    assert page.warn == "<div class='warn'><b>Warnings:</b> w&lt;1&gt;</div>"


def test_rectangles_equal_a_plain_walk(spark):
    rnd = random.Random(9)
    chars, hits = [], []
    for d in range(4):
        page, y = 0, 10.0
        for pos in range(200):
            if rnd.random() < 0.1:
                y += rnd.choice([1.5, 1.9, 2.0, 12.0])
            if rnd.random() < 0.02:
                page, y = page + 1, 10.0
            ch = "\n" if rnd.random() < 0.1 else "x"
            box = (0.0, 0.0, 0.0, 0.0) if ch == "\n" else (pos * 1.0, y, pos + 1.0, y + 9)
            chars.append((d, pos, page, *box, ch))
        for h in range(6):
            s = rnd.randint(0, 150)
            hits.append((d, h, s, s + rnd.randint(1, 50)))
    want = []
    for d, h, s, e in hits:
        run, anchor = None, 0.0
        for c in chars:
            if c[0] != d or not s <= c[1] < e or c[7] == "\n":
                continue
            if run and run[0] == c[2] and abs(c[4] - anchor) < 2.0:
                run = (run[0], min(run[1], c[3]), min(run[2], c[4]), max(run[3], c[5]), max(run[4], c[6]))
                continue
            if run:
                want.append((d, h, *run))
            run, anchor = (c[2], c[3], c[4], c[5], c[6]), c[4]
        if run:
            want.append((d, h, *run))
    cdf = spark.createDataFrame(chars, "doc_id int, pos int, page int, x0 double, y0 double, x1 double, y1 double, ch string")
    hdf = spark.createDataFrame(hits, "doc_id int, hit_no int, start int, end int")
    rects = layout.hit_rects(layout.line_pieces(layout.hit_chars(hdf, cdf), width=16))
    got = [tuple(r) for r in rects.orderBy("doc_id", "hit_no", "rect_no").drop("rect_no").collect()]
    assert got == sorted(want, key=lambda w: (w[0], w[1]))


def test_stream_equals_batch(spark, tmp_path):
    src = spark.createDataFrame([(i, f"user{i}@example.com 100-000{i}") for i in range(9)], "doc_id bigint, text string")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = mask_stream(document_stream(spark, str(tmp_path / "in"), max_files=1), FAST)
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.doc_id, r.masked) for r in spark.read.parquet(str(tmp_path / "out/masked")).collect()}
    assert got == {(r.doc_id, r.masked) for r in mask(src, FAST).collect()}
    assert spark.read.parquet(str(tmp_path / "out/hits")).count() == 18
    # One file is a table, too, and an empty folder an empty one.
    file = next((tmp_path / "in").glob("part-*.parquet"))
    one = mask_stream(document_stream(spark, str(file)), FAST)
    write_stream(one, str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    assert read_masked(spark, str(tmp_path / "out2")).count() == spark.read.parquet(str(file)).count()
    (tmp_path / "none").mkdir()
    none = mask_stream(document_stream(spark, str(tmp_path / "none")), FAST)
    write_stream(none, str(tmp_path / "out3"), str(tmp_path / "cp3")).awaitTermination()
    assert read_masked(spark, str(tmp_path / "out3")).collect() == []
