"""Folds, running totals and interval joins against plain loops."""

import random

from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.functions.spans import candidate, drop_kept, splice
from kuronuri.functions.text import blocks, cut
from kuronuri.operators.detect import dedupe_contained
from kuronuri.operators.ordinals import interval_join, row_number_in, running
from kuronuri.operators.overrides import keep_anti
from kuronuri.operators.resolve import resolve_arrays, resolve_chains, resolve_islands

ENTITIES = ["EMAIL", "PERSON", "COMPANY", "DATE", "CUSTOM"]


def random_candidates(seed, docs=60, most=25, far=60):
    rnd = random.Random(seed)
    rows, n = [], 0
    for d in range(docs):
        for _ in range(rnd.randint(0, most)):
            s = rnd.randint(0, far)
            rows.append((
                d, s, s + rnd.randint(1, 12), rnd.choice(ENTITIES), rnd.choice([0.5, 0.8, 0.9]),
                rnd.choice(["analyzer"] * 4 + ["forced"]), n,
            ))
            n += 1
    return rows


def walk(rows, final):
    def rank(c):
        return (
            0 if final and c[5] == "forced" else 1, -vocab.PRIORITIES.get(c[3], 0),
            c[1] - c[2], -c[4],
        )

    kept = []
    rows = sorted(rows, key=lambda c: (c[1], rank(c), c[6]) if final else (c[1], c[1] - c[2], c[6]))
    for c in rows:
        if kept and c[1] < kept[-1][2]:
            if rank(c) < rank(kept[-1]):
                kept[-1] = c
        else:
            kept.append(c)
    return {(c[0], c[1], c[2], c[3], c[6]) for c in kept}


def expect(rows, final):
    out = set()
    for d in {r[0] for r in rows}:
        out |= walk([r for r in rows if r[0] == d], final)
    return out


def table(spark, rows):
    return spark.createDataFrame(
        rows, "doc_id int, start int, end int, entity string, score double, source string, ord int"
    )


def got(df):
    return {(r.doc_id, r.start, r.end, r.entity, r.ord) for r in df.collect()}


def test_folds_equal_plain_loops(spark):
    for seed in (1, 2):
        rows = random_candidates(seed)
        df = table(spark, rows)
        assert got(resolve_arrays(df, final=True)) == expect(rows, True)
        assert got(resolve_islands(df, final=True, width=8)) == expect(rows, True)
        plain = [(*r[:5], "analyzer", r[6]) for r in rows]
        df = table(spark, plain)
        assert got(resolve_arrays(df, final=False)) == expect(plain, False)
        assert got(resolve_islands(df, final=False, width=8)) == expect(plain, False)


def test_resolved_spans_are_disjoint_in_a_hot_document(spark):
    rows = random_candidates(5, docs=1, most=4000, far=20000)
    rows += random_candidates(6, docs=1, most=4000, far=20000)
    rows = [(*r[:6], i) for i, r in enumerate(rows)]
    out = sorted((r.start, r.end) for r in resolve_islands(table(spark, rows)).collect())
    assert all(a[1] <= b[0] for a, b in zip(out, out[1:], strict=False))
    assert got(resolve_arrays(table(spark, rows))) == expect(rows, True)


def test_chains_equal_plain_loops(spark):
    rows = random_candidates(3, docs=40, most=25, far=60)
    rows = [(*r[:6], i) for i, r in enumerate(rows)]
    # Chains over many cells: the way never returns, nested spans, and ever better ones.
    steps = [(100, 5 * i, 5 * i + 10, "PERSON", 0.5, "analyzer", 0) for i in range(120)]
    nested = [(101, i, 400 - i, "PERSON", 0.5, "analyzer", 0) for i in range(150)]
    rising = [(102, i, i + 2 + 3 * i, "PERSON", 0.5, "analyzer", 0) for i in range(100)]
    falling = [(103, i, i + 300 - 2 * i, "PERSON", 0.5, "analyzer", 0) for i in range(120)]
    far = [(104, 0, 5000, "PERSON", 0.5, "analyzer", 0), (104, 4900, 4905, "PERSON", 0.5, "forced", 1),
           (104, 4903, 4990, "EMAIL", 0.5, "analyzer", 2), (104, 70000, 70001, "DATE", 0.5, "analyzer", 3)]
    rows += steps + nested + rising + falling + far
    want = expect(rows, True)
    for cell in (4, 20):  # 20: spans end and begin at borders of cells
        assert got(resolve_chains(table(spark, rows), cell=cell)) == want
    assert got(resolve_chains(table(spark, rows))) == want
    assert resolve_chains(table(spark, rows).limit(0), cell=4).count() == 0


def as_array(name="cs"):
    c = candidate(F.col("start"), F.col("end"), F.col("entity"), F.col("score"), ord=F.col("ord"))
    return F.collect_list(c).alias(name)


def test_contained_spans_equal_all_pairs(spark):
    rows = random_candidates(8, docs=80, most=20, far=15)
    rows = [(*r[:3], r[3][:1], r[4], r[5], r[6] % 4) for r in rows]
    rows = list({(r[0], r[1], r[2], r[3], r[4], r[6]): r for r in rows}.values())

    def better(d, c):
        return (d[0] == c[0] and d[3] == c[3] and d[1] <= c[1] and d[2] >= c[2]
                and (-d[4], d[1], d[1] - d[2], d[6]) < (-c[4], c[1], c[1] - c[2], c[6]))

    want = sorted((c[0], c[1], c[2], c[3], c[4], c[6]) for c in rows
                  if not any(better(d, c) for d in rows))
    out = table(spark, rows).groupBy("doc_id").agg(as_array()).select(
        "doc_id", F.explode(dedupe_contained(F.col("cs"))).alias("c"))
    assert sorted((r.doc_id, r.c.start, r.c.end, r.c.entity, r.c.score, r.c.ord)
                  for r in out.collect()) == want


def test_keep_spans_equal_all_pairs(spark):
    rnd = random.Random(4)
    data = []
    for _ in range(60):
        spans = [(s, s + rnd.randint(0, 9)) for s in (rnd.randint(0, 40) for _ in range(rnd.randint(0, 9)))]
        keep = [(s, s + rnd.randint(0, 12)) for s in (rnd.randint(0, 40) for _ in range(rnd.randint(0, 5)))]
        data.append((spans, keep))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame([*data, ([(0, 5)], None)], f"spans {kind}, keep {kind}")
    out = df.select("spans", "keep", drop_kept(F.col("spans"), F.col("keep")).alias("left")).collect()
    assert len(out) == 61
    for r in out:
        assert r.left == [s for s in r.spans if not any(
            s.start < k.end and s.end > k.start for k in r.keep or [])]


def test_many_nested_and_kept_spans_of_one_text(spark):
    n = 100_000
    found = spark.range(n).select(
        F.lit(0).alias("doc_id"), F.col("id").cast("int").alias("start"),
        (3 * n - F.col("id")).cast("int").alias("end"), F.lit("ID").alias("entity"),
        F.lit(0.5).alias("score"), F.lit(0).alias("ord"))
    row = found.groupBy("doc_id").agg(as_array())
    assert row.select(F.size(dedupe_contained(F.col("cs"))).alias("n")).first().n == 1
    kept = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        (i * 2).alias("start"), (i * 2 + 1).alias("end")))
    spans = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        (i * 2 + i % 2).alias("start"), (i * 2 + i % 2 + 1).alias("end")))
    left = spark.range(1).select(spans.alias("spans"), kept.alias("keep")).select(
        F.size(drop_kept(F.col("spans"), F.col("keep"))).alias("n"))
    assert left.first().n == n // 2


def test_running_totals(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("aab"), i, rnd.randint(-5, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v int")
    total = {(r.g, r.o): r.t for r in running(df, ["g"], "o", F.col("v"), "t", "sum", 16).collect()}
    best = {(r.g, r.o): r.t for r in running(df, ["g"], "o", F.col("v"), "t", "max", 16).collect()}
    place = {(r.g, r.o): r.n for r in row_number_in(df, ["g"], "o", "n", 16).collect()}
    for g in "ab":
        seen = []
        for _, o, v in sorted(r for r in rows if r[0] == g):
            assert total[g, o] == sum(seen)
            assert best[g, o] == (max(seen) if seen else None)
            seen.append(v)
            assert place[g, o] == len(seen)


def test_interval_join_and_keep(spark):
    rnd = random.Random(4)

    def spans(n):
        out = []
        for i in range(n):
            s = rnd.randint(0, 300)
            out.append((rnd.randint(0, 2), i, s, s + rnd.randint(0, 40)))
        return out

    a, b = spans(80), spans(60)
    left = spark.createDataFrame(a, "doc_id int, i int, start int, end int")
    right = spark.createDataFrame(b, "doc_id int, j int, g_start int, g_end int")
    pairs = interval_join(left, right, "doc_id", ("start", "end"), ("g_start", "g_end"), width=16)
    rows = [(r.i, r.j) for r in pairs.collect()]
    want = {
        (x[1], y[1]) for x in a for y in b
        if x[0] == y[0] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and x[3] > y[2]
    }
    assert len(rows) == len(set(rows)) and set(rows) == want

    keep = right.select("doc_id", F.col("g_start").alias("start"), F.col("g_end").alias("end"))
    left_ok = left.where("start < end")
    out = {r.i for r in keep_anti(left_ok, keep).collect()}
    assert out == {x[1] for x in a if x[2] < x[3]} - {i for i, _ in want}


def test_splice_and_cut_on_a_long_text(spark):
    text = "".join(chr(0x3041 + i % 80) if i % 3 else "😀" for i in range(30_000))
    rnd = random.Random(5)
    edits, pos = [], 0
    while pos < len(text) - 50:
        s = pos + rnd.randint(0, 30)
        e = s + rnd.randint(1, 20)
        edits.append((s, e, text[s:e]))
        pos = e
    df = spark.createDataFrame(
        [(text, edits)], "text string, edits array<struct<start:int,end:int,out:string>>"
    )
    same = df.select(splice(blocks(F.col("text")), F.length("text"), F.col("edits"))).first()[0]
    assert same == text
    points = [(0, 5), (8190, 8195), (100, 20000), (29990, 30000), (29990, 40000), (5, 5), (7, 3)]
    for s, e in points:
        v = df.select(cut(blocks(F.col("text")), F.lit(s), F.lit(e))).first()[0]
        assert v == text[s:e], (s, e)
