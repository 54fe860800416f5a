"""Outputs committed by run, and clicks of reviewers as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from kuronuri import Policy, mask
from kuronuri.operators import review
from kuronuri.sources import runs, sinks
from kuronuri.streaming.review_stream import action_stream, read_clicks, write_clicks

FAST = Policy(force_fast=True)


def masked(spark, *texts):
    rows = [(f"d{k}.txt", t) for k, t in enumerate(texts)]
    return mask(spark.createDataFrame(rows, "doc_id string, text string"), FAST)


def test_outputs_appear_once_a_run(spark, tmp_path, monkeypatch):
    path = str(tmp_path)
    assert runs.read_run(spark, path, "audit").count() == 0
    runs.write_run(masked(spark, "a@example.com", None, "x\n, \"q\" b@example.com"), path, "1e5", policy=FAST)
    first = runs.read_run(spark, path, "audit")
    assert sorted((r.doc_id, r.total_hits, r.run) for r in first.collect()) == [
        ("d0.txt", 1, "1e5"), ("d1.txt", 0, "1e5"), ("d2.txt", 1, "1e5")]
    # Repeated, with other rows: they take the place of the first ones in every output.
    runs.write_run(masked(spark, "c@example.com"), path, "1e5", policy=FAST)
    for name in ("masked", "payload", "html", "audit"):
        assert [(r.doc_id, r.run) for r in runs.read_run(spark, path, name).collect()] == [("d0.txt", "1e5")]
    assert [(r.original, r.run) for r in runs.read_run(spark, path, "hits").collect()] == [
        ("c@example.com", "1e5")]
    # Another run that fails behind its first outputs shows in none of them; repeated, it does.
    with monkeypatch.context() as m:
        def broken(*_):
            raise OSError("lost")

        m.setattr(sinks, "write_audit", broken)
        with pytest.raises(OSError):
            runs.write_run(masked(spark, "d@example.com"), path, "02", policy=FAST)
    for name in runs.OUTPUTS:
        assert {r.run for r in runs.read_run(spark, path, name).collect()} == {"1e5"}
    runs.write_run(masked(spark, "d@example.com", "e"), path, "02", ["audit", "masked"])
    assert sorted((r.doc_id, r.run) for r in runs.read_run(spark, path, "audit").collect()) == [
        ("d0.txt", "02"), ("d0.txt", "1e5"), ("d1.txt", "02")]
    assert {r.run for r in runs.read_run(spark, path, "html").collect()} == {"1e5"}


def test_runs_of_nothing_and_wrong_names(spark, tmp_path):
    runs.write_run(masked(spark, "x").limit(0), str(tmp_path), "empty")
    for name in runs.OUTPUTS:
        assert runs.read_run(spark, str(tmp_path), name).count() == 0
    assert [r.run for r in runs.committed(spark, str(tmp_path)).collect()] == ["empty"]
    for wrong in ("", "a/b", "../x", "a=b"):
        with pytest.raises(ValueError):
            runs.write_run(masked(spark, "x"), str(tmp_path), wrong)
    with pytest.raises(ValueError):
        runs.write_run(masked(spark, "x"), str(tmp_path), "r", ["mask"])


@pytest.mark.parametrize("seed", [1, 2])
def test_clicks_in_any_order_with_restarts(spark, tmp_path, seed):
    rnd = random.Random(seed)
    ops = ("KEEP_ONCE", "MASK_ONCE", "ALWAYS_KEEP")
    clicks = [(f"d{rnd.randint(0, 3)}", f"s{rnd.randint(0, 4)}", k, rnd.choice(ops)) for k in range(60)]
    schema = "doc_id string, span_id string, seq bigint, op string"
    late = clicks + rnd.sample(clicks, 20)
    rnd.shuffle(late)
    folder, state, checkpoint = (str(tmp_path / x) for x in ("in", "state", "checkpoint"))
    assert read_clicks(spark, state).count() == 0
    for at in range(0, len(late), 27):  # the stream ends and is started again with every delivery
        spark.createDataFrame(late[at : at + 27], schema).repartition(2).write.mode("append").parquet(folder)
        write_clicks(action_stream(spark, folder, max_files=1), state, checkpoint).awaitTermination()
        seen = spark.createDataFrame(late[: at + 27], schema)
        want = sorted(map(tuple, review.last_clicks(seen).collect()))
        assert sorted(map(tuple, read_clicks(spark, state).collect())) == want
    by_hand = {}
    for d, s, k, op in sorted(clicks, key=lambda c: c[2]):
        if op != "ALWAYS_KEEP":
            forced = by_hand.get((d, s), (0, 0, False))[2] or op == "MASK_ONCE"
            by_hand[d, s] = (k, op, forced)
    assert {(r.doc_id, r.span_id): (r.last_seq, r.last_op, r.forced)
            for r in read_clicks(spark, state).collect()} == by_hand


def test_clicks_with_nulls_and_ties(spark):
    rows = [("d", "s", None, "MASK_ONCE"), ("d", "s", 1, "KEEP_ONCE"), ("d", "t", 2, "MASK_ONCE"),
            ("d", "t", 2, "KEEP_ONCE"), ("d", "u", 3, None), ("d", "v", None, "KEEP_ONCE")]
    acts = spark.createDataFrame(rows, "doc_id string, span_id string, seq bigint, op string")
    got = {r.span_id: (r.last_op, r.forced) for r in review.last_clicks(acts).collect()}
    assert got == {"s": ("KEEP_ONCE", True), "t": ("MASK_ONCE", True), "v": ("KEEP_ONCE", False)}
    dets = spark.createDataFrame([("d", "s"), ("d", "w")], "doc_id string, span_id string").withColumns(
        {"enabled": F.lit(True), "source": F.lit("analyzer")})
    out = {r.span_id: (r.enabled, r.source) for r in review.apply_once(dets, acts).collect()}
    assert out == {"s": (False, "forced"), "w": (True, "analyzer")}
