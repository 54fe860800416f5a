"""Decontamination, Merkle manifest and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kuronuri.llm import merkle
from kuronuri.llm.decontaminate import decontaminate, find_contamination
from kuronuri.llm.importance import resample
from kuronuri.llm.merkle import manifest
from kuronuri.llm.positions import in_order
from kuronuri.operators.report import hits_table
from kuronuri.plans.masking import mask
from kuronuri.policy import Policy

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(WORD, low)


# Decontamination ----------------------------------------------------------------------------------

def found_in(docs, items, n):
    windows = {}
    for item, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - n + 1) if ws else 0):
            windows.setdefault(tuple(ws[i:i + n]), set()).add(item or "")
    out = []
    for doc, text in docs:
        ws, hit, got = words(text), set(), set()
        for i in range(len(ws)):
            for k in range(1, n + 1):
                if i + k <= len(ws) and tuple(ws[i:i + k]) in windows:
                    hit |= set(range(i, i + k))
                    got |= windows[tuple(ws[i:i + k])]
        out.append((doc, len(ws), len(hit), tuple(sorted(got))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def contracts():
    rng = random.Random(3)
    vocabulary = ["甲", "乙", "Pay", "the", "fee", "of", "株式会社", "term", "x1"]
    items = [(f"q{i}", " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 4, 6, 9])))) for i in range(12)]
    items += [("q1", "term term term term the"), ("q90", items[5][1]), (None, "fee of term x1 fee of")]
    docs = [(f"c{i}", " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30, 80])))) for i in range(30)]
    docs += [("c3", docs[3][1]), ("c3", "the fee"), (None, items[5][1] + "!\n"), ("long", "fee " * 20000), ("n", None), ("e", "")]
    return docs, items


@pytest.mark.parametrize("n,in_round", [(5, 200_000), (4, 7)])
def test_contamination_equals_brute_force(spark, contracts, n, in_round):
    docs, items = contracts
    d = spark.createDataFrame([(*r, "q", 1) for r in docs], "doc_id string, text string, item_id string, window int")
    b = spark.createDataFrame(items, "item_id string, text string")
    rows = find_contamination(d, b, n, in_round).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows), key=str)
    assert got == found_in(docs, items, n)
    for r in rows:
        assert sum(s.last - s.first + 1 for s in r.spans) == r.n_hit


def test_contaminated_passages_are_removed(spark):
    docs = [("a", "Intro: the secret item is here, done."), ("b", "nothing"), ("c", "Secret ITEM is"), ("d", None)]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(docs)], "doc_id string, text string, n_hit int")
    b = spark.createDataFrame([("i", "secret item is")], "item_id string, text string")
    clean = {r.doc_id: (r.text, r.n_hit) for r in decontaminate(d, b, "n_hit").collect()}
    assert clean == {"a": ("Intro: the  here, done.", 0), "b": ("nothing", 1), "c": ("", 2), "d": (None, 3)}
    assert {r.doc_id for r in decontaminate(d, b, drop_share=0.0).collect()} == {"b", "d"}


def test_nothing_to_find(spark):
    d = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in find_contamination(d, b).collect()] == [(2, 0, [])]
    assert find_contamination(d.limit(0), b).collect() == []


# Merkle manifest ----------------------------------------------------------------------------------

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(level, at):
    """Root of a list of digests, and the siblings of one of them with their sides."""
    path = []
    while len(level) > 1:
        if at ^ 1 < len(level):
            path.append((at & 1, level[at ^ 1]))
        else:
            path.append((0, ""))
        level = [sha(*level[i:i + 2]) for i in range(0, len(level), 2)]
        at //= 2
    return level[0], path


def manifest_of(rows, changed):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0], leaf(r)))
    tops = [climb([leaf(r) for r in groups[g]], 0)[0] for g in names]
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            subroot, path = climb([leaf(x) for x in groups[g]], i)
            root, above = climb(tops, k)
            now = leaf(changed(r))
            for side, s in path + above:
                now = sha(s, now) if side else sha(now, s)
            out.append((r[0], g, leaf(r), subroot, root, sha(*[s for _, s in path + above]), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("stride,part_bits", [(8, 16), (2, 3), (1, 2)])
def test_manifest_equals_brute_force(spark, monkeypatch, stride, part_bits):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    monkeypatch.setattr(merkle, "PART_BITS", part_bits)
    rng = random.Random(5)
    sizes = {"ja": 37, "en": 1, None: 9, "": 2, "é": 16, "z": 3}
    rows = [(i, g, rng.choice([None, "", "語" * 40, f"t{i}"]), rng.choice([None, i])) for i, g in
            enumerate(g for g, n in sizes.items() for _ in range(n))]
    rows += [rows[0]] * 5 + [(rows[1][0], *rows[2][1:])]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, lang string, text string, n_chars long, leaf string, pos int")
    got = manifest(
        df, ("doc_id", "lang", "text", "n_chars"), "lang", ("doc_id",), keep=("doc_id",),
        now={"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    want = manifest_of(rows, lambda r: (*r[:3], None if r[3] is None else r[3] + (r[0] % 3 == 0)))
    got = sorted(((r.doc_id, r.lang, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect()), key=str)
    assert got == want


def test_manifest_of_hits(spark):
    docs = spark.createDataFrame(
        [(f"c{i}", f"連絡先 a{i}@x.jp 電話 03-1234-567{i} まで") for i in range(9)], "doc_id string, text string")
    hits = hits_table(mask(docs, Policy(force_fast=True)))
    whole = manifest(hits, keep=("start",)).collect()
    assert len(whole) == hits.count() and all(r.verified for r in whole)
    assert len({r.subroot for r in whole}) == 9 and len({r.root for r in whole}) == 1
    forged = manifest(hits, keep=("start",), now={"reason": F.when(F.col("doc_id") == "c4", F.lit("keep:allowlist")).otherwise(F.col("reason"))})
    assert {r.doc_id for r in forged.collect() if not r.verified} == {"c4"}


def test_manifest_of_nothing_and_of_one(spark):
    one = spark.createDataFrame([("c", None)], "doc_id string, text string")
    r = manifest(one, ("doc_id", "text"), "doc_id", ("text",)).first()
    assert r.leaf == r.subroot == r.root == r.folded_root and r.proof_sha256 == sha() and r.verified
    assert manifest(one.limit(0), ("doc_id", "text"), "doc_id", ("text",)).collect() == []


def test_positions_of_equal_rows(spark):
    df = spark.range(5000).select((F.col("id") * 0).alias("k"))
    out = in_order(df, [F.col("k")], "at")
    assert sorted(r.at for r in out.collect()) == list(range(5000))


# Importance resampling ----------------------------------------------------------------------------

def features(text, n):
    ws = words(text)
    return [" ".join(ws[i:i + k]) for k in range(1, n + 1) for i in range(len(ws) - k + 1)]


def draw(docs, target, n, buckets, percent, least, seed):
    def counts(texts):
        c = {}
        for t in texts:
            for f in features(t, n):
                b = zlib.crc32(f.encode()) % buckets
                c[b] = c.get(b, 0) + 1
        return c, sum(c.values())

    (s, all_s), (t, all_t) = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t.get(b, 0) + 1) * (all_s + buckets) / ((s.get(b, 0) + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for d, x in docs:
        fs = features(x, n)
        w = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(x)) >= least])
    ranked = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or ""))
    top = {id(r): i + 1 for i, r in enumerate(ranked[:len(ranked) * percent // 100])}
    return sorted(((*r[:4], top.get(id(r))) for r in rows), key=str)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_draw_equals_brute_force(spark, n):
    rng = random.Random(n)
    vocabulary = ["甲", "Fee", "term", "a", "株式会社", "No1"]
    lines = ["", "甲 乙", "a", "term, term", " ".join(rng.choices(vocabulary, k=9))] + [
        " ".join(rng.choices(vocabulary, k=4)) for _ in range(4)]
    docs = [(f"c{i}", "\n".join(rng.choices(lines, k=rng.choice([1, 3, 12])))) for i in range(60)]
    docs += [("n", None), ("e", ""), (None, "\n".join(lines)), ("r", "a\nb"), ("r", "a\nb"), ("long", "fee term\n" * 9000 + "x " * 9000)]
    target = ["term fee\n株式会社 甲", None, "a a a"]
    df = spark.createDataFrame([(*d, "k", 1) for d in docs], "doc_id string, text string, key string, occurrences int")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    rows = resample(df, t, n, 50, 25, 5, 11).collect()
    assert sorted((tuple(r) for r in rows), key=str) == draw(docs, target, n, 50, 25, 5, 11)


def test_draw_from_nothing(spark):
    df = spark.createDataFrame([("a", "x " * 30)], "doc_id string, text string")
    assert resample(df.limit(0), df).collect() == []
    assert [(r.n_features, r["rank"]) for r in resample(df, df.limit(0), percent=100).collect()] == [(30, 1)]
