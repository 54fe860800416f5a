"""Personal data, mixing, quality rules, fingerprints and licences on small fixtures."""

import hashlib
import re
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kuronuri.llm import licenses, spotsigs
from kuronuri.llm.licenses import scan_licenses
from kuronuri.llm.mixing import mix_sources, mixed_documents
from kuronuri.llm.pii import find_pii, mask_pii
from kuronuri.llm.quality import clean_lines
from kuronuri.llm.spotsigs import edited_pairs, fingerprints, similar_pairs

DOCS = "doc_id long, text string, hits string, n int, size int, file string, key string"


def docs(spark, texts):
    """Rows with columns whose names operators use themselves."""
    return spark.createDataFrame(
        [(k, t, "x", 1, 2, "y", "z") for k, t in texts], DOCS)


# Personal data -----------------------------------------------------------------------------------

PLAIN = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "IP": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "CARD": r"[0-9]([\x20-]?[0-9])+",
    "PHONE": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed([int(c) for c in digits])):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def brute_pii(text):
    out = []
    for kind, rx in PLAIN.items():
        for m in re.finditer(rx, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "IP" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "CARD" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "PHONE" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), list(PLAIN).index(kind), m.end(), kind))
    return sorted(out)


TEXTS = [
    None, "", "no data", "mail a@b.c.d_e@f.gg, x@y@z.org a@b..c a.b@c-d.e.",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112",
    "+1 (555) 123-4567 +49 30 1234567890123456 +1) 5", "😀 a@b.cd 甲乙 +81-3-1234-5678 😀10.0.0.1",
    "a" * 50000, "1" * 40000, "a@" + "b." * 30000 + "c", "+1" + " " * 30000, "9 " * 20000,
    "same@x.yz " * 3000,
]


def test_base_spans_equal_the_plain_patterns(spark):
    rows = find_pii(docs(spark, enumerate(TEXTS)))
    assert rows.columns == ["doc_id", "text", "hits"]
    for r in rows.collect():
        got = [(h.start, h.ord, h.end, h.entity_type) for h in r.hits if h.ord < 4]
        assert got == brute_pii(TEXTS[r.doc_id]), r.doc_id
        assert all(r.text[h.start : h.end] == h.original for h in r.hits)


def test_checksums_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "DE89370400440532013001", "マイナンバー 123456789018",
             "番号 123456789018", "123456789019 my number", "GB82 WEST 1234 5698 7654 32",
             "phone: +1 555 123 4567", "+1 555 123 4567"]
    hits = {r.doc_id: [(h.entity_type, h.score) for h in r.hits]
            for r in find_pii(docs(spark, enumerate(texts))).collect()}
    kinds = {k: [x[0] for x in v] for k, v in hits.items()}
    assert kinds[0] == ["IBAN"] and kinds[1] == [] and kinds[2] == ["MY_NUMBER"]
    assert kinds[3] == [] and kinds[4] == [] and kinds[5] == ["IBAN"]
    assert hits[6][0][1] == 1.0 and hits[7][0][1] == 0.7


def test_masked_text_has_no_personal_data(spark):
    df = docs(spark, enumerate([*TEXTS, "x +1 1.2.3.4 55 5 y a@b.cd"]))
    out = mask_pii(df, keep=("size",))
    assert out.columns == ["doc_id", "text", "size", "hits"]
    for r in out.collect():
        if r.doc_id == 0:
            assert r.text is None
        else:
            assert brute_pii(r.text) == [], r.text[:80]
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[2] == "no data" and texts[3].startswith("mail [EMAIL][EMAIL], ")
    assert find_pii(docs(spark, [])).count() == 0


# Mixing ------------------------------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), share=1.5, epochs=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(names)}
    total, fixed = sum(sizes.values()) * share, {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        unit = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > epochs * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * unit for s in free}
        fixed |= {s: epochs * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rows, sizes = [], defaultdict(int)
    for k in range(400):
        source = [None, "a", "B", "é", "hot", "", "zz"][k % 7 if k < 200 else 4]
        n = (k * 37) % 23 if k % 50 else 3000
        rows.append((k, None if k == 5 else "word " * n, source))
        sizes[source] += 0 if k == 5 else n
    df = spark.createDataFrame(rows + [rows[9]], "doc_id long, text string, source string")
    sizes[rows[9][2]] += len(rows[9][1].split())
    out = mix_sources(df).collect()
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in out:
        words = r.repeats * r.size + r.part
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert words <= 2 * r.size
        taken[r.source] += words
    assert len(out) == 401
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    assert sorted(map(tuple, mix_sources(df.repartition(7)).collect()), key=repr) == sorted(
        map(tuple, out), key=repr)
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns
    got = {r.source: r.n for r in mixed.groupBy("source").agg(
        F.sum(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).alias("n")).collect()}
    assert {s: got.get(s, 0) for s in taken} == dict(taken)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(df).collect() == []
    df = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.repeats, r.part) for r in mix_sources(df).collect()} == {(0, 0.0, 0, 0)}


# Quality -----------------------------------------------------------------------------------------

def brute_counts(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = defaultdict(list)
    for i in range(len(words) - 2):
        where[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_verdict(spark):
    good = " ".join(f"word{k}" for k in range(60)) + "."
    texts = [None, "", "a b", good, good + "\n" + good, "a b c a b c a b c d", "x y z " * 40,
             "menu | home | about | news | shop\n" * 3 + good, (good.upper() + "!! ") * 1,
             " ".join(f"w{k}***" for k in range(80)), "a\x0bb\x0cc \t\n\n a\n a\n", "甲 は 乙 に。" * 30,
             "w " * 30000, " ".join(f"u{k}" for k in range(30000)) + ".", good + "\ncookie policy"]
    out = clean_lines(docs(spark, enumerate(texts)))
    for r in out.collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == brute_counts(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id for r in out.collect() if r.kept}
    assert kept == {3, 7, 13, 14}
    assert {r.cleaned for r in out.collect() if r.doc_id in (3, 7)} == {good}


# Fingerprints ------------------------------------------------------------------------------------

def brute_signatures(text):
    low = re.sub(r"([一-鿿゠-ヿ])([ぁ-ゟ])", r"\1 \2", (text or "").lower())
    low = re.sub(r"([ぁ-ゟ])([一-鿿゠-ヿ])", r"\1 \2", low)
    words = re.sub(r"[\W_]+", " ", low).split()
    out = set()
    for i, w in enumerate(words):
        if w in spotsigs.ANCHORS:
            chain = [x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][:2]
            if len(chain) == 2:
                out.add(f"{w} {chain[0]} {chain[1]} ")
    if not out and words:
        out = {" " + " ".join(words) + " "}
    return sorted(hashlib.md5(s.encode()).hexdigest()[:8] for s in out)


def test_fingerprints_and_edited_texts(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "STRETCH", 3)
    texts = [None, "The cat of the house is on a mat at night in May", "", "short", "😀 the 😀 end",
             "株式会社の契約は甲が乙に支払う", "the " * 3000, "the dog and the quick fox " * 500, "der Hund und die Katze im Haus",
             "same the old text here", "same the old text here"]
    ids = [7, 3, 20, 1, 15, 9, 2, 40, 33, 50, 51]
    rows = sorted(zip(ids, texts, strict=True))
    out = {r.doc_id: r for r in edited_pairs(docs(spark, rows)).collect()}
    for k, (i, t) in enumerate(rows):
        t, follower = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follower[:half]
        r = out[i]
        assert r.n_chars == len(t) and r.edited == edited
        a, b, c = (set(brute_signatures(x)) for x in (t, edited, follower))
        assert r.fingerprint == brute_signatures(t)
        for got, other in ((r.near_edited, b), (r.near_next, c)):
            want = len(a & other) / len(a | other) if a | other else 1.0
            assert got == pytest.approx(want)
    assert edited_pairs(docs(spark, [])).collect() == []
    assert [r.next_text for r in spotsigs.followed(docs(spark, [(None, "x")])).collect()] == ["x"]


def test_similar_pairs_equal_brute_force(spark):
    base = [f"the n{k} v{k} of x{k} y{k}" for k in range(40)]
    texts = [" ".join(base[:n] + [f"the z{j} q{j}" for j in range(m)]) for n in (10, 20, 39, 40)
             for m in range(4)]
    prints = fingerprints(docs(spark, enumerate(texts + texts[:2])))
    sets = [set(brute_signatures(t)) for t in texts]
    want = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for b in sets[:i])
    got = similar_pairs(prints).collect()
    assert len(got) == want and all(r.near >= 0.8 for r in got)


# Licences ----------------------------------------------------------------------------------------

def test_licences_and_inheritance(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    files = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.py", "code"),
        (3, "a/b/c/y.py", "more code"), (4, "a/b/LICENSE.txt", apache), (5, "a/b/z.py", None),
        (6, "a/b/own.py", f"# header\n{apache}\ncode"), (7, "top.py", "code"), (8, None, "code"),
        (9, "ab/x.py", "no licence of that kind at all, only talk of copyright in general"),
        (9, "ab/x.py", "no licence of that kind at all, only talk of copyright in general"),
        (10, "a/bb/x.py", ""), (None, "a/b/n.py", ""), (11, "p/LICENSE", "lorem ipsum"),
        (12, "p/q.py", ""), (13, "long.txt", "w " * 50000 + apache + " w" * 50000),
    ]
    df = spark.createDataFrame([(*f, 0, "k") for f in files],
                               "doc_id long, path string, text string, n int, license string")
    out = scan_licenses(df)
    got = {(r.doc_id, r.path): (r.license, r.inherited_from) for r in out.collect()}
    assert out.count() == len(files)
    assert got[1, "a/LICENSE"] == ("MIT", None) and got[2, "a/x.py"] == ("MIT", "a")
    assert got[3, "a/b/c/y.py"] == ("Apache-2.0", "a/b") and got[5, "a/b/z.py"] == ("Apache-2.0", "a/b")
    assert got[6, "a/b/own.py"] == ("Apache-2.0", None) and got[7, "top.py"] == (None, None)
    assert got[8, None] == (None, None) and got[9, "ab/x.py"] == (None, None)
    assert got[10, "a/bb/x.py"] == ("MIT", "a") and got[None, "a/b/n.py"] == ("Apache-2.0", "a/b")
    assert got[12, "p/q.py"] == (None, None) and got[13, "long.txt"] == ("Apache-2.0", None)
    assert scan_licenses(df.limit(0)).collect() == []


def test_whole_licence_texts_and_wrapped_headers(spark):
    def text(name):
        return (Path(licenses.__file__).parent / "licence_texts" / f"{name}.txt").read_text()

    names = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1",
             "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0"]
    rows = []
    for k, name in enumerate(names):
        changed = text(name).replace("COPYRIGHT HOLDERS", "AUTHORS")
        rows += [(k, f"p{k}/LICENSE", "Copyright (c) 2019 Some Body\n\n" + changed),
                 (100 + k, f"p{k}/a/b.py", "import os")]
    apache = ('# Copyright 2020 Some Body\n#\n# Licensed under the Apache License, Version 2.0 (the\n'
              '# "License"); you may not use this file except in compliance\n# with the License.\n')
    gpl = ("/*\n * This program is free software: you can redistribute it\n * and/or modify it under the "
           "terms of the GNU\n * {}General Public License as published by the Free\n * Software "
           "Foundation, either version {} of the License,\n * or (at your option) any later version.\n */")
    rows += [(200, "q/a.py", apache), (201, "q/a.c", gpl.format("", 3)), (202, "q/b.c", gpl.format("", 2)),
             (203, "q/c.c", gpl.format("Affero ", 3)), (204, "q/d.c", gpl.format("Lesser ", 3)),
             (205, "q/e.txt", "we ask\nfor permission to see the\ncopyright office of the town")]
    got = {r.doc_id: r.license for r in scan_licenses(
        spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    expected = {k: n for k, n in enumerate(names)} | {100 + k: n for k, n in enumerate(names)}
    assert got == expected | {200: "Apache-2.0", 201: "GPL-3.0", 202: "GPL-2.0", 203: "AGPL-3.0",
                              204: "LGPL-3.0", 205: None}


def test_followed_takes_ids_of_any_type(spark):
    rows = [(f"c{i:02d}", f"text {i}") for i in range(7)] + [("c03", "text 3"), (None, "b"), (None, "a"), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for stretch in (2, 3, 2000):
        was, spotsigs.STRETCH = spotsigs.STRETCH, stretch
        try:
            out = [tuple(r) for r in spotsigs.followed(df, F.upper).select(
                "doc_id", "text", "mark", "next_text", "next_mark").collect()]
        finally:
            spotsigs.STRETCH = was
        assert sorted((r[:2] for r in out), key=str) == sorted(rows, key=str)
        assert all(r[2] == r[1].upper() and r[4] == r[3].upper() for r in out)
        follow = {r[1]: {x[3] for x in out if x[1] == r[1]} for r in out}
        assert follow["text 2"] == {"text 3"} and follow["text 3"] == {"text 3", "text 4"}
        assert follow["text 6"] <= {"a", "b"} and sorted(r[3] for r in out) == sorted(r[1] for r in rows)
    pairs = spotsigs.edited_pairs(df)
    assert pairs.count() == len(rows)


def test_licence_query_inherits_and_equals_its_sql(spark, tmp_path):
    """Documents without a licence of their own get the one of their language folder."""
    import duckdb

    from kuronuri.llm.op1_query import ORACLE, op1_licenses

    rows = [
        (1, "Released under the MIT License.", "en", "a"), (2, "plain words", "en", "a"),
        (203, None, "en", "a"), (4, "other folder", "de", "a"),
        (5, "w " * 200 + "\nLicensed under the Apache License, Version 2.0.", "en", "a"),
        (6, "w " * 200, "de", "a"), (7, "no source", None, None),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[2:] for r in op1_licenses(spark, str(tmp_path)).collect()}
    assert got[2] == got[203] == ("MIT", None, "a/en") and got[4] == got[6] == (None, None, None)
    assert got[1][::2] == ("MIT", None) and got[5][::2] == ("Apache-2.0", None)
    con = duckdb.connect()
    con.execute(f"create view documents as from '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: tuple(r)[2:] for r in con.execute(ORACLE).fetchall()} == got
