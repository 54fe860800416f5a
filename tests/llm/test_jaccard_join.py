"""The Jaccard join against brute force: copies, near copies, chains, shared passages, odd rows."""

import random

import pytest

from kuronuri.llm import jaccard_join
from kuronuri.llm.jaccard_join import one_of_each, similar_documents
from kuronuri.llm.shingles import shingle_sets


def words_of(text):
    out = []
    for w in (text or "").replace("\t", " ").replace("\n", " ").split(" "):
        if w:
            out.append("".join(c.lower() if "A" <= c <= "Z" else c for c in w))
    return out


def set_of(text):
    w = words_of(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        r = find(k)
        least[r] = doc_id if least.get(r) is None else (
            least[r] if doc_id is None else min(least[r], doc_id))
    return sorted(
        ((d, len(sets[k]), least[find(k)]) for k, (d, _) in enumerate(rows)), key=repr)


def result(spark, rows, schema="doc_id long, text string"):
    df = spark.createDataFrame(rows, schema)
    out = similar_documents(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def corpus(seed, groups, copies, edits):
    """Near copies of base texts with a few to many edited words, and passages that many share."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    passage = [rnd.choice(vocabulary) for _ in range(55)]
    rows, doc_id = [], 0
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(60, 160))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rnd.randint(0, edits)):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                text += passage
            rows.append((doc_id, " ".join(text)))
            doc_id += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "groups", "copies", "edits"),
                         [(1, 12, 12, 6), (2, 2, 70, 5), (3, 3, 40, 12)])
def test_equals_brute_force(spark, monkeypatch, seed, groups, copies, edits):
    # So that pivots and boundaries come into play.
    monkeypatch.setattr(jaccard_join, "SHORT", 6)
    monkeypatch.setattr(jaccard_join, "GROWTH", 2)
    rows = corpus(seed, groups, copies, edits)
    assert result(spark, rows) == brute(rows)


def test_outer_set_linked_only_to_an_inner_one(spark):
    # Around a pivot of 900: one set without its last 20, and sets that also lack 95 others and have
    # 95 of their own: within the radius of the inner set, not within that of the pivot.
    rnd = random.Random(5)
    pivot = set(range(900))
    sets = {1: pivot - set(range(880, 900))}
    for k in range(8):
        sets[100 + k] = (sets[1] - set(rnd.sample(range(880), 95))
                         | {1000 * (k + 1) + i for i in range(95)})
    for k in range(70):
        sets[2 + k] = pivot - {rnd.randrange(880)} | {100_000 + k}
    around = spark.createDataFrame(
        [(0, k, 900, len(s), len(s & pivot), [*sorted(s - pivot), *sorted(pivot - s)])
         for k, s in sets.items()],
        "a long, b long, na long, nb long, shared long, differ array<long>")

    def linked(x, y):
        return 100 * len(x & y) >= 80 * len(x | y)

    assert linked(sets[1], pivot) and not any(linked(sets[100 + k], pivot) for k in range(8))
    expected = {(x, y) for x in sets for y in sets if x > y and linked(sets[x], sets[y])
                and not (linked(sets[x], pivot) and linked(sets[y], pivot))}
    assert {(100 + k, 1) for k in range(8)} <= expected
    got = jaccard_join._boundary_links(around).collect()
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in got} == expected


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "One two"), (5, "one TWO"), (6, "one two three"),
        (7, text), (7, text), (8, text.upper()), (9, text + "\x0b"), (10, text + " "),
        (None, text), (None, None), (None, "alone in the world with no id"), (11, "ÉTÉ"),
        (12, "été"), (13, "word " * 30000), (14, "word " * 29990), (15, "x" * 200000),
    ]
    assert result(spark, rows) == brute([(d, (t or "").replace("\x0b", " ")) for d, t in rows])


def test_empty_table_and_clashing_columns(spark):
    assert result(spark, []) == []
    df = spark.createDataFrame(
        [(1, "a b c d e f", 5, "k", 0)], "doc_id long, text string, n int, key string, size int")
    assert [tuple(r) for r in similar_documents(df).collect()] == [(1, 2, 1)]
    assert one_of_each(df).collect() == df.collect()


def test_one_of_each_keeps_the_least(spark):
    rows = corpus(5, 5, 8, 4) + [(900, None), (901, ""), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted({c for d, n, c in brute(rows) if n} | set()) + [900, 900, 901]
    assert sorted(r.doc_id for r in one_of_each(df).collect()) == want


def test_shingle_sets_cut_long_texts_at_blanks(monkeypatch):
    from kuronuri.llm import shingles

    texts = [b"a b c d e f g h " * 50, b"", b"x y", b"q" * 500 + b" r s t u v"]
    whole = [a.tolist() for a in shingle_sets(texts)]
    monkeypatch.setattr(shingles, "PIECE", 16)
    assert [a.tolist() for a in shingle_sets(texts)] == whole
