"""BPE, token counts, language and language-model scores on small fixtures."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from kuronuri.llm.bpe import decode_ids, encode_docs, read_vocabulary, tokenizer_of  # noqa: E402
from kuronuri.llm.language import codewords, predict_languages, train_languages  # noqa: E402
from kuronuri.llm.lm_scoring import score_documents  # noqa: E402
from kuronuri.llm.token_counts import (  # noqa: E402
    at_limits,
    encoded_lengths,
    length_histogram,
    quantile_lengths,
)

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "İSTANBUL ΑΣ ΣΑΣ ſK ﬀ", "é á̧ ́", "<|endoftext|>a<|startoftext|>",
       "<|endoftext", "株式会社ABC（以下「甲」という）", "👍🏽 👨‍👩‍👧 ½ ٣٤", "a\x1cb\x85c d e",
       "It's WE'RE 's'd'll", "x" * 5000, "aB1!" * 2000, "\x00\x07 ﻿​"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "x", [1]) for k, t in enumerate(texts)],
                                 "doc_id long, text string, decoded string, ids array<int>")


def test_encoder_equals_the_library(reference):
    tok, rnd = tokenizer_of(read_vocabulary(PATH)), random.Random(4)
    letters = "aAbeéÉinrstz ́ΣσİK　甲の😀'\"s!?12٣​<|>\n"
    texts = [t or "" for t in ODD] + [
        "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts.append(" ".join("".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(1, 25)))
                          for _ in range(5000)))
    for t in texts:
        want = reference.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(tok.encode(t), "<i4").tolist() == want, t[:60]


def test_encode_and_decode_documents(spark, reference):
    df = docs(spark, ODD)
    encoded = encode_docs(df, PATH)
    assert encoded.columns == ["doc_id", "ids"]
    out = decode_ids(encoded, PATH).collect()
    assert len(out) == len(ODD)
    for r in out:
        want = reference.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == reference.decode(want, skip_special_tokens=False)
    assert decode_ids(encode_docs(df.limit(0), PATH), PATH).collect() == []
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [tuple(r) for r in decode_ids(null, PATH).collect()] == [(1, [], "")]


def test_caches_are_bounded_and_change_nothing(reference):
    from kuronuri.llm.bpe import Tokenizer, read_vocabulary

    tok, rnd = Tokenizer(read_vocabulary(PATH)), random.Random(5)
    tok.forget(8)
    for _ in range(300):
        text = " ".join("".join(rnd.choices("abcdeé,.の", k=rnd.randint(1, 7))) for _ in range(9))
        ids = tok.encode(text)
        got = [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)]
        assert got == reference.encode(text, add_special_tokens=False).ids
        assert all(len(c) + len(c.old) <= 8 for c in (tok.by_word, tok.by_chunk, tok.bpe.fits))


def test_token_counts(spark, reference):
    texts = [*ODD, *["one two three"] * 5, *[f"word {'x y ' * k}" for k in range(30)]]
    hist = length_histogram(encoded_lengths(docs(spark, texts), PATH))
    lengths = [len(reference.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for r in hist.collect():
        n = r.n_tokens
        assert r.n_docs == lengths.count(n)
        assert r.docs_from == sum(x >= n for x in lengths)
        assert r.tokens_from == sum(x for x in lengths if x >= n)
        assert r.tokens_cut == sum(min(x, n) for x in lengths)
        assert r.share_to == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    assert hist.count() == len(set(lengths))
    limits = [0, 1, 5, 17, 100, 10**6]
    got = {r.context: (r.docs_over, r.tokens_cut) for r in at_limits(hist, limits).collect()}
    assert got == {c: (sum(x > c for x in lengths), sum(min(x, c) for x in lengths)) for c in limits}
    ranked = sorted(lengths)
    for r in quantile_lengths(hist, [0.01, 0.5, 0.9, 1.0]).collect():
        assert r.n_tokens == ranked[math.ceil(r.share * len(ranked)) - 1]
    assert length_histogram(encoded_lengths(docs(spark, []), PATH)).collect() == []


SAMPLES = {
    "en": "the of and to in is that it was for on are with as his they at be this have from".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur".split(),
    "ja": "株式会社 契約 甲 乙 締結 支払 義務 本条 定める 以下 という 場合 期間 損害".split(),
}


def test_languages(spark):
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choices(SAMPLES[lang], k=rnd.randint(5, 60))), lang)
            for k, lang in enumerate([*SAMPLES] * 60)]
    extra = [(900, None, "en"), (901, "", "en"), (902, "12 34 !! ---", "de"), (903, "the", None),
             (904, "x" * 300000, None), (905, "の" * 10, "ja"), (905, "の" * 10, "ja")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    model = train_languages(df.where("doc_id % 3 > 0 or doc_id >= 900"))
    out = predict_languages(df.withColumn("score", F.lit("clash")), model)
    got = {r.doc_id: r for r in out.collect()}
    held = [(k, lang) for k, _, lang in rows if k % 3 == 0]
    assert sum(got[k].lang_pred == lang for k, lang in held) / len(held) >= 0.97
    assert {got[k].lang_pred for k in (900, 901, 902)} == {"und"}
    assert all(got[k].score == 0 for k in (900, 901, 902))
    assert got[905].lang_pred == "ja" and got[904].lang_pred in SAMPLES
    assert all(0 <= r.score <= 1 for r in got.values()) and out.count() == len(rows) + len(extra)
    nothing = train_languages(df.limit(0))
    assert {r.lang_pred for r in predict_languages(df.limit(3), nothing).collect()} == {"und"}


def test_calibration_sample_is_bounded_however_often_a_text_is_copied(spark, monkeypatch):
    fetched = []

    def counted(self):
        out = collect(self)
        fetched.append(len(out))
        return out

    # Ten texts, a thousand copies each: a hash of the text alone would draw all or none of one.
    # One row stands a thousand times with its id.
    copies = spark.range(10_000).selectExpr(
        "id as doc_id", "concat('the of and ', id % 10) as text", "'en' as lang")
    repeated = spark.range(1_000).selectExpr("-1L as doc_id", "'the of and' as text", "'en' as lang")
    other = spark.range(200).selectExpr("id + 20000 as doc_id", "concat('der die das ', id) as text",
                                        "'de' as lang")
    df = copies.unionByName(repeated).unionByName(other)
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", counted)
    model = train_languages(df, calibration=50)
    monkeypatch.undo()
    assert max(fetched) < 2 * 50 + 60
    asked = spark.createDataFrame([(1, "der die das"), (2, "the of and")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in predict_languages(asked, model).collect()} == {1: "de", 2: "en"}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 6, 40])
def test_codewords_differ(n):
    code = codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1, 1}
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert not apart or min(apart) >= (1 if n == 2 else max(2, code.shape[1] // 5))


def test_language_model_scores(spark):
    rnd = random.Random(8)
    parts = ["an", "er", "th", "ing", "ou", "re", "st"]
    words = ["".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(1, 80))) for _ in range(150)]
    texts += [None, "", "Th TH th\x0bTH", "ÉTÉ été", "z" * 3000, texts[0], "new words é😀 here"]
    rows = [(k, t, 0, b"") for k, t in enumerate(texts)] + [(3, "same id", 0, b"")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, word binary")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    out = score_documents(df, learn).collect()
    counts = Counter()
    for k, t, *_ in rows:
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update((t or "").encode().lower().split())
            counts[b""] += 1
    total, distinct = sum(counts.values()), len(counts)
    assert len(out) == len(rows)
    by_text = {}
    for r in out:
        options = [t for k, t, *_ in rows if k == r.doc_id]
        fits = []
        for t in options:
            w = [*(t or "").encode().lower().split(), b""]
            base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
            fits.append(r.n_tokens == len(w) and r.n_known == sum(counts[x] > 0 for x in w)
                        and r.base_score == pytest.approx(base))
        assert any(fits) and r.train_tokens == total and r.score < 0 < r.bits_per_byte
        if len(options) == 1:
            assert by_text.setdefault(options[0] or "", r.score) == pytest.approx(r.score)
    held = [r for r in out if not r.learned and r.doc_id < 150]
    # Eight bits a byte without a model.
    assert sum(r.bits_per_byte for r in held) / len(held) < 3
    assert score_documents(df.limit(0), learn).collect() == []


def test_word_probabilities_are_those_of_a_code(spark):
    """All words over two letters up to some length, and those they begin: no more than one."""
    from kuronuri.llm.lm_scoring import train, word_counts, word_scores

    df = spark.createDataFrame([(1, "a b ab ba aab a a b"), (2, "abab")], "doc_id long, text string")
    counts = word_counts(df, F.lit(True))
    every = [b""] + ["".join(c).encode() for n in range(1, 5) for c in
                     __import__("itertools").product("ab", repeat=n)]
    seen = {bytes(r.word): r.n for r in counts.collect()}
    table = spark.createDataFrame([(bytearray(w), seen.get(w, 0)) for w in every], "word binary, n long")
    total = sum(10**r.log10_p for r in word_scores(table, train(counts)).collect())
    assert 0.5 < total <= 1.0
