"""Language of documents by error-correcting output codes.

Every language has a codeword; one binary classifier over hashed letter n-grams predicts each bit
of it, and the codeword with the least weighted loss wins.  Works on the library's documents
``docs(doc_id, text)``; labelled documents also have ``lang``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri.llm import blocks
from kuronuri.llm.tables import docs_of

#: Lengths of n-grams, in bytes of the lower-cased text, and hashed features of each length.
ORDERS, FEATURES = (2, 3, 4), 1 << 15
#: Codewords for more languages than this are random, of this many bits per doubling.
EXHAUSTIVE, BITS_PER_DOUBLING = 5, 10
#: Labelled documents per language on which slopes and weights of the bits are fitted, about.
CALIBRATION = 1000
#: Below this lead of the best codeword over the second, a text is ambiguous.
MIN_LEAD = 0.2
#: Bytes worked on at once.
PIECE = 1 << 19
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_GAP = len(ORDERS)  # zero bytes between texts, so that no n-gram meets two of them


def _letters() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    for c in range(26):
        out[97 + c] = out[65 + c] = 97 + c
    return out


_LOWER = _letters()
_MIX = np.uint32(2654435761)


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order, their codewords (+1 or -1), n-gram weights, slopes and bit weights."""

    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    slope: np.ndarray
    trust: np.ndarray


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """``n`` rows of +1 and -1 that differ in many places.

    Few languages get every split of them into two sets, more get the best of some random codes.
    """
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= EXHAUSTIVE:
        splits = [[1 if (s >> k) & 1 else -1 for k in range(n)] for s in range(1, 1 << (n - 1))]
        return np.array(splits, np.int8).T
    bits, rng, best = int(np.ceil(BITS_PER_DOUBLING * np.log2(n))), np.random.default_rng(seed), None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = (bits - code.astype(int) @ code.T.astype(int)) // 2 + bits * np.eye(n, dtype=int)
        split = np.abs(code.sum(0)) < n
        if split.all() and (best is None or apart.min() > best[0]):
            best = (apart.min(), code)
    if best is None:
        raise ValueError("no code found: raise BITS_PER_DOUBLING")
    return best[1]


def _pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """``(text number, done?, bytes)`` pieces of at most :data:`PIECE` bytes; n-grams span cuts."""
    for k, t in enumerate(texts):
        at = 0
        while True:
            yield k, at, t[at : at + PIECE + max(ORDERS) - 1]
            at += PIECE
            if at >= len(t):
                break


def _grams(joined: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Start places and features of all n-grams of texts set apart by zero bytes."""
    wide = joined.astype(np.uint32)
    for j, n in enumerate(ORDERS):
        if len(wide) < n:
            continue
        h = np.zeros(len(wide) - n + 1, np.uint32)
        for i in range(n):
            h = h * np.uint32(257) + wide[i : len(wide) - n + 1 + i]
        inside = np.flatnonzero((joined[: len(h)] != 0) & (joined[n - 1 :] != 0))
        h = (h[inside] * _MIX) >> np.uint32(32 - FEATURES.bit_length() + 1)
        yield inside, h.astype(np.int64) + j * FEATURES


def _groups(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Pieces put together to about :data:`PIECE` bytes: text numbers, starts, joined bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def join() -> tuple[list[int], np.ndarray, np.ndarray]:
        parts, starts, at = [], [], 0
        for _, offset, data in held:
            part = _LOWER[np.frombuffer(data, np.uint8)]
            if offset == 0:
                part = np.concatenate([np.array([32], np.uint8), part, np.array([32], np.uint8)])
            if len(part) > 1:
                part = part[np.concatenate([[True], (part[1:] != 32) | (part[:-1] != 32)])]
            starts.append(at)
            parts += [part, np.zeros(_GAP, np.uint8)]
            at += len(part) + _GAP
        return [h[0] for h in held], np.array(starts), np.concatenate(parts)

    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[2])
        if size >= PIECE:
            yield join()
            held, size = [], 0
    if held:
        yield join()


def _bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _decisions(texts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of n-gram weights per text and bit, and the numbers of n-grams."""
    total, n = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for owner, starts, joined in _groups(texts):
        part = np.zeros((len(starts), weights.shape[1]))
        count = np.zeros(len(starts))
        for inside, h in _grams(joined):
            if not len(h):
                continue
            cuts = np.searchsorted(inside, starts)
            ends = np.append(cuts[1:], len(h))
            full = ends > cuts
            part[full] += np.add.reduceat(weights[h], cuts[full], axis=0, dtype=np.float64)
            count += ends - cuts
        np.add.at(total, owner, part)
        np.add.at(n, owner, count)
    return total, n


def _stretch(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return total / np.sqrt(np.maximum(n, 1.0))[:, None]


def _fit_slope(x: np.ndarray, sign: np.ndarray) -> float:
    """One-parameter logistic regression, Newton steps, slightly held back."""
    w = 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(-sign * x * w, -50, 50)))
        gradient = np.sum((1 - p) * sign * x) - 0.01 * w
        w += gradient / (np.sum(p * (1 - p) * x * x) + 0.01)
    return max(float(w), 1e-3)


def train_languages(labelled: DataFrame, calibration: int = CALIBRATION) -> LanguageModel:
    """Fit on ``doc_id, text, lang``; rows without a language or text are left out.

    N-gram counts per language come from all rows; only slopes and weights of the bits are fitted on
    a sample of about ``calibration`` documents per language, drawn by a hash of id and text, so that
    copies of one text are drawn one by one.  What comes to the driver is bounded by the number of
    languages, features and ``calibration``; rows that repeat id and text too count as one there.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text", "doc_id")
    known = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(known))
    number = {lang: k for k, lang in enumerate(languages)}
    code = codewords(len(languages))
    size = len(ORDERS) * FEATURES
    if not languages:
        return LanguageModel((), code, np.zeros((size, 1), np.float32), np.ones(1), np.ones(1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(number), size), np.int64)
        for batch in batches:
            owner = np.array([number[x] for x in batch.column(0).to_pylist()])
            texts = _bytes(batch.column(1))
            for k in np.unique(owner):
                mine = [t for t, o in zip(texts, owner, strict=True) if o == k]
                for _, _, joined in _groups(mine):
                    for _, h in _grams(joined):
                        counts[k] += np.bincount(h, minlength=size)
        yield from blocks.send(counts.reshape(-1))

    counts = blocks.gathered(rows.mapInArrow(count, blocks.SCHEMA), len(languages) * size)
    counts = counts.reshape(len(languages), len(ORDERS), FEATURES).astype(np.float64)
    rates = (counts + 0.5) / (counts.sum(2, keepdims=True) + 0.5 * FEATURES)
    weights = np.zeros((len(ORDERS), FEATURES, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        one, zero = code[:, b] > 0, code[:, b] < 0
        if zero.any() and one.any():
            # Languages count alike, whatever their number of documents.
            weights[:, :, b] = np.log(rates[one].mean(0)) - np.log(rates[zero].mean(0))
    weights = weights.reshape(size, -1)

    share = F.lit(False)
    for lang, n in known.items():
        keep = min(1.0, calibration / n)
        share = share | ((F.col("lang") == lang)
                         & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(keep * (1 << 30))))
    shared = labelled.sparkSession.sparkContext.broadcast(weights)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stretch(*_decisions(_bytes(batch.column(1)), shared.value))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64()))], ["lang", "x"])

    drawn = rows.where(share).distinct().select("lang", "text")
    seen = sorted(drawn.mapInArrow(decide, "lang string, x array<double>").collect())
    slope, trust = np.ones(code.shape[1]), np.ones(code.shape[1])
    if seen:
        x = np.array([r.x for r in seen])
        rank = np.array([number[r.lang] for r in seen])
        for b in range(code.shape[1]):
            sign = code[rank, b].astype(float)
            slope[b] = _fit_slope(x[:, b], sign)
            right = (np.sum(sign * x[:, b] > 0) + 1) / (len(seen) + 2)
            trust[b] = max(np.log(right / (1 - right)), 0.01)
    shared.unpersist()
    return LanguageModel(languages, code, weights, slope, trust / trust.mean())


def _choose(x: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its share and its lead over the second, by weighted logistic loss."""
    z = x * model.slope
    # Loss of each text and codeword, bits weighted by how far their classifier can be trusted.
    loss = sum(
        model.trust[b] * np.logaddexp(0, -np.outer(z[:, b], model.code[:, b]))
        for b in range(model.code.shape[1])
    )
    like = np.exp(np.clip(-(loss - loss.min(1, keepdims=True)), -700, 0))
    like /= like.sum(1, keepdims=True)
    order = np.sort(like, 1)
    second = order[:, -2] if like.shape[1] > 1 else np.zeros(len(like))
    return like.argmax(1), order[:, -1], order[:, -1] - second


def predict_languages(docs: DataFrame, model: LanguageModel,
                      min_lead: float = MIN_LEAD, *keep: str) -> DataFrame:
    """``doc_id``, the ``keep`` columns, ``lang_pred``, ``score`` and ``ambiguous`` for every row.

    Reads the text only.  Null text and text without a letter, as any text when there is no
    language to learn, is ``und`` with score 0; ``ambiguous`` when the lead of the best codeword
    over the second is below ``min_lead``.  Equal texts get equal answers; rows stay one for one.
    """
    kept = [c for c in keep if c not in ("doc_id", "text")]
    rows = docs_of(docs, *kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    types = dict(rows.dtypes)
    schema = ", ".join(
        [f"`{c}` {types[c]}" for c in rows.columns]
        + ["lang_pred string", "score double", "ambiguous boolean"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, score, lead = [UNKNOWN] * len(batch), np.zeros(len(batch)), np.ones(len(batch))
            asked = [k for k, t in enumerate(batch.column(1).to_pylist()) if _LETTER.search(t)]
            if asked and m.languages:
                texts = _bytes(batch.column(1).take(pa.array(asked)))
                best, score[asked], lead[asked] = _choose(
                    _stretch(*_decisions(texts, m.weights)), m)
                for k, b in zip(asked, best, strict=True):
                    names[k] = m.languages[b]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(score),
                 pa.array(lead < min_lead)], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    out = rows.mapInArrow(predict, schema)
    return out.select("doc_id", *keep, "lang_pred", "score", "ambiguous")


def remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32`` of the id written as text, modulo ``modulus``; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(0))
