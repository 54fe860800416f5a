"""Five-word shingles of texts as 64-bit hashes, whole Arrow batches at a time.

Words are what blanks (space, tab to carriage return) part; A-Z is lower-cased, other letters are
not.  A word's hash is a polynomial over randomly mapped bytes, a shingle's mixes its words'.
"""

from __future__ import annotations

import numpy as np

#: Words in a shingle.
WORDS = 5
#: Bytes of text worked on at once.
PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)


def _lower(table: np.ndarray) -> np.ndarray:
    table[65:91] = table[97:123]
    return table


_BYTE = _lower(_table(11))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the input changes every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]))
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]))
        return cls.up[:n], cls.down[:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes and hashes of the words in ``data`` (bytes)."""
    blank = _BLANK[data]
    inside = ~blank
    starts = np.flatnonzero(inside & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(inside & np.concatenate([blank[1:], [True]])) + 1
    up, down = _Powers.of(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up)])
    lengths = (ends - starts).astype(np.uint64)
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + lengths * _ODD)


def _cut(text: bytes) -> list[bytes]:
    """A long text in pieces that end at blanks, so that memory follows the piece."""
    out, at = [], 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(words per text, hashes)`` of all words."""
    counts, hashes = np.zeros(len(texts), np.int64), []
    held: list[bytes] = []
    owner: list[int] = []
    size = 0

    def take() -> None:
        starts, words = word_hashes(np.frombuffer(b" ".join(held), np.uint8))
        at = np.cumsum([0, *(len(t) + 1 for t in held[:-1])])
        np.add.at(counts, owner, np.diff(np.append(np.searchsorted(starts, at), len(starts))))
        hashes.append(words)

    for k, text in enumerate(texts):
        for part in _cut(text):
            held.append(part)
            owner.append(k)
            size += len(part)
            if size >= PIECE:
                take()
                held, owner, size = [], [], 0
    if size:
        take()
    return counts, np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(text numbers, hashes)`` of all shingles, by text, repeats included.

    A text of one to four words has its whole sequence as one shingle; one without words has none.
    """
    count, words = _words(texts)
    first = np.cumsum(count) - count
    owner, hashes = [], []
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        h = np.zeros(n, np.uint64)
        for i in range(WORDS):
            h = mix(h * _BASE + words[i : i + n])
        of = np.repeat(np.arange(len(texts)), count)
        whole = of[:n] == of[WORDS - 1 :]
        owner.append(of[:n][whole])
        hashes.append(h[whole])
    for k in np.flatnonzero((count > 0) & (count < WORDS)):
        h = np.zeros(1, np.uint64)
        for w in words[first[k] : first[k] + count[k]]:
            h = mix(h * _BASE + w)
        owner.append(np.array([k]))
        hashes.append(mix(h + np.uint64(count[k])))
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owner), np.concatenate(hashes)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted by text and hash."""
    owner, hashes = shingles(texts)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def pieces(texts: list[bytes]):
    """Ranges of texts of about :data:`PIECE` bytes together."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= PIECE or k + 1 == len(texts):
            yield at, k + 1
            at, size = k + 1, 0
