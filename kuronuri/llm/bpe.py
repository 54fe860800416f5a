"""BPE encoding and decoding of whole documents ``docs(doc_id, text)``.

The encoder gives the exact merges of a byte pair vocabulary in linear time: an Aho-Corasick
automaton finds the longest token at every place of a word, a walk takes them from left to right
and steps back where two neighbours could not both stay unmerged (a table of pairs, filled as
pairs occur, tells).  The decoder takes tokens out of one buffer by a table of offsets.

Vocabulary files are a parameter and are read on the driver; workers get them once, as a broadcast
of the file (a few MB, whatever the input).
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from kuronuri.llm.tables import docs_of

_SPACE = r"\t-\r\x20\x85\xa0  -     　"
#: Texts that hold these are split by :data:`_SPACE`, since ``str.split`` takes them for blanks.
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_NOT_SPACE = regex.compile(f"[^{_SPACE}]+")
#: Entries of each cache of a worker, those where other stages follow, and the longest text kept.
CACHE, SMALL_CACHE, CACHE_CHARS = 250_000, 60_000, 48
#: Output rows go out in pieces of about so many ids.
PIECE = 2_000_000


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte, by their public rule.

    Printable characters of Latin-1 stand for themselves, the others for code points from 256.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1),
             *range(ord("®"), ord("ÿ") + 1)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class Recent(dict):
    """A cache of at most ``room`` entries; when half of that is full, what was not used since the
    last time goes."""

    def __init__(self, room: int = CACHE) -> None:
        super().__init__()
        self.room, self.old = room, {}

    def keep(self, key, value):
        if len(self) >= self.room // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self, room: int) -> None:
        self.clear()
        self.room, self.old = room, {}


class WordBpe:
    """Merges of one vocabulary over words.

    Inside, a word is a string of symbols: byte ``b`` is ``chr(b)``, the last byte of the word
    ``chr(256 + b)`` (it carries the mark of the word's end).
    """

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], end: str) -> None:
        symbol = {letter: chr(b) for b, letter in enumerate(byte_letters())}

        def inner(token: str) -> str:
            if end and token.endswith(end):
                body = token.removesuffix(end)
                return "".join(symbol[c] for c in body[:-1]) + chr(256 + ord(symbol[body[-1]]))
            return "".join(symbol[c] for c in token)

        self.ids = {inner(t): i for t, i in vocab.items()}
        size = max(self.ids.values()) + 1
        self.length = [0] * size
        for token, i in self.ids.items():
            self.length[i] = len(token)
        self.parts = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        last = -1
        for left, right in merges:
            whole = self.ids[inner(left + right)]
            if whole <= last:
                raise ValueError("the ids of merges must rise in the order of the merges")
            last = whole
            pair = (self.ids[inner(left)], self.ids[inner(right)])
            self.parts[whole], self.merged[pair] = pair, whole
        #: The longest token that is a proper beginning of each token; -1: none.
        self.shorter = [-1] * size
        for token, i in self.ids.items():
            for n in range(len(token) - 1, 0, -1):
                if (j := self.ids.get(token[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.finder = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.finder.add_word(token, (len(token), i))
        self.finder.make_automaton()
        self.fits: Recent = Recent()
        #: Whether merging a token's own text gives the token.
        self.reached = [False] * size
        for i in sorted(self.ids.values()):
            left, right = self.parts[i]
            self.reached[i] = left == i or (
                self.reached[left] and self.reached[right] and self._first(left, right, i))

    def _first(self, left: int, right: int, whole: int) -> bool:
        """Whether no merge across the border of two tokens comes before the one of them both."""
        del self.merged[left, right]
        try:
            return self._compatible(left, right)
        finally:
            self.merged[left, right] = whole

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merges of both texts together leave these two tokens as they are."""
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            known = self.fits.old.get(key)
            if known is None:
                known = self._compatible(left, right)
            self.fits.keep(key, known)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo merges on both sides of the border, latest first; any merge across the border that
        # comes before the merge undone last would have been made.
        limit, merged, parts = 1 << 60, self.merged, self.parts
        while True:
            if merged.get((left, right), limit) < limit:
                return False
            turn_left, tried = left > right, 0
            while tried < 2:
                if turn_left:
                    limit, inside = left, parts[left][1]
                    if inside != left:
                        left = inside
                        break
                else:
                    limit, inside = right + 1, parts[right][0]
                    if inside != right:
                        right = inside
                        break
                turn_left, tried = not turn_left, tried + 1
            if tried == 2:
                return True

    def encode(self, word: bytes) -> list[int]:
        text = word[:-1].decode("latin-1") + chr(256 + word[-1])
        whole = self.ids.get(text)
        if whole is not None and self.reached[whole]:
            return [whole]
        longest = [-1] * (len(text) + 1)
        for end, (n, i) in self.finder.iter(text):
            longest[end - n + 1] = i  # later ends are longer
        length, shorter, fits, compatible = self.length, self.shorter, self.fits, self.compatible
        open_at = bytearray(b"\1" * (len(text) + 1))
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < len(text):
            last = out[-1] if out else -1
            while True:
                end = pos + length[token]
                if open_at[end] and (
                    last < 0 or (fits.get((last, token)) or compatible(last, token))
                ):
                    out.append(token)
                    pos, token = end, longest[end]
                    break
                token = shorter[token]
                if token < 0:
                    open_at[pos] = 0
                    out.pop()
                    pos, token = pos - length[last], last
                    break
        return out


class Tokenizer:
    """What the file says: special tokens, normalization, words, merges."""

    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        model = spec["model"]
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        if (
            model["type"] != "BPE" or model["byte_fallback"] or spec["decoder"] is not None
            or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]
                   for t in spec["added_tokens"])
        ):
            raise ValueError("only word BPE files with NFC, blanks dropped and lower case are read")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile(
            "|".join(regex.escape(t, literal_spaces=True)
                     for t in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", _SPACE))
        self.bpe = WordBpe(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        names = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for token, i in [*model["vocab"].items(), *self.special.items()]:
            names[i] = token
        #: All tokens in one buffer with a table of offsets.
        self.names = pa.array(names, pa.string())
        self.by_word, self.by_chunk = Recent(), Recent()

    def _word(self, word: str) -> bytes:
        known = self.by_word.get(word)
        if known is None:
            known = self.by_word.old.get(word)
            if known is None:
                ids = self.bpe.encode(word.encode("utf-8"))
                known = b"".join(i.to_bytes(4, "little") for i in ids)
            if len(word) <= CACHE_CHARS:
                self.by_word.keep(word, known)
        return known

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a stretch without blanks, four bytes each; nothing in it meets what is outside."""
        known = self.by_chunk.get(chunk)
        if known is None:
            known = self.by_chunk.old.get(chunk)
            if known is None:
                plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
                known = b"".join(map(self._word, self.words.findall(plain)))
            if len(chunk) <= CACHE_CHARS:
                self.by_chunk.keep(chunk, known)
        return known

    def _plain(self, text: str) -> bytes:
        chunks = _NOT_SPACE.findall(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self._chunk, chunks))

    def encode(self, text: str) -> bytes:
        """Ids of a text, four bytes each."""
        if not any(t in text for t in self.special):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def forget(self, room: int = CACHE) -> None:
        """Empty the caches, so that a worker that goes on to other tasks does not keep them."""
        for cache in (self.by_word, self.by_chunk, self.bpe.fits):
            cache.forget(room)
        pa.default_memory_pool().release_unused()

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Texts of lists of ids: their tokens, a blank between."""
        tokens = pc.take(self.names, ids.flatten())
        offsets = pc.subtract(ids.offsets, ids.offsets[0])
        return pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")


_LOADED: dict[str, Tokenizer] = {}


def tokenizer_of(raw: bytes) -> Tokenizer:
    """The tokenizer of a file, built once per worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizer(raw)
    return _LOADED[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _lists(encoded: list[bytes]) -> pa.ListArray:
    offsets = pa.array([0, *_running(len(e) // 4 for e in encoded)], pa.int32())
    flat = pa.Array.from_buffers(pa.int32(), sum(map(len, encoded)) // 4,
                                 [None, pa.py_buffer(b"".join(encoded))])
    return pa.ListArray.from_arrays(offsets, flat)


def _running(values) -> Iterator[int]:
    total = 0
    for v in values:
        total += v
        yield total


def encode_docs(docs: DataFrame, vocabulary: str, keep: bool = False) -> DataFrame:
    """``doc_id, ids``: token ids of every whole text, without added marks, cut or padding.

    Special tokens written in a text count as such.  Null or empty text has no ids.  Rows stay one
    for one; other columns are left out.  Bounded memory: rows go out in pieces of about
    :data:`PIECE` ids.  ``keep`` leaves the caches, of bounded size, to the worker's next tasks; without
    it they are smaller and emptied after every task, for jobs in which other stages follow.
    """
    rows = docs_of(docs)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    id_type = dict(rows.dtypes)["doc_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(shared.value)
        if not keep:
            tok.forget(SMALL_CACHE)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at, done, size = 0, [], 0
            for k in range(len(texts)):
                done.append(tok.encode(texts[k].as_py()))
                size += len(done[-1]) // 4
                if size >= PIECE or k + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, len(done)), _lists(done)], ["doc_id", "ids"])
                    at, done, size = k + 1, [], 0
        if not keep:
            tok.forget()

    return rows.mapInArrow(encode, f"doc_id {id_type}, ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids, decoded``: tokens of ``ids`` with a blank between, special ones too.

    Null ``ids`` reads as empty, which decodes to the empty text; other columns are left out.
    """
    rows = encoded.selectExpr("doc_id", "coalesce(ids, cast(array() as array<int>)) as ids")
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    id_type = dict(rows.dtypes)["doc_id"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(shared.value)
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_pylist()
            at, size = 0, 0
            for k, n in enumerate(sizes):
                size += n
                if size >= PIECE or k + 1 == len(sizes):
                    part = batch.slice(at, k + 1 - at)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), tok.decode(part.column(1))],
                        ["doc_id", "ids", "decoded"])
                    at, size = k + 1, 0

    return rows.mapInArrow(decode, f"doc_id {id_type}, ids array<int>, decoded string")
