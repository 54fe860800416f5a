"""Scalar text functions as Spark columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kuronuri import vocab
from kuronuri.functions.arrays import let
from kuronuri.functions.regex import SPACE, has_any, java_regex

# --- cutting text by code point -------------------------------------------------------

BLOCK_CHARS = 8192


def blocks(text: Column) -> Column:
    """The text in pieces of ``BLOCK_CHARS`` code points, made in one pass.

    ``substring`` has to count code points from the start of the string, so many
    cuts in one huge text would cost quadratic time.  Cutting inside a block
    keeps each cut cheap.
    """
    return F.when(F.length(text) <= BLOCK_CHARS, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK_CHARS}}}"), F.lit(0))
    )


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """``text[start:end]`` out of :func:`blocks`; out-of-range parts are empty."""
    first = F.floor(start / BLOCK_CHARS).cast("int")
    last = F.floor((end - 1) / BLOCK_CHARS).cast("int")
    inside = F.get(pieces, first).substr(start - first * BLOCK_CHARS + 1, end - start)
    across = F.array_join(
        F.transform(
            F.slice(pieces, first + 1, last - first + 1),
            lambda piece, i: piece.substr(
                F.when(i == 0, start - first * BLOCK_CHARS).otherwise(F.lit(0)) + 1,
                F.when(i == last - first, end - last * BLOCK_CHARS).otherwise(F.lit(BLOCK_CHARS))
                - F.when(i == 0, start - first * BLOCK_CHARS).otherwise(F.lit(0)),
            ),
        ),
        "",
    )
    value = F.when(end <= start, F.lit("")).when(first == last, inside).otherwise(across)
    return F.coalesce(value, F.lit(""))


# --- trimming and normalization --------------------------------------------------------

_EDGES = f"^{SPACE}+|{SPACE}+\\z"

# Characters that NFKC leaves alone whatever stands beside them (given that no
# combining mark is in the text), and the full-width forms it maps one to one.
_PLAIN = (
    r"\x00-\x7f\xc0-\xff‘’“”■、-〃々-】"
    r"〔-〛ぁ-ゖゝゞァ-ヾ㐀-䶿一-鿿"
    r"가-힣\xd7\xa1\xa5\xa7\xa9\xab\xae\xb0\xb1\xb6\xbb\xbf"
)
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　￥"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " \xa5"
_NEEDS_NFKC = rf"[^{_PLAIN}！-～　￥]"


def strip(s: Column) -> Column:
    """Drop Unicode white space at both ends."""
    return F.regexp_replace(s, _EDGES, "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc(lists: pd.Series) -> pd.Series:
    def one(xs):
        return None if xs is None else [
            None if x is None else unicodedata.normalize("NFKC", x) for x in xs
        ]

    return lists.map(one)


def nfkc_list(terms: Column) -> Column:
    """NFKC of every string of an array.

    Arrays that hold only plain or full-width characters are done in the JVM;
    Python sees a null instead of them.
    """
    hard = F.exists(terms, lambda t: t.rlike(_NEEDS_NFKC))
    return F.coalesce(
        _nfkc(F.when(hard, terms)), F.transform(terms, lambda t: F.translate(t, _WIDE, _NARROW))
    )


def squeeze(s: Column) -> Column:
    """Collapse white space runs to one blank and trim."""
    return F.trim(F.regexp_replace(s, f"{SPACE}+", " "))


def norm_terms(terms: Column) -> Column:
    return F.transform(nfkc_list(terms), squeeze)


def norm_term(term: Column) -> Column:
    """NFKC, white space collapsed, trimmed: the form in which terms are compared."""
    return F.get(norm_terms(F.array(F.coalesce(term, F.lit("")))), F.lit(0))


# --- small formatters -------------------------------------------------------------------


def black(original: Column, min_len: int = 3) -> Column:
    return F.repeat(F.lit(vocab.BLACK), F.greatest(F.lit(min_len), F.length(original)))


def is_black(replacement: Column) -> Column:
    return replacement.rlike(f"^{vocab.BLACK}+\\z")


def piece_black(replacement: Column, piece_len: Column) -> Column:
    """A black bar shrinks to the piece it covers; any other label stays whole."""
    return F.when(
        is_black(replacement), F.repeat(F.lit(vocab.BLACK), F.greatest(F.lit(0), piece_len))
    ).otherwise(replacement)


def html_escape(s: Column) -> Column:
    s = F.coalesce(s, F.lit(""))
    for raw, esc in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"),
        ("\n", "<br>"),
    ):
        s = F.replace(s, F.lit(raw), F.lit(esc))
    return s


def short(s: Column, n: int = vocab.PREVIEW_CHARS) -> Column:
    line = strip(F.replace(F.coalesce(s, F.lit("")), F.lit("\n"), F.lit(" ")))
    return let(
        line,
        lambda v: F.when(F.length(v) > n, F.concat(v.substr(1, n - 1), F.lit("…"))).otherwise(v),
    )


def label(template: str, n: Column) -> Column:
    """Fill ``{n}`` / ``{n:02d}`` in a label template."""
    fmt = template.replace("%", "%%")
    fmt = re.sub(r"\{n(?::(\d*)d?)?\}", lambda m: f"%{m.group(1) or ''}d", fmt)
    fmt = fmt.replace("{{", "{").replace("}}", "}")
    return F.format_string(fmt, n) if re.search(r"%\d*d", fmt) else F.lit(fmt.replace("%%", "%"))


def is_numbered(template: str) -> bool:
    return "{n" in template


def context_preview(pieces: Column, length: Column, start: Column, end: Column,
                    window: int = vocab.CONTEXT_WINDOW) -> Column:
    s = F.greatest(F.lit(0), start - window)
    e = F.least(length, end + window)
    return F.replace(cut(pieces, s, e), F.lit("\n"), F.lit(" "))


def japanese_ratio(text: Column) -> Column:
    """Share of kana and kanji; 0 for an empty text."""
    kept = F.regexp_replace(text, r"[^぀-ヿ一-鿿]", "")
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.length(kept) / F.length(text)
    )


def money_context(pieces: Column, length: Column, start: Column, end: Column,
                  window: int = vocab.MONEY_WINDOW) -> Column:
    """Does a money word stand within ``window`` characters of the span, or in it?"""
    ctx = cut(pieces, F.greatest(F.lit(0), start - window), F.least(length, end + window))
    return let(ctx, lambda c: has_any(c, vocab.MONEY_WORDS))


def safe_name(path: Column) -> Column:
    """Base name that any file system takes."""
    b = F.regexp_replace(path, r"(?s)^.*/", "")
    b = F.replace(b, F.lit(".."), F.lit("_"))
    b = F.regexp_replace(b, r'[<>:"/\\|?*\x00-\x1f]', "_")
    b = F.regexp_replace(b, r"[ .]+\z", "")
    return F.coalesce(F.nullif(b, F.lit("")), F.lit("document"))


def route_ext(path: Column) -> Column:
    """``docx`` / ``pdf`` / ``text`` by lower-cased extension of the last path part."""
    base = F.regexp_replace(path, r"(?s)^.*/", "")
    ext = F.lower(F.regexp_extract(base, r"(?s)^\.*[^.].*(\.[^.]*)\z", 1))
    return F.when(ext == ".docx", "docx").when(ext == ".pdf", "pdf").otherwise("text")


# --- coarse dates and addresses ---------------------------------------------------------


def date_granular(original: Column, mode: str = "YEAR") -> Column:
    if mode == "FULL_MASK":
        return F.lit("[DATE]")
    wareki, ymd = java_regex(vocab.DATE_WAREKI), java_regex(vocab.DATE_YMD)

    def part(rx: str, group: int) -> Column:
        return F.regexp_extract(original, rx, group)

    out = F.when(
        original.rlike(wareki), F.concat(part(wareki, 1), part(wareki, 2), F.lit("年"))
    )
    if mode == "YEAR":
        out = out.when(original.rlike(ymd), F.concat(part(ymd, 1), F.lit("年")))
    elif mode == "YM":
        month = F.translate(part(ymd, 2), _WIDE, _NARROW).try_cast("int").cast("string")
        out = out.when(
            original.rlike(ymd), F.concat(part(ymd, 1), F.lit("年"), month, F.lit("月"))
        )
    return out.otherwise(F.lit("[DATE]"))


def address_granular(original: Column, granularity: str = "UNTIL_CITY",
                     prefectures=vocab.PREFECTURES, municipalities=vocab.MUNICIPALITIES) -> Column:
    split, city = java_regex("^" + vocab.ADDRESS_SPLIT), java_regex(vocab.ADDRESS_CITY)

    def first_prefix(s: Column, names) -> Column:
        if not names:
            return F.lit(None).cast("string")
        return F.get(
            F.filter(F.array(*[F.lit(n) for n in names]), lambda c: F.startswith(s, c)), F.lit(0)
        )

    def finish(v: Column) -> Column:
        if granularity == "UNTIL_PREF":
            return v.pref
        muni = first_prefix(F.concat(v.pref, v.rest), municipalities)
        muni = F.when(F.startswith(muni, v.pref), muni)
        return F.coalesce(muni, F.concat(v.pref, F.regexp_extract(v.rest, city, 1)))

    def body(s: Column) -> Column:
        if granularity == "FULL_MASK":
            return F.when(s == "", s).otherwise(F.lit("[ADDRESS]"))
        listed = let(
            first_prefix(s, prefectures),
            lambda p: F.when(
                p.isNotNull(),
                F.struct(p.alias("pref"), s.substr(F.length(p) + 1, F.length(s)).alias("rest")),
            ),
        )
        hinted = F.when(
            s.rlike(split),
            F.struct(
                F.regexp_extract(s, split, 1).alias("pref"),
                F.regexp_extract(s, split, 2).alias("rest"),
            ),
        )
        found = let(F.coalesce(listed, hinted),
                    lambda v: F.when(v.isNotNull(), finish(v)).otherwise(F.lit("[ADDRESS]")))
        return F.when(s == "", s).otherwise(found)

    return let(strip(original), body)
