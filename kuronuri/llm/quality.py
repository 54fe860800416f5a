"""Quality rules, line first: failing lines go, then documents that lost too much of their text.

Works on the library's documents ``docs(doc_id, text)``.  Everything is an expression on the
document's own row: DataFrame functions only, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri.functions.arrays import let
from kuronuri.llm.tables import docs_of, words

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the verdict."""

    #: A line ends like a sentence or a clause; only lines longer than this must.
    terminal: str = r"[.!?…。！？:;,、\"'”’»」』)）\]0-9][\x20\x09-\x0D]*$"
    min_unended_chars: int = 80
    #: So many separators make a navigation bar.
    separators: str = r"^[^|›»·•>]*[|›»·•>][^|›»·•>]*[|›»·•>][^|›»·•>]*[|›»·•>]"
    #: Symbols in a hundred code points of a line.
    max_symbols_pct: int = 4
    #: Phrases of page furniture; they count in lines up to this length.
    boilerplate: str = (
        r"(?i)all rights reserved|cookie|privacy policy|terms of (?:use|service)|javascript"
        r"|lorem ipsum|click here|sign (?:in|up)|log ?in|subscribe|read more|無断転載|利用規約"
    )
    max_boilerplate_chars: int = 200
    #: Capital letters only, in a line at least so long.
    min_shout_chars: int = 20
    #: A document may lose so much of its text, in hundredths of its word characters.
    max_lost_pct: int = 50
    min_words: int = 50
    max_repeat_pct: int = 50


def _bare(text: Column) -> Column:
    return F.translate(text, _SPACES, "")


def line_fails(line: Column, rules: LineRules) -> Column:
    """Whether a line with a word breaks a punctuation, navigation or boilerplate rule."""
    n = F.length(line)
    symbols = n - F.length(F.translate(line, SYMBOLS, ""))
    return (
        (symbols * 100 > n * rules.max_symbols_pct)
        | ((n >= rules.min_unended_chars) & ~line.rlike(rules.terminal))
        | line.rlike(rules.separators)
        | ((n <= rules.max_boilerplate_chars) & line.rlike(rules.boilerplate))
        | ((n >= rules.min_shout_chars) & (F.upper(line) == line) & (F.lower(line) != line))
    )


def repeat_words(tokens: Column) -> Column:
    """Words in windows of three that stand twice or more in the text, the first included.

    Windows are compared by 64-bit hashes.  Texts whose windows all differ stop there; else the
    windows are sorted, equal neighbours kept, and their positions covered from left to right.
    """

    def covered(at: Column) -> Column:
        gaps = F.zip_with(
            at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(1))),
            lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))),
        )
        return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)

    def equal_neighbours(pairs: Column) -> Column:
        behind = F.zip_with(
            pairs, F.slice(pairs, 2, F.greatest(F.size(pairs) - 1, F.lit(1))),
            lambda a, b: F.struct(a.i.alias("i"), F.coalesce(a.h == b.h, F.lit(False)).alias("eq")),
        )
        return let(behind, lambda x: F.array_sort(F.transform(
            F.filter(
                F.zip_with(x, F.concat(F.array(F.lit(False)), F.slice(x.eq, 1, F.size(x) - 1)),
                           lambda a, before: F.struct(a.i.alias("i"), (a.eq | before).alias("keep"))),
                lambda a: a.keep),
            lambda a: a.i)))

    def sorted_pairs(hashes: Column) -> Column:
        return F.sort_array(
            F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def of_hashes(hashes: Column) -> Column:
        heavy = let(sorted_pairs(hashes), lambda p: let(equal_neighbours(p), covered))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(heavy)

    def of_words(w: Column) -> Column:
        hashes = F.transform(
            F.slice(w, 3, F.size(w) - 2),
            lambda third, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), third),
        )
        return F.when(F.size(w) < 4, 0).otherwise(let(hashes, of_hashes))

    return let(tokens, of_words)


def clean_lines(docs: DataFrame, rules: LineRules = LineRules()) -> DataFrame:
    """``doc_id, text``, counts, ``cleaned``, ``n_failed_lines``, ``lost_pct``, ``base_failed``, ``kept``.

    Lines are what ``\\n`` parts; those without a word go without being counted as lost.  A line
    fails by :func:`line_fails` or as a copy of an earlier line.  ``base_failed``: fewer than
    ``min_words`` words, or more than ``max_repeat_pct`` hundredths of them in repeated windows of
    three.  ``kept``: not so, and at most ``max_lost_pct`` hundredths of the word characters lost.
    Null or empty text has no words and is not kept; rows stay one for one, other columns are left
    out.
    """
    rows = docs_of(docs)
    lines = F.filter(F.split("text", "\n"), lambda line: F.length(_bare(line)) > 0)
    step1 = rows.select(
        "doc_id", "text", words(F.col("text")).alias("__words"), lines.alias("__lines"))
    step2 = step1.select(
        "doc_id", "text", "__lines",
        F.size("__words").cast("long").alias("n_words"),
        F.length(_bare(F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long")
        .alias("n_symbols"),
        F.array_distinct("__lines").alias("__first"),
        repeat_words(F.col("__words")).cast("long").alias("n_repeat_words"),
    )
    step3 = step2.withColumn("__good", F.filter("__first", lambda x: ~line_fails(x, rules)))
    step4 = step3.select(
        "doc_id", "text", "n_words", "word_chars", "n_symbols",
        (F.size("__lines") - F.size("__first")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.size("__lines") - F.size("__good")).cast("long").alias("n_failed_lines"),
        F.array_join("__good", "\n").alias("cleaned"),
    )
    left = F.length(_bare(F.col("cleaned")))
    base = (F.col("n_words") < rules.min_words) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_pct)
    return step4.withColumns({
        "lost_pct": F.when(F.col("word_chars") == 0, 0.0).otherwise(
            (F.col("word_chars") - left) * 100.0 / F.col("word_chars")),
        "base_failed": base,
    }).withColumn("kept", ~F.col("base_failed") & (F.col("lost_pct") <= rules.max_lost_pct))
