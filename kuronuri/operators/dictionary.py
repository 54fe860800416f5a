"""Dictionary detection: user terms found in texts, longest first, without overlaps.

Short lists travel as one pattern, a prefix tree spelled as a regular expression.  Tables of terms
of any size are joined to the texts through an index of character runs: a term waits at its two
rarest runs, so only texts that may hold it get its pattern.  Both ways find the same spans, and
both are column functions.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.functions.arrays import fold_emit
from kuronuri.functions.regex import java_regex, whole_characters
from kuronuri.functions.spans import CANDIDATE, candidate
from kuronuri.functions.text import blocks, cut
from kuronuri.sources.folders import written

#: Put around matches; a noncharacter, and taken out of texts and terms before they are compared.
MARK, NO_MARK = "\ufffe", "\ufffd"
#: Characters of the runs in the index; a term is looked up by the longest that it holds.  Short runs
#: of long terms stand nearly everywhere (three digits of a number), long ones where the term stands.
GRAMS = (3, 6, 12)
_WORD = java_regex(r"\w").removeprefix("(?Ud)")
KIND = "struct<entity:string,score:double,bounded:boolean,regex:string>"


# --- one case for all letters -----------------------------------------------------------


def fold_case(s: str) -> str:
    """One case for all letters that are equal without case, letter by letter.

    The upper-case form, lowered: long s is s, the Kelvin sign is k, both foreign i are i.  Letters
    whose upper case is longer stay as they are, so offsets stay true.
    """
    return s.lower() if s.isascii() else "".join(map(_fold, s))


@functools.cache
def _fold(c: str) -> str:
    up = c.upper()
    return (up if len(up) == 1 else c).lower()[0]


@functools.cache
def _folding() -> tuple[str, str]:
    """All letters that change, and what they become."""
    letters = (c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff")
    pairs = [(c, _fold(c)) for c in letters if c.upper() != c or c.lower() != c]
    return "".join(a for a, b in pairs if a != b), "".join(b for a, b in pairs if a != b)


def folded(text: Column, ignore_case: bool = True) -> Column:
    """The text in the form in which it is compared; no character moves."""
    old, new = _folding() if ignore_case else ("", "")
    return F.translate(text, old + MARK, new + NO_MARK)


# --- patterns ---------------------------------------------------------------------------


def _literal(s: str) -> str:
    return "".join(f"\\{c}" if c.isascii() and not c.isalnum() else c for c in s)


def _tree(terms: Sequence[str]) -> str:
    """A pattern for sorted distinct terms that tries the longest first."""
    out = []
    for _, group in itertools.groupby(terms, key=lambda t: t[:1]):
        same = list(group)
        first, last = same[0], same[-1]
        n = next((i for i, (a, b) in enumerate(zip(first, last, strict=False)) if a != b),
                 min(len(first), len(last)))
        rest = [t[n:] for t in same if len(t) > n]
        body = _literal(first[:n])
        if rest:
            body += f"(?:{_tree(rest)})" + ("?" if len(rest) < len(same) else "")
        out.append(body)
    return "|".join(out)


def _bounds(bounded: Column, body: Column) -> Column:
    return F.when(
        bounded, F.concat(F.lit(f"(?<!{_WORD})(?:"), body, F.lit(f")(?!{_WORD})"))
    ).otherwise(F.concat(F.lit("(?:"), body, F.lit(")")))


def _spans(text: Column, regex: Column | str, ignore_case: bool = True) -> Column:
    """``array<struct<s,e,m>>`` of the matches, ``m`` as it stands in the text.

    Matches are put between marks in one pass, so every second piece is one.
    """
    marked = F.regexp_replace(folded(text, ignore_case), regex, f"{MARK}$0{MARK}")

    def found(v: Column) -> Column:
        def step(st, x):
            e = st.pos + F.length(x)
            row = F.struct(st.pos.alias("s"), e.alias("e"))
            return F.struct(e.alias("pos"), (~st.hit).alias("hit")), st.hit, row

        init = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("hit"))
        spans = fold_emit(F.split(v.marked, MARK, -1), init, step, "struct<s:int,e:int>")
        return F.transform(
            spans, lambda p: F.struct(p.s.alias("s"), p.e.alias("e"),
                                      cut(v.pieces, p.s, p.e).alias("m")))

    bound = F.struct(marked.alias("marked"), blocks(text).alias("pieces"))
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    return F.transform(
        F.array(bound), lambda v: F.when(F.contains(v.marked, F.lit(MARK)), found(v)).otherwise(none)
    )[0]


def _candidates(spans: Column, entity, score, ord: Column | int) -> Column:
    name = F.concat(F.lit("dict_"), entity) if isinstance(entity, Column) else f"dict_{entity}"
    return F.transform(
        spans,
        lambda m: candidate(m.s, m.e, entity, score, pattern=name, ord=ord, original=m.m))


# --- lists ------------------------------------------------------------------------------


@dataclass(frozen=True)
class DictMatcher:
    """A list of terms of one entity, kept with the plan; tables of terms need none."""

    entity: str
    terms: tuple[str, ...]
    score: float
    bounded: bool
    ignore_case: bool = True

    @property
    def regex(self) -> str:
        fold = fold_case if self.ignore_case else str
        ts = sorted({fold(t).replace(MARK, NO_MARK) for t in self.terms if t})
        body = _tree(ts) if ts else r"(?!)"
        return f"(?<!{_WORD})(?:{body})(?!{_WORD})" if self.bounded else f"(?:{body})"

    def spans(self, text: Column, ord: int = 0) -> Column:
        """The candidates of one text."""
        found = _spans(text, self.regex, self.ignore_case)
        return _candidates(found, self.entity, self.score, ord)


def company_matcher(terms: Sequence[str]) -> DictMatcher:
    return DictMatcher("COMPANY", tuple(terms), vocab.DICT_COMPANY_SCORE, bounded=True)


def keyword_matcher(terms: Sequence[str]) -> DictMatcher:
    return DictMatcher("KEYWORD", tuple(terms), vocab.DICT_KEYWORD_SCORE, bounded=False)


def company_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """A column of company names as a term table."""
    return _kind(terms, term, "COMPANY", vocab.DICT_COMPANY_SCORE, True)


def keyword_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """A column of keywords as a term table."""
    return _kind(terms, term, "KEYWORD", vocab.DICT_KEYWORD_SCORE, False)


def _kind(terms: DataFrame, term: str, entity: str, score: float, bounded: bool) -> DataFrame:
    return terms.select(
        F.lit(entity).alias("entity"), F.col(term).alias("term"),
        F.lit(score).cast("double").alias("score"), F.lit(bounded).alias("bounded"))


# --- tables -----------------------------------------------------------------------------


def _grams(text: Column, lengths: Sequence[int]) -> Column:
    """The distinct runs of characters of some lengths, read at every place in one pass each."""
    runs = [
        F.regexp_extract_all(text, F.lit(whole_characters(f"(?s)(?=(.{{{n}}}))")), F.lit(1))
        for n in lengths
    ]
    return F.array_distinct(F.concat(*runs))


def _key(doc_id: str = "doc_id") -> Column:
    """Documents meet terms by this; ids that share it share terms, which are verified anyway."""
    return F.xxhash64(doc_id)


def possible_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``key, kind, term``: the terms that may stand in a document, in folded form.

    ``terms(entity, term, score, bounded)``.  Runs of characters that any term needs (as long as the
    longest of ``GRAMS`` it holds, all of a shorter term) are kept as hashes with the documents that
    hold them.  A term with a run that no document holds is dropped; any other is looked up at its
    rarest run, and stays where its second rarest is found as well, unless its runs are of the
    longest kind and say enough alone.
    """
    kind = F.struct("entity", F.col("score").cast("double").alias("score"), "bounded")
    given = written(
        terms.where(F.coalesce(F.length("term"), F.lit(0)) > 0)
        .select(kind.alias("kind"), folded(F.col("term")).alias("term")).distinct(), "terms")
    n = F.length("term")
    size = F.greatest(*[F.when(n >= g, g) for g in GRAMS], F.least(n, F.lit(GRAMS[0])))
    lengths = [r[0] for r in given.select(size).distinct().collect()] or [GRAMS[0]]  # a row a length
    runs = F.array("term")
    for g in GRAMS:
        runs = F.when(size == g, _grams(F.col("term"), [g])).otherwise(runs)
    # Hashed once distinct: two runs of one hash only let a text be searched in vain.
    grams = given.select("term").distinct().select("term", F.explode(runs).alias("gram")).select(
        "term", F.xxhash64("gram").alias("gram")).distinct()
    grams = grams.join(grams.groupBy("term").agg(F.count("*").alias("n")), "term")
    needed = written(grams.select("gram").distinct(), "term-grams")
    held = docs.select(
        _key().alias("key"), F.explode(_grams(folded(F.col("text")), lengths)).alias("gram")
    ).select("key", F.xxhash64("gram").alias("gram"))
    index = written(held.join(needed, "gram", "left_semi"), "gram-index")
    often = index.groupBy("gram").agg(F.count("*").alias("often"))
    rare = F.slice(F.sort_array(F.collect_list(F.struct("often", "gram"))), 1, 2)
    # Written, so that their size is known before the index would be dealt out by run to meet them.
    anchors = written((
        grams.join(often, "gram").groupBy("term", "n")
        .agg(F.count("*").alias("found"), rare.alias("rare")).where(F.col("found") == F.col("n"))
        .select("term", F.get("rare", F.lit(0)).gram.alias("gram"),
                F.when(F.length("term") < GRAMS[-1], F.get("rare", F.lit(1)).gram).alias("second"))
        .join(given, "term")
    ), "term-anchors")
    met = index.join(anchors, "gram").select("key", "kind", "term", "second")
    # Only runs that are some term's second rarest move.
    again = index.select("key", F.col("gram").alias("second")).join(
        anchors.select("second").distinct(), "second", "left_semi")
    both = met.where(F.col("second").isNotNull()).join(again, ["key", "second"], "left_semi")
    return both.unionByName(met.where(F.col("second").isNull())).select("key", "kind", "term")


def document_patterns(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``key, kinds``: one pattern per kind of term that may stand in a document."""
    special = r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
    item = F.struct(
        "kind", (-F.length("term")).alias("n"),
        F.regexp_replace("term", special, r"\\$1").alias("rx"),
        F.regexp_replace(F.substring("term", 1, 1), special, r"\\$1").alias("head"))
    # By kind, longest first.
    found = possible_terms(docs, terms).groupBy("key").agg(
        F.sort_array(F.collect_set(item)).alias("ts"))

    def pattern(kind: Column) -> Column:
        mine = F.filter("ts", lambda t: t.kind == kind)
        # Where a text has none of the first characters, no term is tried.
        body = F.concat(
            F.lit("(?=["), F.array_join(F.array_distinct(F.transform(mine, lambda t: t.head)), ""),
            F.lit("])(?:"), F.array_join(F.transform(mine, lambda t: t.rx), "|"), F.lit(")"))
        return F.struct(kind.entity.alias("entity"), kind.score.alias("score"),
                        kind.bounded.alias("bounded"), _bounds(kind.bounded, body).alias("regex"))

    kinds = F.array_distinct(F.transform("ts", lambda t: t.kind))
    return found.select("key", F.transform(kinds, pattern).alias("kinds"))


def with_terms(docs: DataFrame, terms: DataFrame, name: str = "dict_kinds") -> DataFrame:
    """``docs`` with the patterns of the terms that may stand in each text."""
    found = document_patterns(docs, terms).select(
        F.col("key").alias("__key"), F.col("kinds").alias(name))
    none = F.array().cast(f"array<{KIND}>")
    return (
        docs.withColumn("__doc", _key()).join(found, F.col("__doc") == F.col("__key"), "left")
        .withColumn(name, F.coalesce(F.col(name).cast(f"array<{KIND}>"), none)).drop("__doc", "__key")
    )


def kind_spans(text: Column, kinds: Column, ord: int = 0) -> Column:
    """Candidates of one text by the patterns that :func:`with_terms` gave its document."""
    return F.flatten(
        F.transform(
            kinds,
            lambda k, i: _candidates(_spans(text, k.regex), k.entity, k.score, i + ord),
        )
    ).cast(f"array<{CANDIDATE}>")


def _rows(docs: DataFrame, found: Column) -> DataFrame:
    return (
        docs.select("doc_id", F.explode_outer(found).alias("c"))
        .where(F.col("c").isNotNull())
        .select("doc_id", F.col("c.start"), F.col("c.end"), F.col("c.entity"),
                F.col("c.score"), F.col("c.original"))
    )


def detect_terms(docs: DataFrame, matcher: DictMatcher) -> DataFrame:
    """One row per match of a list in the whole text."""
    return _rows(docs, matcher.spans(F.col("text")))


def detect_term_table(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Dictionary matches for a table ``terms(entity, term, score, bounded)`` of any size.

    Each kind of term is matched by itself: leftmost first, then longest, without overlaps.  Nothing
    of the table goes to the driver.
    """
    docs = docs.select("doc_id", "text")
    return _rows(with_terms(docs, terms), kind_spans(F.col("text"), F.col("dict_kinds")))
