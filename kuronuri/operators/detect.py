"""Detection: document text to candidate spans, without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.functions.arrays import empty, fold_emit, let
from kuronuri.functions.company import suffix_spans
from kuronuri.functions.regex import (
    begins,
    could_match,
    holds_marks,
    java_regex,
    match_spans,
    matches_and_gaps,
    offsets,
    one_pass,
    whole_characters,
)
from kuronuri.functions.spans import CANDIDATE, candidate, resolve_first
from kuronuri.operators.dictionary import DictMatcher, kind_spans
from kuronuri.policy import Policy
from kuronuri.vocab import Pattern

DEFAULT_PATTERNS: tuple[Pattern, ...] = tuple(vocab.PATTERNS.values())
FULL_FLAGS = "ims"  # the full tier matches dot-all, multi-line, ignoring case


SUFFIX = vocab.PATTERNS["det_company_suffix"]


def _regex(pattern: Pattern, flags: str = "") -> str:
    rx = begins(pattern.first, java_regex(pattern.regex, flags))
    return rx if pattern in DEFAULT_PATTERNS else whole_characters(rx)


def _matches(text: Column, pattern: Pattern) -> Column:
    if pattern == SUFFIX:
        return suffix_spans(text)
    return match_spans(text, _regex(pattern), pattern.needs, hint=pattern.hint)


def _suffix_candidates(text: Column, p: Pattern, ord: int) -> Column:
    return F.transform(
        suffix_spans(text),
        lambda x: candidate(x.s, x.e, p.entity, p.score, pattern=p.name, ord=ord, original=x.m),
    )


def pattern_spans(text: Column, patterns: Sequence[Pattern], flags: str = "") -> Column:
    """Candidates of all patterns, pattern by pattern.

    The parts of every pattern that can match are gathered first, and one fold
    turns each of them into spans: the expression stays small.  A pattern passes the regex
    engine once; only a text that holds a mark of :func:`one_pass` itself is read in several passes.
    """
    if "i" in flags:
        flags += "u"
    parts, marked, extra = [], [], []
    for i, p in enumerate(patterns):
        if p == SUFFIX:  # no letters and no dots: flags change nothing
            extra.append(_suffix_candidates(text, p, i))
            continue
        rx = _regex(p, flags)
        of = [F.lit(p.entity).alias("entity"), F.lit(p.score).alias("score"),
              F.lit(p.name).alias("pattern"), F.lit(i).alias("ord")]
        here = could_match(text, "", p.needs)
        parts_of = let(one_pass(text, rx), lambda v: F.when(
            F.size(v.m) > 0, F.struct(v.m.alias("m"), v.g.alias("g"), *of)))
        parts.append(F.when(here, parts_of))
        marked.append(F.when(here, F.struct(*matches_and_gaps(text, rx), *of)))
    found = F.flatten(
        F.transform(
            F.array_compact(F.when(holds_marks(text), F.array(*marked)).otherwise(F.array(*parts))),
            lambda v: F.transform(
                offsets(v),
                lambda x: candidate(x.s, x.e, v.entity, v.score, pattern=v.pattern, ord=v.ord,
                                    original=x.m),
            ),
        )
    ) if parts else empty(CANDIDATE)
    return F.concat(found, *extra) if extra else found


def detect_fast(text: Column, allow: Column | None = None,
                patterns: Sequence[Pattern] = DEFAULT_PATTERNS) -> Column:
    """Union of all patterns, overlaps left in, sorted by start and longest first."""
    found = pattern_spans(text, patterns)
    if allow is not None:
        found = F.filter(found, lambda c: ~F.array_contains(allow, c.original))
    order = F.sort_array(
        F.transform(
            found,
            lambda c: F.struct(
                c.start.alias("start"), (c.start - c.end).alias("len"), c.ord.alias("ord"),
                c.alias("c"),
            ),
        )
    )
    return F.transform(order, lambda x: x.c)


def dedupe_contained(cands: Column) -> Column:
    """Drop a span that lies in a better or equal span of the same entity.

    Better means higher score, then earlier, then longer, then earlier pattern.
    Containment is transitive, so looking at all spans equals looking at kept ones.

    By start, the longest and best first, a span lies in a better one if an earlier span of
    its entity ends at or behind its end with at least its score.  Of the earlier ones only those count
    that no other beats in both end and score: at most one for each score there is.
    """
    by_start = F.sort_array(
        F.transform(
            cands,
            lambda c: F.struct(
                c.entity.alias("entity"), c.start.alias("start"),
                (c.start - c.end).alias("len"), (-c.score).alias("score"), c.ord.alias("ord"),
                c.alias("c"),
            ),
        )
    )
    front = "struct<end:int,score:double>"

    def step(st, x):
        before = F.when(st.entity.eqNullSafe(x.entity), st.front).otherwise(empty(front))
        inside = F.exists(before, lambda f: (f.end >= x.c.end) & (f.score >= x.c.score))
        left = F.filter(before, lambda f: (f.end >= x.start) & (
            (f.end > x.c.end) | (f.score > x.c.score)))
        grown = F.array_append(left, F.struct(x.c.end.alias("end"), x.c.score.alias("score")))
        state = F.struct(x.entity.alias("entity"), F.when(inside, before).otherwise(grown).alias("front"))
        return state, ~inside, x.c

    start = F.struct(F.lit(None).cast("string").alias("entity"), empty(front).alias("front"))
    return fold_emit(by_start, start, step, CANDIDATE)


def full_candidates(text: Column, patterns: Sequence[Pattern] = DEFAULT_PATTERNS,
                    dict_spans: Column | None = None) -> Column:
    found = pattern_spans(text, patterns, FULL_FLAGS)
    if dict_spans is None:
        return found
    return F.concat(found, F.coalesce(dict_spans, empty(CANDIDATE)))


def finish_full(cands: Column, allow: Column, priorities) -> Column:
    """Same-entity containment, allow-list, then the first overlap fold."""
    kept = F.filter(dedupe_contained(cands), lambda c: ~F.array_contains(allow, c.original))
    order = F.sort_array(
        F.transform(
            kept,
            lambda c: F.struct(
                (-c.score).alias("score"), c.start.alias("start"),
                (c.start - c.end).alias("len"), c.ord.alias("ord"), c.alias("c"),
            ),
        )
    )
    return resolve_first(F.transform(order, lambda x: x.c), priorities)


def tier(length: Column, policy: Policy) -> Column:
    """``full``, unless the policy asks for ``chunked`` or ``fast`` from some length on."""
    if policy.force_fast:
        return F.lit("fast")
    out = F
    if policy.fast_threshold_chars > 0:
        out = out.when(length >= policy.fast_threshold_chars, "fast")
    if policy.chunk_size > 0:
        out = out.when(length >= policy.chunk_size, "chunked")
    return F.lit("full") if out is F else out.otherwise("full")


CHUNK = "struct<off:int,len:int>"


def chunk_bounds(text: Column, size: int, overlap: int) -> Column:
    """Overlapping chunks ``array<struct<off,len>>``, cut behind a newline when one is near.

    A chunk that is not the last ends after the last newline of its second half.
    The next one starts ``overlap`` before that end, or at the end when that
    would not advance; so one extra tail chunk of ``overlap`` characters follows
    the last full chunk.
    """
    length = F.length(text)
    if size <= 0:
        return F.array(F.struct(F.lit(0).alias("off"), length.alias("len")))
    advance = max(size // 2 + 1 - overlap, 1)
    bound = F.floor(length / advance).cast("int") + 2

    def step(st, _):
        hard = F.least(st.pos + size, length)
        low = st.pos + size // 2
        tail = F.reverse(text.substr(low + 1, F.greatest(hard - low, F.lit(0))))
        back = F.instr(tail, "\n")
        end = F.when((hard < length) & (back > 0), hard - back + 1).otherwise(hard)
        nxt = F.when(end - overlap <= st.pos, end).otherwise(end - overlap)
        live = st.pos < length
        return (
            F.struct(F.when(live, nxt).otherwise(st.pos).alias("pos")),
            live,
            F.struct(st.pos.alias("off"), (end - st.pos).alias("len")),
        )

    chunks = fold_emit(
        F.sequence(F.lit(1), bound), F.struct(F.lit(0).alias("pos")), step, CHUNK
    )
    whole = F.array(F.struct(F.lit(0).alias("off"), length.alias("len")))
    return F.when(length <= size, whole).otherwise(chunks)


def shift(cands: Column, off: Column) -> Column:
    return F.transform(
        cands,
        lambda c: candidate(c.start + off, c.end + off, c.entity, c.score, c.source, c.pattern,
                            c.label, c.forced_reason, c.ord, c.original),
    )


def with_candidates(docs: DataFrame, policy: Policy, matchers: Sequence[DictMatcher] = (),
                    patterns: Sequence[Pattern] = DEFAULT_PATTERNS,
                    allow: str = "allow", kinds: str | None = None) -> DataFrame:
    """Add ``tier`` and ``candidates``; reads ``text`` and the allow-list column.

    ``kinds`` names the column that ``dictionary.with_terms`` made from a table of terms.

    The full tier is the chunked tier with one chunk, and the only one unless the policy
    sets limits: what is found does not depend on how long a text is.  Everything stays in the
    row of the document.
    """
    text = F.col("text")
    docs = docs.withColumn("tier", tier(F.length(text), policy))
    if policy.force_fast:
        return docs.withColumn("candidates", detect_fast(text, F.col(allow), patterns))

    bounds = F.when(
        F.col("tier") != "fast", chunk_bounds(text, policy.chunk_size, policy.chunk_overlap)
    )
    docs = docs.withColumn(
        "chunks",
        F.transform(
            bounds,
            lambda b: F.struct(b.off.alias("off"), text.substr(b.off + 1, b.len).alias("text")),
        ),
    )
    def dict_spans(t: Column) -> list[Column]:
        first = len(patterns)
        found = [m.spans(t, ord=first + i) for i, m in enumerate(matchers)]
        return found + ([kind_spans(t, F.col(kinds), first + len(matchers))] if kinds else [])

    def one_chunk(c: Column) -> Column:
        dicts = dict_spans(c.text)
        found = full_candidates(c.text, patterns, F.concat(*dicts) if dicts else None)
        return shift(finish_full(found, F.col(allow), policy.priorities), c.off)

    merged = resolve_first(F.flatten(F.transform("chunks", one_chunk)), policy.priorities)
    if policy.fast_threshold_chars > 0:
        fast = detect_fast(text, F.col(allow), patterns)
        merged = F.when(F.col("tier") == "fast", fast).otherwise(merged)
    return docs.withColumn("candidates", merged).drop("chunks")


def detect(docs: DataFrame, patterns: Sequence[Pattern] = DEFAULT_PATTERNS,
           allow: Column | None = None) -> DataFrame:
    """One row per candidate of the fast tier."""
    found = detect_fast(F.col("text"), allow, patterns)
    return (
        docs.select("doc_id", F.explode_outer(found).alias("c"))
        .where(F.col("c").isNotNull())
        .select("doc_id", F.col("c.start"), F.col("c.end"), F.col("c.entity"),
                F.col("c.score"), F.col("c.pattern"), F.col("c.original"))
    )


def detect_pattern(docs: DataFrame, pattern: Pattern) -> DataFrame:
    """One row per match of one pattern."""
    found = _matches(F.col("text"), pattern)
    return (
        docs.select("doc_id", F.explode_outer(found).alias("m"))
        .where(F.col("m").isNotNull())
        .select("doc_id", F.col("m.s").alias("start"), F.col("m.e").alias("end"),
                F.lit(pattern.entity).alias("entity"), F.lit(pattern.score).alias("score"),
                F.col("m.m").alias("original"))
    )
