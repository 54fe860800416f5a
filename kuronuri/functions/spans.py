"""Spans inside one document: overlap test, resolving folds and splicing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.functions.arrays import count_below, fold_emit, let
from kuronuri.functions.text import cut

CANDIDATE = (
    "struct<start:int,end:int,entity:string,score:double,source:string,pattern:string,"
    "label:string,forced_reason:string,ord:int,original:string>"
)


def candidate(start, end, entity, score, source="analyzer", pattern=None, label=None,
              forced_reason=None, ord=0, original=None) -> Column:
    def s(v):
        return v if isinstance(v, Column) else F.lit(v).cast("string")

    def n(v, t):
        return (v if isinstance(v, Column) else F.lit(v)).cast(t)

    return F.struct(
        n(start, "int").alias("start"), n(end, "int").alias("end"), s(entity).alias("entity"),
        n(score, "double").alias("score"), s(source).alias("source"),
        s(pattern).alias("pattern"), s(label).alias("label"),
        s(forced_reason).alias("forced_reason"), n(ord, "int").alias("ord"),
        s(original).alias("original"),
    )


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open intervals share at least one position."""
    return (a_start < b_end) & (a_end > b_start)


def priority(entity: Column, priorities: Mapping[str, int]) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, value in priorities.items():
        out = out.when(entity == name, F.lit(int(value)))
    return out.otherwise(F.lit(0))


def better_key(c: Column, priorities: Mapping[str, int]) -> Column:
    """Smaller is better: forced, then priority, length and score."""
    return F.struct(
        F.when(c.source == "forced", 0).otherwise(1).alias("src"),
        (-priority(c.entity, priorities)).alias("pr"),
        (c.start - c.end).alias("len"),
        (-c.score).alias("score"),
    )


def _resolve(cands: Column, priorities: Mapping[str, int], order) -> Column:
    keyed = F.sort_array(
        F.transform(
            cands,
            lambda c, i: F.struct(
                c.start.alias("start"),
                order(c, i).alias("order"),
                better_key(c, priorities).alias("key"),
                c.alias("c"),
            ),
        )
    )
    def step(st, x):
        overlaps = st.prev.isNotNull() & (x.start < st.prev.c.end)
        keep_prev = overlaps & ~(x.key < st.prev.key)
        nxt = F.when(keep_prev, st.prev).otherwise(x)
        return F.struct(nxt.alias("prev")), st.prev.isNotNull() & ~overlaps, st.prev.c

    row = (
        "struct<start:int,order:{order},"
        "key:struct<src:int,pr:int,len:int,score:double>,c:" + CANDIDATE + ">"
    ).format(order=order.ddl)
    init = F.struct(F.lit(None).cast(row).alias("prev"))
    return fold_emit(
        keyed, init, step, CANDIDATE, last=lambda st: (st.prev.isNotNull(), st.prev.c)
    )


def _order_first(c: Column, i: Column) -> Column:
    return F.struct((c.start - c.end).alias("len"), i.alias("pos"))


_order_first.ddl = "struct<len:int,pos:int>"


def resolve_first(cands: Column, priorities: Mapping[str, int] = vocab.PRIORITIES) -> Column:
    """Drop overlaps by (priority, length, score), walking by start, longest first.

    Equal rank keeps the earlier one; on a full tie, array order decides.
    """
    return _resolve(cands, priorities, _order_first)


def resolve_final(cands: Column, priorities: Mapping[str, int] = vocab.PRIORITIES) -> Column:
    """Drop overlaps of analyzer and forced spans; a forced span always wins."""

    def order(c: Column, i: Column) -> Column:
        key = better_key(c, priorities)
        return F.struct(key.alias("key"), i.alias("pos"))

    order.ddl = "struct<key:struct<src:int,pr:int,len:int,score:double>,pos:int>"
    return _resolve(cands, priorities, order)


def drop_kept(spans: Column, keep: Column) -> Column:
    """Remove spans that overlap any keep-span.

    Keep-spans are sorted by start, each with the farthest end up to it.  Of those that start before a
    span's end, found by halving, the farthest end tells whether one overlaps.
    """
    by_start = F.sort_array(
        F.transform(keep, lambda k: F.struct(k.start.alias("start"), k.end.alias("end"))))

    def step(st, k):
        far = F.greatest(st.far, k.end)  # skips nulls
        return F.struct(far.alias("far")), F.lit(True), F.struct(
            k.start.alias("start"), far.alias("far"))

    reach = fold_emit(
        by_start, F.struct(F.lit(None).cast("int").alias("far")), step, "struct<start:int,far:int>")

    def outside(spans_: Column, ks: Column) -> Column:
        def free(r: Column) -> Column:
            n = count_below(ks, F.size(ks), lambda k: k.start < r.end)
            return ~F.coalesce(F.get(ks, n - 1).far > r.start, F.lit(False))

        return F.filter(spans_, free)

    return F.when(F.size(keep) <= 0, spans).otherwise(let(reach, lambda ks: outside(spans, ks)))


def splice(pieces: Column, length: Column, edits: Column) -> Column:
    """Text with each ``(start, end, out)`` edit put in place, in one walk.

    The cursor never moves back, so text under an edit is not written again.
    """

    def step(st, x):
        start = F.least(x.start, length)
        return (
            F.struct(F.greatest(st.pos, x.end).alias("pos")),
            F.lit(True),
            F.concat(cut(pieces, st.pos, start), x.out),
        )

    out = fold_emit(
        edits, F.struct(F.lit(0).alias("pos")), step, "string",
        last=lambda st: (st.pos < length, cut(pieces, st.pos, length)),
    )
    return F.array_join(out, "")


def splice_reviewed(pieces: Column, length: Column, edits: Column) -> Column:
    """Like :func:`splice`, but an edit that starts before the cursor is left out."""

    def step(st, x):
        use = x.start >= st.pos
        return (
            F.struct(F.when(use, x.end).otherwise(st.pos).alias("pos")),
            use,
            F.concat(cut(pieces, st.pos, x.start), x.out),
        )

    out = fold_emit(
        edits, F.struct(F.lit(0).alias("pos")), step, "string",
        last=lambda st: (st.pos < length, cut(pieces, st.pos, length)),
    )
    return F.array_join(out, "")


def company_expand_end(pieces: Column, length: Column, original: Column, end: Column) -> Column:
    """New end of a company span that holds only a designator: take in the name on its right."""
    body = "".join("\\" + ch if ch in "[]\\^-&" else ch for ch in vocab.COMPANY_BOUNDARIES)
    rx = f"^[ \\t\\r\\n]*[^{body}]{{0,{vocab.COMPANY_BODY_MAX}}}"
    grown = end + F.length(F.regexp_extract(cut(pieces, end, length), rx, 0))
    return F.when(original.isin(*vocab.COMPANY_DESIGNATORS), grown).otherwise(end)
