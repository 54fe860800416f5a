"""What happens to a resolved span: keep or mask, and the text that replaces it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kuronuri.functions.arrays import fold_emit
from kuronuri.functions.text import (
    address_granular,
    black,
    date_granular,
    is_numbered,
    label,
    money_context,
)
from kuronuri.policy import Policy


def reason_of(r: Column, norm: Column, allow_norm: Column, pieces: Column, length: Column,
              mode: str) -> Column:
    """Why a span is kept or masked; the first rule that holds decides."""
    out = (
        F.when(r.source == "forced", r.forced_reason)
        .when(r.entity == "PARTIES", "keep:parties")
        .when((norm != "") & F.array_contains(allow_norm, norm), "keep:allowlist")
        .when(
            (r.entity == "MONEY") & ~money_context(pieces, length, r.start, r.end),
            "keep:money_no_context",
        )
    )
    if mode == "BLACK":
        return out.otherwise("mask:black")
    return (
        out.when(r.entity == "DATE", "mask:date_granular")
        .when(r.entity == "ADDRESS", "mask:address_granular")
        .otherwise("mask:stable_id")
    )


def stable_label(entity: Column, n: Column, policy: Policy) -> Column:
    """Label text for the ``n``-th value of an entity."""
    default = F.format_string("[%s_%02d]", entity, n)
    out = F.when(F.lit(False), F.lit(""))
    for name, template in policy.label_format.items():
        out = out.when(entity == name, label(template, n))
    return out.otherwise(default)


def numbered(entity: Column, policy: Policy) -> Column:
    fixed = [e for e, t in policy.label_format.items() if not is_numbered(t)]
    return ~entity.isin(*fixed) if fixed else F.lit(True)


def first_seen_numbers(keys: Column) -> Column:
    """Number of each ``struct<entity,norm>`` in order of first appearance per entity.

    Null keys get 0.  Three sorts and two walks: find the first position of every
    key, count first positions per entity, and put the rows back in order.
    """
    tagged = F.sort_array(
        F.transform(keys, lambda k, i: F.struct(k.entity.alias("e"), k.norm.alias("t"), i.alias("i")))
    )
    firsts = fold_emit(
        tagged,
        F.struct(F.lit(None).cast("string").alias("e"), F.lit(None).cast("string").alias("t"),
                 F.lit(0).alias("first")),
        lambda st, x: (
            F.struct(
                x.e.alias("e"), x.t.alias("t"),
                F.when(x.e.eqNullSafe(st.e) & x.t.eqNullSafe(st.t), st.first)
                .otherwise(x.i).alias("first"),
            ),
            F.lit(True),
            F.struct(
                x.e.alias("e"),
                F.when(x.e.eqNullSafe(st.e) & x.t.eqNullSafe(st.t), st.first)
                .otherwise(x.i).alias("first"),
                x.i.alias("i"),
            ),
        ),
        "struct<e:string,first:int,i:int>",
    )

    def count(st: Column, x: Column) -> Column:
        return (
            F.when(x.e.isNull(), 0)
            .when(~x.e.eqNullSafe(st.e), 1)
            .when(x.first == st.first, st.n)
            .otherwise(st.n + 1)
        )

    numbers = fold_emit(
        F.sort_array(firsts),
        F.struct(F.lit(None).cast("string").alias("e"), F.lit(-1).alias("first"),
                 F.lit(0).alias("n")),
        lambda st, x: (
            F.struct(x.e.alias("e"), x.first.alias("first"), count(st, x).alias("n")),
            F.lit(True),
            F.struct(x.i.alias("i"), count(st, x).alias("n")),
        ),
        "struct<i:int,n:int>",
    )
    return F.transform(F.sort_array(numbers), lambda x: x.n)


def replacement_of(r: Column, n: Column, policy: Policy) -> Column:
    """Replacement of a decided span ``struct<c,norm,reason>`` with its number."""
    c = r.c
    bar = black(c.original, policy.black_min_len)
    has_label = F.coalesce(c.label, F.lit("")) != ""
    numbered_label = stable_label(c.entity, n, policy)
    if policy.mode == "BLACK":
        forced = bar
    else:
        forced = F.when(has_label, c.label).otherwise(numbered_label)
    return (
        F.when(c.source == "forced", forced)
        .when(F.startswith(r.reason, F.lit("keep:")), c.original)
        .when(r.reason == "mask:black", bar)
        .when(r.reason == "mask:date_granular", date_granular(c.original))
        .when(
            r.reason == "mask:address_granular",
            address_granular(c.original, policy.address_granularity, policy.prefectures,
                             policy.municipalities),
        )
        .otherwise(numbered_label)
    )


def needs_number(r: Column, policy: Policy) -> Column:
    if policy.mode == "BLACK":
        return F.lit(False)
    forced = (r.c.source == "forced") & (F.coalesce(r.c.label, F.lit("")) == "")
    plain = (r.c.source != "forced") & (r.reason == "mask:stable_id")
    return (forced | plain) & numbered(r.c.entity, policy)


def is_review(h: Column, threshold: float) -> Column:
    low = (h.score != 0) & (h.score < threshold)
    return low | (h.reason == "keep:money_no_context") | (h.source == "forced")
