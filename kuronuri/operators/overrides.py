"""Forced masks, keep-spans and one-off allow-lists given per document."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.functions.spans import priority
from kuronuri.operators.ordinals import running


@dataclass(frozen=True)
class Overrides:
    """Tables keyed by ``doc_id``.

    ``forced(doc_id, start, end, entity, label, reason)``, ``keep(doc_id, start,
    end)`` and ``once_allow(doc_id, term)``.
    """

    forced: DataFrame | None = None
    keep: DataFrame | None = None
    once_allow: DataFrame | None = None


def normalize_forced(forced: DataFrame) -> DataFrame:
    """Whole-number spans with ``0 <= start < end``; entity and reason filled in."""

    def col(name: str, default: str | None = None) -> Column:
        c = F.col(name) if name in forced.columns else F.lit(None)
        c = c.cast("string")
        return F.coalesce(c, F.lit(default)) if default else c

    return (
        forced.select(
            "doc_id",
            F.col("start").try_cast("int").alias("start"),
            F.col("end").try_cast("int").alias("end"),
            col("entity", "CUSTOM").alias("entity"),
            col("label").alias("label"),
            col("reason", "forced:mask_once").alias("reason"),
        )
        .where((F.col("start") >= 0) & (F.col("start") < F.col("end")))
    )


def normalize_keep(keep: DataFrame) -> DataFrame:
    return (
        keep.select("doc_id", F.col("start").try_cast("int").alias("start"),
                    F.col("end").try_cast("int").alias("end"))
        .where((F.col("start") >= 0) & (F.col("start") < F.col("end")))
    )


def forced_arrays(forced: DataFrame, priorities: Mapping[str, int]) -> DataFrame:
    """One ``forced`` array per document.

    Of several forced spans with one start, only the best can survive the fold
    (all others overlap what it overlaps and rank lower), so the rest is dropped
    before rows of a document meet.
    """
    f = normalize_forced(forced)
    rank = F.struct(
        (-priority(F.col("entity"), priorities)).alias("pr"),
        (-F.col("end")).alias("len"),
        F.coalesce("label", F.lit("")).alias("label"), F.col("reason").alias("reason"),
        F.col("entity").alias("entity"),
    )
    best = f.groupBy("doc_id", "start").agg(
        F.min_by(F.struct("end", "entity", "label", "reason"), rank).alias("v")
    )
    item = F.struct(
        "start", F.col("v.end").alias("end"), F.col("v.entity").alias("entity"),
        F.col("v.label").alias("label"), F.col("v.reason").alias("reason"),
    )
    return best.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("forced"))


def keep_arrays(keep: DataFrame) -> DataFrame:
    """One ``keep`` array per document; per start the longest span says it all."""
    longest = normalize_keep(keep).groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    return longest.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("keep")
    )


def allow_arrays(once_allow: DataFrame) -> DataFrame:
    return (
        once_allow.where(F.col("term").isNotNull()).select("doc_id", "term").distinct()
        .groupBy("doc_id").agg(F.sort_array(F.collect_list("term")).alias("once"))
    )


def with_overrides(docs: DataFrame, overrides: Overrides | None,
                   priorities: Mapping[str, int] = vocab.PRIORITIES) -> DataFrame:
    """Add array columns ``forced``, ``keep`` and ``once`` (empty where nothing is given)."""
    o = overrides or Overrides()
    types = {
        "forced": "array<struct<start:int,end:int,entity:string,label:string,reason:string>>",
        "keep": "array<struct<start:int,end:int>>",
        "once": "array<string>",
    }
    sides = {
        "forced": None if o.forced is None else forced_arrays(o.forced, priorities),
        "keep": None if o.keep is None else keep_arrays(o.keep),
        "once": None if o.once_allow is None else allow_arrays(o.once_allow),
    }
    for name, side in sides.items():
        none = F.array().cast(types[name])
        if side is None:
            docs = docs.withColumn(name, none)
        else:
            docs = docs.join(side, "doc_id", "left").withColumn(name, F.coalesce(name, none))
    return docs


def keep_anti(spans: DataFrame, keep: DataFrame) -> DataFrame:
    """Spans that overlap no keep-span, for tables of any shape.

    A span overlaps a keep-span exactly when the largest keep end among keep-spans
    that start before the span's end lies behind the span's start.  That is a
    running maximum over both tables by position: no pairs are made.
    """
    cols = spans.columns
    marks = normalize_keep(keep).groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    row = F.struct(*cols)
    both = spans.select(
        "doc_id", F.col("end").alias("__pos"), F.lit(0).alias("__kind"),
        F.lit(None).cast("int").alias("__until"), row.alias("__row"),
    ).unionByName(
        marks.select(
            "doc_id", F.col("start").alias("__pos"), F.lit(1).alias("__kind"),
            F.col("end").alias("__until"),
            F.lit(None).cast(spans.select(row.alias("r")).schema["r"].dataType).alias("__row"),
        )
    )
    out = running(both, ["doc_id"], "__pos", F.col("__until"), "__reach", "max",
                  ties=["__kind"])
    return (
        out.where(F.col("__kind") == 0)
        .where(F.col("__reach").isNull() | (F.col("__reach") <= F.col("__row.start")))
        .select("__row.*")
    )
