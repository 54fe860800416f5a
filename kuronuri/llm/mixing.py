"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Works on documents ``docs(doc_id, text, source)``.  The library's own records name no source of a
document, so the operator takes the column's name.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kuronuri.llm.tables import WORD, docs_of, stored, words
from kuronuri.operators.ordinals import row_number_in, running

#: Slices of a source by the documents' random number; only the slice in which the target falls is
#: put in order.
SLICES = 1 << 12


def sizes(docs: DataFrame, source: str = "source") -> DataFrame:
    """``doc_id, source, text_hash, size``: words of every whole text."""
    return docs_of(docs, F.col(source).alias("source")).select(
        "doc_id", "source", F.xxhash64("text").alias("text_hash"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"),
    )


def _draw(seed: int) -> Column:
    """A whole number below 2**32 that depends on seed and document only."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def targets(sized: DataFrame, weights: Sequence[float], share: float,
            max_epochs: float) -> DataFrame:
    """``source, source_size, target``: what water-filling gives each source.

    Sources by code point, null last, weigh ``weights`` in turn.  ``share`` of all sizes is dealt
    out by weight; a source above ``max_epochs`` of its own size is clamped there, and the excess
    goes to the others by weight until none is above.  The level where this ends is found at once:
    a source is clamped just when its cap over its weight is below the level, so that running
    totals over the sources in that order tell the level (all in tables: one row per source).
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on.  Positions come from bucketed running totals.
    first = F.coalesce(F.conv(F.hex(F.substring(F.encode("source", "UTF-8"), 1, 3)), 16, 10)
                       .cast("long"), F.lit(0))
    named = totals.select(
        F.lit(0).alias("g"), "source", "source_size",
        # Null last; else the first bytes part the sources into buckets in code point order.
        F.when(F.col("source").isNull(), F.lit(1 << 25)).otherwise(
            first * F.pow(F.lit(256), 3 - F.least(F.lit(3), F.octet_length("source"))).cast("long")
        ).alias("lead"),
    )
    ranked = row_number_in(named, ["g"], "lead", "n", width=1 << 12, ties=["source"])
    ws = F.array(*[F.lit(float(w)) for w in weights])
    weighed = ranked.select(
        "g", "source", "source_size",
        ws[(F.col("n") - 1) % len(weights)].alias("weight"),
        (F.col("source_size") * max_epochs).alias("cap"),
    ).withColumn("level", F.col("cap") / F.col("weight"))
    ordered = weighed.withColumn("bucket", F.floor(F.log2(F.col("level") + 1) * 64).cast("long"))
    inside = W.partitionBy("bucket").orderBy("level", "source").rowsBetween(
        W.unboundedPreceding, -1)
    per_bucket = ordered.groupBy("bucket").agg(
        F.sum("cap").alias("cap_sum"), F.sum("weight").alias("weight_sum"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # At most 64 * 63 buckets, whatever the number of sources.
    bases = per_bucket.select(
        "bucket", F.coalesce(F.sum("cap_sum").over(before), F.lit(0.0)).alias("cap_base"),
        F.coalesce(F.sum("weight_sum").over(before), F.lit(0.0)).alias("weight_base"))
    total, weight_total = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    filled = (
        ordered.withColumns({
            "cap_in": F.coalesce(F.sum("cap").over(inside), F.lit(0.0)),
            "weight_in": F.coalesce(F.sum("weight").over(inside), F.lit(0.0)),
        }).join(bases, "bucket")
        # The level if just the sources below this one are clamped.
        .withColumn("rise", (F.lit((total or 0) * share) - F.col("cap_base") - F.col("cap_in"))
                    / (F.lit(weight_total) - F.col("weight_base") - F.col("weight_in")))
    )
    # The first source that stays under its cap fixes the level (of equals, the one that rises
    # highest); none does if all caps together are too low.
    water = filled.where(F.col("rise") < F.col("level")).agg(
        F.min_by("rise", F.struct(F.col("level"), -F.col("rise")))).first()[0]
    return weighed.select(
        "source", "source_size",
        (F.col("cap") if water is None else F.least(F.col("cap"), F.lit(water) * F.col("weight")))
        .alias("target"),
    )


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0), share: float = 1.5,
                max_epochs: float = 2.0, seed: int = 17, source: str = "source") -> DataFrame:
    """How often each document is taken: ``repeats`` times whole and then its first ``part`` words.

    Returns ``doc_id, source, text_hash, size, source_size, target, repeats, part``.

    A source with target ``t`` and size ``s`` takes each document ``floor(t / s)`` times whole
    (``repeats``) and once more those that come first in a seeded order, until the rest is used up;
    the document where it runs out gives its first ``part`` words.  So a source's words meet its
    target to one word, and no document exceeds ``ceil(max_epochs)`` repetitions.  The draw depends
    on seed and ``doc_id`` only: reruns agree.  Rows that repeat are documents of their own; null
    source is a source; null text has size 0 and is taken 0 times in part.  Empty input gives no
    rows.
    """
    # The texts are read once; what follows works on this narrow table.
    sized = stored(sizes(docs, source).withColumn("draw", _draw(seed)).withColumn(
        "slice", F.shiftright("draw", 20)), "sizes")
    goals = targets(sized, weights, share, max_epochs)
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)) + 1e-12)
    goals = goals.withColumn("whole", whole.cast("long")).withColumn(
        "rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("whole") * F.col("source_size"))
                           ).cast("long"))
    # Sizes per slice of a source, added up over at most SLICES slices.
    over = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")).select(
        "source", "slice", "slice_size",
        F.coalesce(F.sum("slice_size").over(over), F.lit(0)).alias("base"))
    k = slices.alias("s").join(goals.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")))
    plan = k.select(
        F.col("s.source").alias("k_source"), F.col("slice").alias("k_slice"), "source_size", "target",
        "whole", F.least(F.greatest(F.col("rest") - F.col("base"), F.lit(0)), F.col("slice_size"))
        .alias("room"), "slice_size",
    )
    rows = sized.join(
        plan, F.col("source").eqNullSafe(F.col("k_source")) & (F.col("slice") == F.col("k_slice")))
    edge = (F.col("room") > 0) & (F.col("room") < F.col("slice_size"))
    by_draw = W.partitionBy("source", "slice").orderBy("draw", "doc_id", "size").rowsBetween(
        W.unboundedPreceding, -1)
    columns = ["doc_id", "source", "text_hash", "size", "source_size", "target", "whole"]
    inner = rows.where(edge).withColumn(
        "left", F.col("room") - F.coalesce(F.sum("size").over(by_draw), F.lit(0))
    ).select(*columns, F.least(F.greatest("left", F.lit(0)), "size").alias("more"))
    outer = rows.where(~edge).select(
        *columns, F.when(F.col("room") > 0, F.col("size")).otherwise(0).alias("more"))
    taken_whole = (F.col("more") == F.col("size")) & (F.col("size") > 0)
    return inner.unionByName(outer).select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        (F.col("whole") + taken_whole.cast("long")).alias("repeats"),
        F.when(taken_whole, 0).otherwise(F.col("more")).cast("long").alias("part"),
    )


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5.0, 2.0, 1.0),
                    share: float = 1.5, max_epochs: float = 2.0, seed: int = 17,
                    source: str = "source") -> DataFrame:
    """The mix itself: all columns of ``docs``, a row per repetition of a document.

    A document taken in part has its first words, with a blank between.  Rows of one ``doc_id``
    and text count together, so that rows that repeat stay as many as the mix takes of them.
    """
    plan = mix_sources(docs, weights, share, max_epochs, seed, source).groupBy(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
        F.col("text_hash").alias("__hash")
    ).agg(F.sum("repeats").alias("__repeats"), F.collect_list(
        F.when(F.col("part") > 0, F.col("part"))).alias("__parts"))
    rows = docs.withColumn("__text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    one = rows.dropDuplicates(["doc_id", source, "__text_hash"])
    taken = one.join(plan, F.col("doc_id").eqNullSafe(F.col("__id"))
                     & F.col(source).eqNullSafe(F.col("__source"))
                     & (F.col("__text_hash") == F.col("__hash")))
    whole = F.array_repeat(F.lit(None).cast("long"), F.col("__repeats").cast("int"))
    copies = taken.withColumn("__part", F.explode(F.concat(whole, F.col("__parts"))))
    return copies.withColumn(
        "text", F.when(F.col("__part").isNull(), F.col("text")).otherwise(
            F.array_join(F.slice(words(F.col("text")), F.lit(1), F.col("__part").cast("int")), " "))
    ).select(*docs.columns)
