"""Connected components of links, by stars, in tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuronuri.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """``key, root`` for every key of ``links(a, b)``: ``root`` is the least key it reaches.

    Every round hangs the neighbours of a key on their least one, once looking at the larger and
    once at the smaller ones; the number of rounds grows with the logarithm of the longest path.
    A round reads tables only; nothing but two numbers comes to the driver.
    """
    edges = stored(
        links.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Larger neighbours of a key go to the least of its neighbours and itself.
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(
            F.col("m").alias("a"), "b").where(F.col("a") != F.col("b")).distinct()
        # Smaller neighbours, and the key itself, go to the least of them.
        root = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(root, "b")
        edges = stored(
            small.select(F.col("m").alias("a"), F.col("a").alias("b"))
            .union(small.select(F.col("m").alias("a"), "b"))
            .where(F.col("a") != F.col("b")).distinct(), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = edges.select(F.col("b").alias("key"), F.col("a").alias("root"))
    return roots.union(edges.select(F.col("a").alias("key"), F.col("a").alias("root")).distinct())
