"""Importance resampling: documents drawn by how much their words look like those of a target.

Hashed n-gram counts of the documents and of the target give every bucket a gain; a document
weighs the sum of its features' gains, and a seeded Gumbel term per document turns the ranking into
a draw without replacement.

Newlines separate words, so texts are cut into lines.  A line that stands in many documents (or
many times in one) is taken apart once: its features are counted once, times its occurrences, and
its weight is worked out once and added wherever the line stands.  N-grams that reach over a line
end are in no line; they come from the ends of lines, document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri.llm.decontaminate import item_words
from kuronuri.llm.positions import in_order
from kuronuri.llm.tables import docs_of, stored

#: Lines with one part in so many of all lines are joined by broadcast: never more than this.
HOT_LINES = 1000


def _bucket(gram: Column, buckets: int) -> Column:
    return (F.crc32(F.encode(gram, "UTF-8")) % buckets).cast("int")


def _places(items: Column, k: int) -> Column:
    """First places of all runs of ``k`` items, from 1."""
    return F.when(F.size(items) >= k, F.sequence(F.lit(1), F.size(items) - (k - 1))).otherwise(
        F.array().cast("array<int>"))


def _runs(words: Column, k: int, buckets: int) -> Column:
    if k == 1:
        return F.transform(words, lambda w: _bucket(w, buckets))
    return F.transform(
        _places(words, k),
        lambda i: _bucket(F.array_join(F.slice(words, i, F.lit(k)), " "), buckets))


def _crossing(lines: Column, n: int, buckets: int) -> Column:
    """Buckets of the runs of 2 to ``n`` words that reach over a line end."""
    if n == 1:
        return F.lit(None).cast("array<int>")
    token = "array<struct<line:int,word:string>>"

    def ends(line: Column, j: Column) -> Column:
        ws = F.transform(
            item_words(line), lambda w: F.struct(j.alias("line"), w.alias("word")))
        gap = F.array(F.struct(j.alias("line"), F.lit(None).cast("string").alias("word")))
        return F.transform(
            F.array(ws), lambda v: F.when(F.size(v) <= 2 * (n - 1), v.cast(token)).otherwise(
                F.concat(F.slice(v, 1, n - 1), gap, F.slice(v, 1 - n, n - 1)).cast(token)))[0]

    def over(tokens: Column, k: int) -> Column:
        runs = F.transform(_places(tokens, k), lambda i: F.slice(tokens, i, F.lit(k)))
        kept = F.filter(
            runs, lambda r: (F.get(r, F.lit(0)).line != F.get(r, F.lit(k - 1)).line)
            & ~F.exists(r, lambda t: t.word.isNull()))
        return F.transform(
            kept, lambda r: _bucket(F.array_join(F.transform(r, lambda t: t.word), " "), buckets))

    tokens = F.flatten(F.transform(lines, ends))
    return F.transform(
        F.array(tokens), lambda v: F.concat(*[over(v, k) for k in range(2, n + 1)]))[0]


def _lines_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"),
                       F.split("text", "\n", -1).alias("lines"))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def line_places(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """``row, doc_id, key, crossing``: where every line stands; ``crossing`` once a row."""
    cut = _lines_of(docs)
    cut = cut.withColumn("crossing", _crossing(F.col("lines"), n, buckets))
    at = cut.select("row", "doc_id", "crossing", F.posexplode("lines").alias("i", "line"))
    return at.select("row", "doc_id", _key(F.col("line")).alias("key"),
                     F.when(F.col("i") == 0, F.col("crossing")).alias("crossing"))


def distinct_lines(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """``key, occurrences, n_words, features``: every line once, with its features' buckets."""
    lines = docs.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(
        F.count("*").alias("occurrences"))
    lines = lines.withColumn("ws", item_words(F.col("line")))
    features = F.concat(*[_runs(F.col("ws"), k, buckets) for k in range(1, n + 1)])
    return lines.select(_key(F.col("line")).alias("key"), "occurrences",
                        F.size("ws").cast("long").alias("n_words"), features.alias("features"))


def feature_counts(lines: DataFrame, places: DataFrame) -> DataFrame:
    """``bucket, n``: features of all texts, lines times their occurrences plus crossing runs."""
    inside = lines.select(F.explode("features").alias("bucket"), "occurrences").groupBy(
        "bucket").agg(F.sum("occurrences").alias("n"))
    across = places.select(F.explode("crossing").alias("bucket")).groupBy("bucket").agg(
        F.count("*").alias("n"))
    return inside.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket, in thousandths of a nat, rounded down: ``buckets`` numbers."""
    spark = source.sparkSession
    joined = (
        spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(source.select("bucket", F.col("n").alias("s")), "bucket", "left")
        .join(target.select("bucket", F.col("n").alias("t")), "bucket", "left")
        .select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    )
    joined = stored(joined, "bucket-counts")
    total = joined.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    gain = F.floor(1000 * F.ln(
        ((F.col("t") + 1) * (F.col("all_s") + buckets))
        / ((F.col("s") + 1) * (F.col("all_t") + buckets))))
    rows = joined.crossJoin(F.broadcast(total)).select("bucket", gain.alias("gain")).collect()
    return [r.gain for r in sorted(rows)]


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000,
             percent: int = 10, min_words: int = 20, seed: int = 2024) -> DataFrame:
    """Rank ``docs(doc_id, text)`` for a draw that resembles ``target(text)``.

    The target may be other documents, such as contracts that were reviewed.  Returns one row per
    document: ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank``.  Of the documents with
    at least ``min_words`` words, ``percent`` of a hundred (rounded down) are drawn: those with the
    highest scores, ties to the smaller ``doc_id``; ``rank`` counts them from 1 and is null for all
    others.

    Features are all runs of 1 to ``n`` words.  Null texts have none and weigh 0; a null ``doc_id``
    counts as an empty string in the seed and ranks before others; a repeated document has a row
    each time and may be drawn each time.  Without a target all buckets have the same gain; without
    documents there are no rows.  Other columns are not read.  The driver sees ``buckets`` gains and
    two counts, whatever the size of the tables.
    """
    docs = docs_of(docs)
    wanted = target.select(F.lit(None).cast("string").alias("doc_id"),
                           F.coalesce("text", F.lit("")).alias("text"))
    places = stored(line_places(docs, n, buckets), "line-places")
    lines = stored(distinct_lines(docs, n, buckets), "lines")
    gains = bucket_gains(
        feature_counts(lines, places),
        feature_counts(distinct_lines(wanted, n, buckets), line_places(wanted, n, buckets)), buckets)
    table = F.lit(gains).cast("array<bigint>")

    def weight(features: Column) -> Column:
        return F.aggregate(features, F.lit(0).cast("long"), lambda a, b: a + F.get(table, b))

    weighed = stored(lines.select(
        "key", "occurrences", "n_words", F.size("features").cast("long").alias("n_features"),
        weight(F.col("features")).alias("weight")), "line-weights")
    all_lines = weighed.agg(F.sum("occurrences")).first()[0] or 0
    frequent = F.col("occurrences") * HOT_LINES >= all_lines
    hot = F.broadcast(weighed.where(frequent).drop("occurrences"))
    seen = places.join(hot, "key").unionByName(
        places.join(hot.select("key"), "key", "left_anti").join(
            weighed.where(~frequent).drop("occurrences"), "key"))
    extra = F.coalesce("crossing", F.array().cast("array<int>"))
    sums = seen.groupBy("row", "doc_id").agg(
        F.sum("n_words").alias("n_words"),
        F.sum(F.col("n_features") + F.size(extra)).alias("n_features"),
        F.sum(F.col("weight") + weight(extra)).alias("weight"),
    )
    salted = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(salted, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = stored(
        sums.withColumn("score", F.col("weight") + noise).drop("row"), "scores")
    enough = F.col("n_words") >= min_words
    drawn = scored.where(enough).count() * percent // 100
    ranked = in_order(
        scored.where(enough), [F.col("score").desc(), F.col("doc_id").asc_nulls_first()], "at")
    rank = F.when(F.col("at") < drawn, F.col("at") + 1)
    return ranked.withColumn("rank", rank).drop("at").unionByName(
        scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    ).select("doc_id", "n_features", "weight", "score", "rank")
