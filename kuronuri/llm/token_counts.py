"""Token counts: an exact histogram of encoded lengths answers every context limit.

Works on the library's documents ``docs(doc_id, text)``: they are encoded once, counted by length,
and suffix sums over the short table of lengths give totals, quantiles and truncated totals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kuronuri.llm.bpe import read_vocabulary, tokenizer_of
from kuronuri.llm.tables import docs_of, stored
from kuronuri.operators.ordinals import running


def encoded_lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``n_tokens, n_docs``: how many documents of a piece of the input have each length.

    Null and empty texts have length 0.  Lengths are counted where they arise, so that a row stands
    for all documents of one length in an Arrow batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer_of(shared.value)
        for batch in batches:
            seen: dict[int, int] = {}
            for text in batch.column(0):
                n = len(tok.encode(text.as_py())) // 4
                seen[n] = seen.get(n, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())],
                ["n_tokens", "n_docs"])

    return docs_of(docs).select("text").mapInArrow(count, "n_tokens long, n_docs long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """One row per distinct ``n_tokens``, with sums over documents at least so long.

    ``lengths`` has ``n_tokens, n_docs``; rows of one length are added up, rows without a length are
    left out, other columns too.  Returns ``n_tokens, n_docs, docs_from, tokens_from`` (documents of
    this length or more, and their tokens), ``tokens_cut`` (tokens left when every document is cut
    to this length) and ``share_to`` (share of documents of this length or less: quantiles).  The
    positions of the running sums are the lengths themselves, dealt in buckets; no task holds
    all.  Empty input gives no rows.
    """
    hist = stored(
        lengths.where(F.col("n_tokens").isNotNull()).groupBy("n_tokens")
        .agg(F.sum("n_docs").alias("n_docs")), "lengths")
    total = hist.agg(F.sum("n_docs").alias("docs"),
                     F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    one = hist.withColumn("g", F.lit(0))
    docs_before = running(one, ["g"], "n_tokens", F.col("n_docs"), "docs_before")
    both = running(docs_before, ["g"], "n_tokens", F.col("n_docs") * F.col("n_tokens"),
                   "tokens_before")
    return both.join(total.withColumn("g", F.lit(0)), "g").select(
        "n_tokens", "n_docs",
        (F.col("docs") - F.col("docs_before")).alias("docs_from"),
        (F.col("tokens") - F.col("tokens_before")).alias("tokens_from"),
        (F.col("tokens_before")
         + F.col("n_tokens") * (F.col("docs") - F.col("docs_before"))).alias("tokens_cut"),
        ((F.col("docs_before") + F.col("n_docs")) / F.col("docs")).alias("share_to"),
    )


def at_limits(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """``context, docs_over, tokens_cut``: documents longer than any limit, and tokens kept under it.

    Between two lengths of the histogram the suffix sums of the next longer one hold: documents
    from there on are cut, shorter ones whole.
    """
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(int(c),) for c in limits], "context long")
    over = F.col("n_tokens") > F.col("context")
    # The limits given are few; every row of the histogram is looked at once for each.
    pairs = histogram.withColumn("context", F.explode(F.array(*[F.lit(int(c)) for c in limits])))
    sums = pairs.groupBy("context").agg(
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
        F.sum(F.least("n_tokens", "context") * F.col("n_docs")).alias("tokens_cut"))
    return wanted.join(sums, "context", "left").select(
        "context", F.coalesce("docs_over", F.lit(0)).alias("docs_over"),
        F.coalesce("tokens_cut", F.lit(0)).alias("tokens_cut"))


def quantile_lengths(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """``share, n_tokens``: the least length that this share of all documents does not exceed."""
    pairs = histogram.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    return pairs.where(F.col("share_to") >= F.col("share")).groupBy("share").agg(
        F.min("n_tokens").alias("n_tokens"))
