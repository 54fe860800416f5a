"""Benchmark decontamination: passages of test items that stand in documents, found and removed.

Items are cut into windows of ``n`` consecutive words (a shorter item is one window).  Their hashes
are broadcast in rounds of a fixed number of windows, and every window of every document is looked
up; a match counts only if the words themselves are equal.  A round is one pass over the texts
without a shuffle: only hits, and one narrow row a document, leave the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri.functions.arrays import fold_emit
from kuronuri.llm.tables import docs_of, stored

#: Lower-case ASCII letters, digits and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before letters are lowered.
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Windows in one broadcast; some 200 bytes each, so 40 MB, however large the benchmark is.
ROUND = 200_000
SPAN = "struct<first:int,last:int>"


def item_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``item_id, window, words``: the windows of ``benchmark(item_id, text)``, each once an item."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        item_words(F.coalesce("text", F.lit(""))).alias("ws"),
    ).where(F.size("ws") > 0)
    size = F.least(F.size("ws"), F.lit(n))
    cut = F.slice("ws", F.col("i"), F.col("size"))
    return items.select(
        "item_id", "ws", size.alias("size"),
        F.explode(F.sequence(F.lit(1), F.size("ws") - size + 1)).alias("i"),
    ).select("item_id", cut.alias("words")).distinct().withColumn(
        "window", F.md5(F.array_join("words", " ")))


def _places(docs: DataFrame, windows: DataFrame, lengths: list[int], heads: bool) -> DataFrame:
    """``doc_id, version, n_words, first, n_window, window``: where windows stand.

    ``first`` counts words from 1.  With ``heads``, every document also has a row with ``first = 0``.
    """
    words = docs.select(
        "doc_id", F.xxhash64("text").alias("version"), item_words(F.col("text")).alias("ws"))
    begin = F.lit(0) if heads else F.lit(1)
    end = F.greatest(F.size("ws") - (min(lengths) - 1), F.lit(0))
    if not heads:
        words = words.where(F.size("ws") >= min(lengths))
    at = words.select("doc_id", "version", "ws", F.explode(F.sequence(begin, end)).alias("first"))
    n = F.lit(lengths[0])
    if len(lengths) > 1:
        at = at.withColumn("n", F.explode(F.array(*[F.lit(k) for k in lengths])))
        n = F.col("n")
        at = at.where(
            ((F.col("first") > 0) & (F.col("first") + n - 1 <= F.size("ws")))
            | ((F.col("first") == 0) & (n == lengths[0])))
    cut = F.when(F.col("first") > 0, F.slice("ws", F.greatest("first", F.lit(1)), n))
    at = at.select(
        "doc_id", "version", F.size("ws").alias("n_words"), "first", n.alias("n_window"),
        cut.alias("cut"), F.xxhash64(cut).alias("hash"))
    side = windows.select("window", "words", F.xxhash64("words").alias("hash"))
    found = at.join(
        F.broadcast(side), (at["hash"] == side["hash"]) & (at["cut"] == side["words"]), "left")
    return found.where(F.col("window").isNotNull() | (F.col("first") == 0)).select(
        "doc_id", "version", "n_words", "first", "n_window", "window")


def _merged(starts: Column) -> Column:
    """Sorted ``array<struct<first,n_window>>`` to disjoint ``array<struct<first,last>>``."""
    def step(st, x):
        joins = st.first.isNotNull() & (x.first <= st.last + 1)
        end = x.first + x.n_window - 1
        return (
            F.struct(F.when(joins, st.first).otherwise(x.first).alias("first"),
                     F.when(joins, F.greatest(st.last, end)).otherwise(end).alias("last")),
            st.first.isNotNull() & ~joins, F.struct(st.first.alias("first"), st.last.alias("last")),
        )

    init = F.struct(F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
    return fold_emit(
        starts, init, step, SPAN,
        last=lambda st: (st.first.isNotNull(),
                         F.struct(st.first.alias("first"), st.last.alias("last"))))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW,
                       in_round: int = ROUND) -> DataFrame:
    """Which words of ``docs(doc_id, text)`` belong to windows of ``benchmark(item_id, text)``.

    The project has documents but no test items of its own, so the benchmark is any table of
    texts.  Returns one row per document: ``doc_id``, ``version`` (hash of the text), ``n_words``,
    ``n_hit``, ``spans`` (runs of hit words, from 1, both ends included) and ``items`` (ids of the
    items with an occurring window, sorted as strings).

    Null texts have no words; null item ids are read as empty strings; ids may be of any type.  A
    repeated document has a row each time; items with equal windows all count.  Without items or
    without documents, nothing is hit or returned.  Other columns are not read.  All windows of all
    texts are looked up at every size: a benchmark beyond ``in_round`` windows takes more passes.
    """
    docs = docs_of(docs)
    pairs = stored(item_windows(benchmark, n), "test-windows")
    windows = stored(
        pairs.select("window", "words").distinct(), "test-window-set")
    # At most n numbers, and one count.
    lengths = sorted(r[0] for r in windows.select(F.size("words")).distinct().collect()) or [n]
    rounds = max(1, -(-windows.count() // in_round))
    found = None
    for r in range(rounds):
        part = windows if rounds == 1 else windows.where(
            F.pmod(F.xxhash64("window"), F.lit(rounds)) == r)
        places = _places(docs, part, lengths, heads=r == 0)
        found = places if found is None else found.unionByName(places)
    found = stored(found, "test-places")
    heads = found.where(F.col("first") == 0).select("doc_id", "version", "n_words")
    hits = found.where(F.col("first") > 0)
    spans = hits.groupBy("doc_id", "version").agg(
        F.sort_array(F.collect_set(F.struct("first", "n_window"))).alias("starts")
    ).select(F.col("doc_id").alias("__d"), F.col("version").alias("__v"),
             _merged(F.col("starts")).alias("spans"))
    items = (
        hits.select("doc_id", "version", "window").distinct()
        .join(pairs.select("window", "item_id"), "window")
        .groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
        .select(F.col("doc_id").alias("__i"), F.col("version").alias("__w"), "items")
    )
    return (
        heads.join(spans, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("version") == F.col("__v")),
                   "left")
        .join(items, F.col("doc_id").eqNullSafe(F.col("__i")) & (F.col("version") == F.col("__w")),
              "left")
        .select(
            "doc_id", "version", F.col("n_words").cast("long").alias("n_words"),
            F.coalesce(F.aggregate("spans", F.lit(0).cast("long"),
                                   lambda a, s: a + s.last - s.first + 1), F.lit(0)).alias("n_hit"),
            F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
    )


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the words of ``spans`` and what stands between them."""
    words = F.regexp_extract_all(text, F.lit(ANY_CASE_WORD), F.lit(0))
    gaps = F.split(text, ANY_CASE_WORD, -1)
    n = F.size(words)
    # Every word with the gap in front of it; a span leaves its first gap.
    tokens = F.zip_with(F.slice(gaps, 1, n), words, lambda g, w: F.concat(g, w))
    bound = F.struct(tokens.alias("t"), gaps.alias("g"), spans.alias("s"), n.alias("n"))

    def cut(v: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), F.transform(v.s, lambda s: s.last))
        kept = F.zip_with(
            v.s, F.slice(before, 1, F.size(v.s)),
            lambda s, end: F.concat(
                F.array_join(F.slice(v.t, end + 1, s.first - 1 - end), ""),
                F.get(v.g, s.first - 1)))
        done = F.element_at(before, -1)
        tail = F.concat(F.array_join(F.slice(v.t, done + 1, v.n - done), ""), F.get(v.g, v.n))
        return F.concat(F.array_join(kept, ""), tail)

    return F.transform(F.array(bound), cut)[0]


def decontaminate(docs: DataFrame, benchmark: DataFrame, *keep: str, n: int = WINDOW,
                  drop_share: float = 1.0) -> DataFrame:
    """``docs`` without passages of the benchmark: ``doc_id, text`` and the columns ``keep``.

    Documents with more than ``drop_share`` of their words hit go as a whole (0: every document
    with a hit), the others lose the hit words.  Documents without a hit stay as they are, null
    texts as null.  See :func:`find_contamination` for the rest.
    """
    found = find_contamination(docs, benchmark, n).where(F.col("n_hit") > 0).select(
        F.col("doc_id").alias("__d"), F.col("version").alias("__v"), "n_words", "n_hit", "spans"
    ).dropDuplicates(["__d", "__v"])
    rows = docs.select("doc_id", "text", *keep)
    version = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = rows.select("doc_id", "text", version.alias("__version"),
                       *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    joined = rows.join(
        found, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__version") == F.col("__v")), "left")
    clean = F.col("n_hit").isNull()
    return joined.where(clean | (F.col("n_hit") <= drop_share * F.col("n_words"))).select(
        "doc_id", F.when(clean, F.col("text")).otherwise(without_spans(F.col("text"), F.col("spans")))
        .alias("text"), *[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)])
