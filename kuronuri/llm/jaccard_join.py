"""N-gram Jaccard join: exact near duplicates as a metric-space join around pivots.

Works on the library's documents ``docs(doc_id, text)``.  Jaccard distance is a metric.  Pivots
create regions, distances to a pivot decide what has to meet inside and across, and regions join
recursively until all pairs within the radius are settled; every pair that is linked is either
compared or follows from the pivot.  With few pivots for all documents, nearly every distance of sparse
sets is 1, so that the window of the triangle inequality would keep everything; so regions are
seeded by shared rare shingles: two sets within the radius share one among the first fifth of
theirs, in an order from rare to frequent.

1. Equal sets fall together.  A sketch of all shingle counts gives the order of shingles.
2. All sets with one shingle in their first fifth are a list.  Short lists are compared pair by pair (as
   far as sizes, places and coarse counts allow).  In a long list, the most typical sets become
   pivots, and all others are compared to them.
3. Around a pivot: sets within the radius are linked to it and leave the list.  Sets beyond twice
   the radius can not be linked to those, by the triangle inequality: they stay in the list, which is
   joined again, with a new pivot if it is still long.  Those in between (the boundary) stay too, and also meet the
   inner ones: both are described by their differences to the pivot, which must have many shingles in common
   if they are linked, so they join again on rare ones of these.
4. Links are put together to components.

Every exchange is keyed by shingle or set; no list is ever in one task as a whole by need, and no
group is paired with itself unless it is short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kuronuri.llm import blocks
from kuronuri.llm.components import components
from kuronuri.llm.shingles import mix, pieces, shingle_sets, shingles
from kuronuri.llm.tables import docs_of, stored

#: Counters of the sketch that orders shingles, and buckets of a set's coarse counts.
SLOTS, COARSE = 1 << 22, 256
#: Lists up to this size are compared pair by pair; so many times longer ones after each round.
SHORT, GROWTH = 64, 16
#: Bits of the filter that picks the documents whose whole sets are needed.
PICK = 1 << 22


def _sketch(docs: DataFrame) -> np.ndarray:
    """How often the shingles of each slot occur in all documents; of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for at, end in pieces(texts):
                _, h = shingles(texts[at:end])
                np.add.at(counts, (h % np.uint64(SLOTS)).astype(np.int64), 1)
        yield from blocks.send(counts)

    return blocks.gathered(docs.select("text").mapInArrow(count, blocks.SCHEMA), SLOTS)


def _ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each slot: 0 for all that do not stand out, then one more for each doubling."""
    usual = max(2.0 * counts.mean(), 1.0)
    return np.floor(np.log2(np.maximum(counts / usual, 1.0))).astype(np.uint8)


def _set_key(hashes: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return mix(np.add.reduceat(mix(hashes), starts) + n.astype(np.uint64)).astype(np.int64)


def _needed(n: np.ndarray) -> np.ndarray:
    """The least size of a set that can be linked to one of size ``n``."""
    return -(-4 * n // 5)


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _lists(values: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values))


def describe_sets(docs: DataFrame) -> DataFrame:
    """``doc_id, key, n, first, typical, coarse`` for every row of ``docs``.

    ``key`` names the shingle set (null: empty), ``n`` is its size, ``first`` its shingles up to the
    place after which two linked sets can not begin to overlap, ``typical`` how frequent its shingles
    are (0 to 255), ``coarse`` their numbers in each of :data:`COARSE` ranges of hashes.
    """
    rows = docs_of(docs)
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(_sketch(rows)))
    id_type = dict(rows.dtypes)["doc_id"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for at, end in pieces(texts):
                owner, h = shingle_sets(texts[at:end])
                size = np.bincount(owner, minlength=end - at)
                rank = ranks.value[(h % np.uint64(SLOTS)).astype(np.int64)]
                full = np.flatnonzero(size)
                starts = (np.cumsum(size) - size)[full]
                n = size[full]
                keys = np.zeros(end - at, np.int64)
                typical = np.zeros(end - at, np.int64)
                coarse = np.zeros((end - at, COARSE), np.int64)
                if len(full):
                    keys[full] = _set_key(h, starts, n)
                    typical[full] = np.minimum(
                        255, 16 * np.add.reduceat(rank.astype(np.int64), starts) // n)
                    np.add.at(coarse, (owner, (h >> np.uint64(56)).astype(np.int64)), 1)
                order = np.lexsort((h, rank, owner))
                place = np.arange(len(h)) - np.repeat(starts, n)
                first_n = size - np.where(size > 0, _needed(size), 0) + (size > 0)
                taken = order[place < np.repeat(first_n[full], n)]
                yield _batch({
                    "doc_id": batch.column(0).slice(at, end - at),
                    "key": pa.array(keys, pa.int64(), mask=size == 0),
                    "n": pa.array(size),
                    "first": _lists(h[taken].astype(np.int64), first_n),
                    "typical": pa.array(typical),
                    "coarse": pa.array(
                        [c.tobytes() for c in np.minimum(coarse, 255).astype(np.uint8)],
                        pa.binary()),
                })

    return rows.mapInArrow(
        describe,
        f"doc_id {id_type}, key long, n long, first array<long>, typical long, coarse binary")


def _can_reach(pairs: DataFrame, coarse: DataFrame, permille: int) -> DataFrame:
    """Pairs ``a, b`` whose similarity may reach ``permille`` thousandths, by coarse counts.

    Two sets share at most the smaller count in every range of hashes.
    """
    both = (
        pairs.join(coarse.select(F.col("key").alias("a"), F.col("n").alias("na"),
                                 F.col("coarse").alias("ca")), "a")
        .join(coarse.select(F.col("key").alias("b"), F.col("n").alias("nb"),
                            F.col("coarse").alias("cb")), "b")
        .select("a", "b", "na", "nb", "ca", "cb"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ca, cb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8)
                      .reshape(-1, COARSE) for i in (4, 5))
            low = np.minimum(ca, cb)
            shared = low.sum(1, dtype=np.int64)
            # A count of 255 means that or more.
            shared = np.where((low == 255).any(1), np.minimum(na, nb), shared)
            keep = 1000 * shared >= permille * (na + nb - shared)
            yield batch.filter(pa.array(keep)).select(["a", "b"])

    return both.mapInArrow(test, "a long, b long")


def _whole_sets(docs: DataFrame, described: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key, members``: the whole sets of the wanted keys, made again from the texts.

    Each set is made from one of its documents.  A filter of fixed size, sent to all tasks, picks these; what
    it picks beyond the wanted ones falls out by the join on the key.
    """
    chosen = stored(
        described.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("id"))
        .select("key", F.col("key").bitwiseXOR(F.xxhash64("id")).alias("mark")), "chosen")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(PICK, np.int64)
        for batch in batches:
            bits[_slot(batch.column(0).to_numpy())] = 1
        yield from blocks.send(bits)

    bits = np.packbits(
        blocks.gathered(chosen.select("mark").mapInArrow(mark, blocks.SCHEMA), PICK) > 0)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked = np.unpackbits(shared.value)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            names = batch.column(1).to_numpy()
            for at, end in pieces(texts):
                owner, h = shingle_sets(texts[at:end])
                size = np.bincount(owner, minlength=end - at)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                starts, n = (np.cumsum(size) - size)[full], size[full]
                keys = _set_key(h, starts, n)
                good = picked[_slot(keys ^ names[at:end][full])] > 0
                if good.any():
                    yield _batch({
                        "key": pa.array(keys[good]),
                        "members": pa.array(
                            [h[i : i + k].tobytes()
                             for i, k in zip(starts[good], n[good], strict=True)], pa.binary())})

    made = docs_of(docs).select("text", F.xxhash64("doc_id").alias("name")).mapInArrow(
        make, "key long, members binary")
    return made.join(chosen, "key", "left_semi").dropDuplicates(["key"])


def _slot(marks: np.ndarray) -> np.ndarray:
    return (mix(marks.astype(np.uint64)) % np.uint64(PICK)).astype(np.int64)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b, na, nb, shared, only_a, only_b``: what pairs share, and for those within twice the
    radius the shingles that only one of both has, by hash."""
    both = (
        pairs.join(sets.select(F.col("key").alias("b"), F.col("members").alias("mb")), "b")
        .join(sets.select(F.col("key").alias("a"), F.col("members").alias("ma")), "a")
        .select("a", "b", "ma", "mb"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, na, nb, only_a, only_b = [], [], [], [], []
            for ma, mb in zip(batch.column(2), batch.column(3), strict=True):
                x = np.frombuffer(ma.as_buffer(), np.uint64)
                y = np.frombuffer(mb.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                there = x[at] == y
                n = int(there.sum())
                shared.append(n)
                na.append(len(x))
                nb.append(len(y))
                # J >= 0.6 is distance up to 0.4, twice the radius.
                if 10 * n >= 6 * (len(x) + len(y) - n):
                    gone = np.ones(len(x), bool)
                    gone[at[there]] = False
                    only_a.append(x[gone].astype(np.int64))
                    only_b.append(y[~there].astype(np.int64))
                else:
                    only_a.append(None)
                    only_b.append(None)
            yield _batch({
                "a": batch.column(0), "b": batch.column(1), "na": pa.array(na, pa.int64()),
                "nb": pa.array(nb, pa.int64()), "shared": pa.array(shared, pa.int64()),
                "only_a": pa.array(only_a, pa.list_(pa.int64())),
                "only_b": pa.array(only_b, pa.list_(pa.int64()))})

    return both.mapInArrow(
        compare,
        "a long, b long, na long, nb long, shared long, only_a array<long>, only_b array<long>")


_LINKED = "100 * shared >= 80 * (na + nb - shared)"


def _boundary_links(around: DataFrame) -> DataFrame:
    """Links between sets around one pivot of which at least one is not linked to the pivot.

    ``around`` holds compared pairs (pivot ``a``, set ``b``) within twice the radius.  Two sets
    differ in ``|dx| + |dy| - 2 |dx & dy|`` shingles, where ``dx`` and ``dy`` are their differences to
    the pivot, and are linked if that is at most a ninth of their sizes together.  Where ``x`` is
    not linked to the pivot, ``dx`` and ``dy`` must share more than
    ``(|dy| - (|y| - |pivot|) / 9) / 2`` shingles (and as many with ``x`` and ``y`` exchanged if
    ``y`` is not linked either), so that they meet on one of the first of ``dy``.  Where ``y`` is
    linked to the pivot, ``dy`` may be short, and of ``dx`` only
    ``(|dx| - (|x| + |pivot|) / 9) / 2`` shingles have to be shared: more of it counts as first.
    """
    pivots = around.where(f"not ({_LINKED})").select("a").distinct()
    rows = stored(
        around.join(pivots, "a", "left_semi")
        .select("a", F.col("b").alias("x"), F.col("nb").alias("nx"),
                (~F.expr(_LINKED)).alias("outer"), F.size("differ").alias("d"), "differ",
                # Twice nine times the least number of shared differences: with a set that is not
                # linked to the pivot, and with one that is.
                F.greatest(9 * F.size("differ") - (F.col("nb") - F.col("na")), F.lit(18))
                .alias("least"),
                F.greatest(9 * F.size("differ") - F.col("nb") - F.col("na"), F.lit(18))
                .alias("least_inner")), "around")
    # Differences of one set go last by how many sets around the pivot have them; those that only
    # one has meet nothing and only count for the place of the others.
    met = (
        rows.select("a", "x", "nx", "outer", "d", "least", "least_inner",
                    F.explode("differ").alias("meet"))
        .withColumn("df", F.count("*").over(W.partitionBy("a", "meet"))).where("df > 1"))
    of_set = W.partitionBy("a", "x")
    first = met.withColumn(
        "place", F.col("d") - F.count("*").over(of_set)
        + F.row_number().over(of_set.orderBy("df", "meet")) - 1
    ).withColumn("first", F.expr("18 * (d - place) >= least")).where(
        "first or (outer and 18 * (d - place) >= least_inner)")
    # Sets that are not linked to the pivot meet inner ones on more shingles than each other.
    left = first.where("outer").select(
        "a", "meet", "x", "nx", F.col("d").alias("dx"), F.col("place").alias("px"),
        F.explode(F.when(F.col("first"), F.array(F.lit(False), F.lit(True)))
                  .otherwise(F.array(F.lit(False)))).alias("other"))
    right = first.where("first").select(
        "a", "meet", F.col("x").alias("y"), F.col("nx").alias("ny"), F.col("d").alias("dy"),
        F.col("place").alias("py"), F.col("outer").alias("other"))
    # If the shingle is the first that both have, what lies behind it bounds what they share.
    pairs = left.join(right, ["a", "meet", "other"]).where(
        "x != y and (not other or x < y) and 5 * nx >= 4 * ny and 5 * ny >= 4 * nx "
        "and 18 * least(dx - px, dy - py) >= 9 * (dx + dy) - nx - ny"
    ).select("a", "x", "y").distinct()
    full = pairs.join(rows.select("a", "x", "nx", F.col("differ").alias("dx")), ["a", "x"]).join(
        rows.select("a", F.col("x").alias("y"), F.col("nx").alias("ny"),
                    F.col("differ").alias("dy")), ["a", "y"])
    apart = F.size("dx") + F.size("dy") - 2 * F.size(F.array_intersect("dx", "dy"))
    return full.where(9 * apart <= F.col("nx") + F.col("ny")).select(
        F.col("x").alias("a"), F.col("y").alias("b"))


def _in_lists(described: DataFrame) -> DataFrame:
    """``token, key, n, place, typical`` of all sets that share a shingle of ``first``, and ``size`` of
    the list."""
    sets = described.where(F.col("key").isNotNull()).dropDuplicates(["key"])
    # Three numbers a row: this is the widest exchange.
    meta = (F.shiftleft(F.col("n"), 32)
            .bitwiseOR(F.shiftleft(F.col("place").cast("long"), 8)).bitwiseOR(F.col("typical")))
    rows = sets.select("key", "n", "typical", F.posexplode("first").alias("place", "token")).select(
        "token", "key", meta.alias("meta"))
    return rows.withColumn("size", F.count("*").over(W.partitionBy("token"))).where(
        "size > 1").select(
        "token", "key", F.shiftright("meta", 32).alias("n"),
        F.shiftright("meta", 8).bitwiseAND(F.lit((1 << 24) - 1)).alias("place"),
        F.col("meta").bitwiseAND(F.lit(255)).alias("typical"), "size")


def _pairs_of_short(lists: DataFrame) -> DataFrame:
    """Pairs inside lists, as far as sizes and places allow.

    If the shingle is the first that both share, at most what lies behind it in both is shared; so
    in the smaller set it stands among the first ninth.
    """
    a = lists.where("9 * place <= n").select(
        "token", F.col("key").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"))
    b = lists.select("token", F.col("key").alias("b"), F.col("n").alias("nb"),
                     F.col("place").alias("pb"))
    return a.join(b, "token").where(
        "a != b and na <= nb and 5 * na >= 4 * nb "
        "and 9 * least(na - pa, nb - pb) >= 4 * (na + nb)"
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def set_links(docs: DataFrame, described: DataFrame) -> DataFrame:
    """``a, b``: links of set keys; keys that they connect are those that similarity connects."""
    lists = stored(_in_lists(described), "lists")
    coarse = stored(
        described.where(F.col("key").isNotNull()).select("key", "n", "coarse")
        .join(lists.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]), "coarse")

    def keys(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("key")).union(pairs.select("b"))

    # Most sets are settled in short lists and around the first pivots of long ones.  What pivots
    # leave over is mostly far apart, so that longer lists then count as short.
    rest, short, sets, links = lists, SHORT, None, []
    while not rest.isEmpty():
        region = stored(_around_pivots(rest.where(F.col("size") > short)), "region")
        near = region.where("10 * na >= 6 * n and 10 * n >= 6 * na").select(
            F.least("a", "key").alias("a"), F.greatest("a", "key").alias("b")).distinct()
        direct = _pairs_of_short(rest.where(F.col("size") <= short))
        asked = stored(
            _can_reach(direct, coarse, 800).union(_can_reach(near, coarse, 600)).distinct(), "asked")
        wanted = keys(asked).distinct()
        if sets is None:
            sets = stored(_whole_sets(docs, described, wanted), "sets")
        else:
            new = stored(wanted.join(sets, "key", "left_anti"), "wanted")
            if not new.isEmpty():
                sets = stored(sets.union(_whole_sets(docs, described, new)), "sets")
        seen = stored(_compared(asked, sets), "compared")
        links.append(seen.where(_LINKED).select("a", "b"))
        around, rest = _settled(region, seen)
        links.append(_boundary_links(around))
        short *= GROWTH
    if not links:
        return lists.select(F.col("key").alias("a"), F.col("key").alias("b"))
    out = links[0]
    for more in links[1:]:
        out = out.union(more)
    return out


def _around_pivots(lists: DataFrame) -> DataFrame:
    """Rows of long lists with ``a, na``: the most typical set of the list, its pivot."""
    first = W.partitionBy("token").orderBy(F.desc("typical"), "key")
    return lists.withColumn("pivot", F.first(F.struct("key", "n")).over(first)).select(
        "token", "key", "n", "place", "typical", F.col("pivot.key").alias("a"),
        F.col("pivot.n").alias("na")).where("key != a")


def _settled(region: DataFrame, compared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compared pairs (pivot ``a``, set ``b``) within twice the radius, and what stays in the lists."""
    one = compared.where(F.col("only_a").isNotNull())
    # Both ways, as either may be the pivot ``a``.  Differences to the pivot: first shingles that it
    # lacks, then its own.
    both = one.select(
        "a", "b", "na", "nb", "shared", F.concat("only_b", "only_a").alias("differ")
    ).union(one.select(
        F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"),
        F.col("na").alias("nb"), "shared", F.concat("only_a", "only_b").alias("differ")))
    met = region.select("a", F.col("key").alias("b")).distinct()
    around = stored(both.join(met, ["a", "b"], "left_semi"), "around-pivots")
    inner = around.where(_LINKED).select("a", F.col("b").alias("key"))
    rest = (
        region.join(inner, ["a", "key"], "left_anti").drop("a", "na")
        .withColumn("size", F.count("*").over(W.partitionBy("token"))).where("size > 1"))
    return around, stored(rest, "rest")


def _roots(docs: DataFrame, described: DataFrame) -> DataFrame:
    """``doc_id, key, n, root`` for every row: ``root`` names the component of the set."""
    roots = stored(components(set_links(docs, described)), "roots")
    return described.select("doc_id", "key", "n").join(roots, "key", "left").withColumn(
        "root", F.coalesce("root", "key"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Two documents are linked when their sets of five-word shingles have a Jaccard similarity of
    0.8 or more; ``component_id`` is the least ``doc_id`` reachable by links, itself included.
    Null text and text without words has no shingles and no links.  Repeated rows and equal texts
    are linked (their sets are equal).  A null ``doc_id`` is never a component's name unless the
    component has no other.  Other columns are left out; an empty table gives no rows.  Sets are told apart
    by hashes of 64 bits.
    """
    described = stored(describe_sets(docs), "sets-described")
    named = _roots(docs, described)
    least = named.where(F.col("root").isNotNull()).groupBy("root").agg(
        F.min("doc_id").alias("component_id"))
    return named.join(least, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, one row of every component of :func:`similar_documents`.

    The row with the least ``doc_id`` stays, a null one only where there is no other; of rows that
    share it, one.  Documents without words have no links and all stay.
    """
    named = _roots(docs, stored(describe_sets(docs), "sets-described"))
    stay = named.where(F.col("root").isNotNull()).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("m")
    ).select(F.col("m.doc_id").alias("__id"), F.col("m.key").alias("__of"))
    names, types = docs.columns, [f"`{c}` {t}" for c, t in docs.dtypes]
    at = names.index("text")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            for start, end in pieces(texts):
                owner, h = shingle_sets(texts[start:end])
                size = np.bincount(owner, minlength=end - start)
                full = np.flatnonzero(size)
                keys = np.zeros(end - start, np.int64)
                if len(full):
                    keys[full] = _set_key(h, (np.cumsum(size) - size)[full], size[full])
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(keys, pa.int64(), mask=size == 0)],
                    [*names, "__key"])

    rows = docs.mapInArrow(keyed, ", ".join([*types, "__key long"]))
    kept = rows.where(F.col("__key").isNotNull()).join(
        stay, (F.col("__key") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__id")),
        "left_semi").dropDuplicates(["__key", "doc_id"])
    return kept.union(rows.where(F.col("__key").isNull())).select(*names)
