"""Overlap resolution for candidate tables, where documents have very many candidates."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.functions.arrays import fold_emit
from kuronuri.functions.spans import better_key, candidate, resolve_final, resolve_first
from kuronuri.operators.ordinals import WIDTH, running
from kuronuri.sources.folders import written

#: Positions in a cell, and cells in a cell of the level above.
CELL = 256


def _rows(cands: DataFrame):
    """The candidate struct of each row; missing fields are filled in."""
    have = set(cands.columns)

    def col(name, default=None):
        return F.col(name) if name in have else default

    return candidate(
        F.col("start"), F.col("end"), F.col("entity"), F.col("score"), col("source", "analyzer"),
        col("pattern"), col("label"), col("forced_reason"), col("ord", 0), col("original"),
    )


def resolve_arrays(cands: DataFrame, final: bool = True,
                   priorities: Mapping[str, int] = vocab.PRIORITIES) -> DataFrame:
    """Fold the candidates of each document as one array."""
    fold = resolve_final if final else resolve_first
    arrays = _best_per_start(cands, priorities).groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "c"))).alias("cs")
    )
    out = fold(F.transform("cs", lambda x: x.c), priorities)
    return arrays.select("doc_id", F.explode(out).alias("c")).select("doc_id", "c.*")


def _best_per_start(cands: DataFrame, priorities: Mapping[str, int]) -> DataFrame:
    """Of candidates with one start only the best can be kept by either fold.

    All of them overlap the same earlier span, and the best of all stays; so the
    rest is dropped before rows of a document meet.
    """
    c = cands.select("doc_id", "start", _rows(cands).alias("c"))
    rank = F.struct(better_key(F.col("c"), priorities).alias("key"), F.col("c.ord").alias("ord"))
    return c.groupBy("doc_id", "start").agg(F.min_by("c", rank).alias("c"))


def resolve_islands(cands: DataFrame, final: bool = True,
                    priorities: Mapping[str, int] = vocab.PRIORITIES,
                    width: int = WIDTH) -> DataFrame:
    """The same result as one fold per document, folded per island.

    Candidates that are chained by overlap form an island, and no fold looks past
    its border: a new one begins where a start lies at or behind every end before
    it.  Islands of one document spread over tasks.
    """
    best = _best_per_start(cands, priorities)
    reach = running(best, ["doc_id"], "start", F.col("c.end"), "reach", "max", width)
    new = (F.col("reach").isNull() | (F.col("start") >= F.col("reach"))).cast("long")
    marked = reach.withColumn("new", new)
    numbered = running(marked, ["doc_id"], "start", F.col("new"), "before", "sum", width)
    islands = (
        numbered.withColumn("island", F.col("before") + F.col("new"))
        .groupBy("doc_id", "island")
        .agg(F.sort_array(F.collect_list(F.struct("start", "c"))).alias("cs"))
    )
    fold = resolve_final if final else resolve_first
    out = fold(F.transform("cs", lambda x: x.c), priorities)
    return islands.select("doc_id", F.explode(out).alias("c")).select("doc_id", "c.*")


def resolve_chains(cands: DataFrame, priorities: Mapping[str, int] = vocab.PRIORITIES,
                   cell: int = CELL) -> DataFrame:
    """The same result as one fold per document, for documents of any number of chained candidates.

    With one candidate a start left, both folds walk alike: the span held gives way to the next one
    that starts behind it (then it is kept) or is better (then it is lost).  So every span has
    one successor, and those on the way from a document's first span are the ones held.

    Successors and ways inside a cell of ``cell`` positions are found in one row a cell.  Only what
    leaves a cell is looked up in a tree of cells, and ways over many cells are reached by pointer
    doubling.  No row holds more than ``cell`` spans or cells.  ``doc_id`` must not be null; starts are
    0 or more.  Steps are written to the shared folder.
    """
    best = written(
        _best_per_start(cands, priorities)
        .withColumn("key", better_key(F.col("c"), priorities)), "spans")
    nodes = best.select("doc_id", "start", F.col("c.end").alias("end"), "key")
    cells = written(_cells(nodes, cell), "cells")
    leaving = cells.select("doc_id", "cell", F.explode("xs").alias("x")).where("x.open").select(
        "doc_id", "x.start", "x.end", "x.key", F.col("cell").alias("at"))
    cross = written(_successors(leaving, cells, cell), "successors")
    entries = _reached(cells, cross).groupBy("doc_id", F.floor(F.col("start") / cell).alias("cell")).agg(
        F.collect_set("start").alias("entries"))
    held = cells.join(entries, ["doc_id", "cell"], "left").select(
        "doc_id", F.explode(_held("xs", "entries")).alias("x")).select("doc_id", "x.*")
    beaten = cross.where(F.col("follows") < F.col("end")).select("doc_id", "start")
    kept = held.where("not open").select("doc_id", "start").unionByName(
        held.where("open").select("doc_id", "start").join(beaten, ["doc_id", "start"], "left_anti"))
    return best.join(kept, ["doc_id", "start"], "left_semi").select("doc_id", "c.*")


def _gives_way(start: Column, key: Column, x_end: Column, x_key: Column) -> Column:
    """A later span at ``start`` ends the hold of ``x``."""
    return (start >= x_end) | (key < x_key)


def _cells(nodes: DataFrame, cell: int) -> DataFrame:
    """``doc_id, cell, xs``: the spans of every cell by start, with their successors inside it.

    ``first``: nothing before reaches the span, so it is held in any case.  ``open``: the successor
    has to be looked for in other cells; it need not where the span lies in its cell and no span up
    to the cell's border ends behind it, since the successor then is such a first span.
    ``way_end`` is the last span of the cell on the way from this one.
    """
    reach = F.col("reach")
    rows = running(nodes, ["doc_id"], "start", F.col("end"), "reach", "max").select(
        "doc_id", F.floor(F.col("start") / cell).alias("cell"),
        F.struct("start", "end", "key", (reach.isNull() | (F.col("start") >= reach)).alias("first"),
                 F.coalesce(F.col("end") >= reach, F.lit(True)).alias("far")).alias("x"))
    grouped = rows.groupBy("doc_id", "cell").agg(F.sort_array(F.collect_list("x")).alias("xs"))

    def link(x: Column, i: Column) -> Column:
        later = F.filter(F.col("xs"), lambda y: (y.start > x.start) & _gives_way(
            y.start, y.key, x.end, x.key))
        return F.get(later, F.lit(0)).start.alias("follows")

    linked = grouped.withColumn("to", F.transform("xs", link)).withColumn(
        "places", F.transform("xs", lambda x: x.start)).withColumn(
        "top", F.array_max(F.transform("xs", lambda x: x.end)))
    # Places of successors, the own one where there is none; doubled until all ways have ended.
    ways = F.aggregate(
        F.sequence(F.lit(1), F.lit((cell - 1).bit_length() or 1)),
        F.transform("to", lambda t, i: F.when(t.isNull(), i).otherwise(
            (F.array_position(F.col("places"), t) - 1).cast("int"))),
        lambda p, _: F.transform(p, lambda q: F.get(p, q)))
    bound = (F.col("cell") + 1) * cell

    def node(x: Column, i: Column) -> Column:
        to = F.get(F.col("to"), i)
        return F.struct(
            x.start.alias("start"), x.end.alias("end"), x.key.alias("key"), x.first.alias("first"),
            to.alias("follows"), (to.isNull() & ~(x.far & (x.end >= F.col("top")) & (x.end <= bound))).alias("open"),
            F.get(F.col("places"), F.get(F.col("ways"), i)).alias("way_end"))

    return linked.withColumn("ways", ways).select(
        "doc_id", "cell", F.transform("xs", node).alias("xs"))


def _successors(leaving: DataFrame, cells: DataFrame, cell: int) -> DataFrame:
    """``doc_id, start, end, follows``: the successor of each span of ``leaving``, in later cells.

    ``leaving`` has ``at``, the cell of the span; spans without successor are left out.  Every cell
    is known by its best key and its last start, and so is every ``cell`` of them together: a search
    climbs until a later cell answers, then goes down to the span.
    """
    far = cells.agg(F.max("cell").alias("n")).first().n or 0
    own = ["doc_id", "start", "end", "key"]
    known = cells.select(
        "doc_id", "cell", F.array_min(F.transform("xs", lambda x: x.key)).alias("least"),
        F.element_at("xs", -1).start.alias("last"))
    levels, waiting = [], leaving
    while True:
        tree = written(
            known.groupBy(F.col("doc_id"), F.floor(F.col("cell") / cell).alias("up")).agg(
                F.sort_array(F.collect_list(F.struct("cell", "least", "last"))).alias("kids")),
            "tree")
        asked = waiting.withColumn("up", F.floor(F.col("at") / cell)).join(
            tree, ["doc_id", "up"])
        seen = written(asked.select(*own, "up", _first_kid(F.col("at")).alias("cell")), "searches")
        levels.append((tree, seen.where("cell is not null").select(*own, "cell")))
        far //= cell
        waiting = seen.where("cell is null").select(*own, F.col("up").alias("at"))
        if far == 0 or waiting.isEmpty():
            break
        known = tree.select(
            "doc_id", F.col("up").alias("cell"),
            F.array_min(F.transform("kids", lambda k: k.least)).alias("least"),
            F.element_at("kids", -1).last.alias("last"))
    target = None
    for tree, hits in reversed(levels):
        if target is not None:
            down = target.withColumnRenamed("cell", "up").join(tree, ["doc_id", "up"])
            hits = hits.unionByName(down.select(*own, _first_kid(F.lit(-1)).alias("cell")))
        target = hits
    met = target.join(cells, ["doc_id", "cell"])
    first = F.get(F.filter("xs", lambda x: _gives_way(
        x.start, x.key, F.col("end"), F.col("key"))), F.lit(0))
    return met.select("doc_id", "start", "end", first.start.alias("follows"))


def _first_kid(behind: Column) -> Column:
    """The first cell behind a given one that holds a successor."""
    fits = F.filter("kids", lambda k: (k.cell > behind) & _gives_way(
        k.last, k.least, F.col("end"), F.col("key")))
    return F.get(fits, F.lit(0)).cell


def _reached(cells: DataFrame, cross: DataFrame) -> DataFrame:
    """``doc_id, start``: spans at which the way of a document enters a cell."""
    ways = cells.select("doc_id", F.explode("xs").alias("x")).select(
        "doc_id", "x.start", "x.first", "x.way_end")
    leaps = cross.select("doc_id", F.col("start").alias("way_end"), "follows")
    targets = cross.select("doc_id", F.col("follows").alias("start")).distinct()
    # From where a cell is entered, or a way begins, to where the next cell is entered.
    hops = ways.join(leaps, ["doc_id", "way_end"]).select("doc_id", "start", "first", "follows")
    reached = written(
        hops.where("first").select("doc_id", F.col("follows").alias("start")).distinct(), "reached")
    jump = written(
        hops.where("not first").join(targets, ["doc_id", "start"], "left_semi")
        .select("doc_id", "start", "follows"), "jumps")
    while not jump.isEmpty():
        more = reached.join(jump, ["doc_id", "start"]).select(
            "doc_id", F.col("follows").alias("start"))
        reached = written(reached.unionByName(more).distinct(), "reached")
        further = jump.select("doc_id", F.col("start").alias("follows"),
                              F.col("follows").alias("far"))
        jump = written(jump.join(further, ["doc_id", "follows"]).select(
            "doc_id", "start", F.col("far").alias("follows")), "jumps")
    return reached


def _held(xs: str, entries: str) -> Column:
    """Spans of a cell on the document's way that are kept, or ``open``: kept unless beaten later."""
    begun = F.coalesce(F.col(entries), F.array().cast("array<int>"))

    def step(st, x):
        on = x.first | F.array_contains(begun, x.start) | F.coalesce(
            st.want == x.start, F.lit(False))
        stays = x.follows.isNull() | (x.follows >= x.end)
        return (F.struct(F.when(on, x.follows).otherwise(st.want).alias("want")), on & stays,
                F.struct(x.start.alias("start"), x.open.alias("open")))

    return fold_emit(F.col(xs), F.struct(F.lit(None).cast("int").alias("want")), step,
                     "struct<start:int,open:boolean>")
