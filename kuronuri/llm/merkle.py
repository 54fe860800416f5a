"""A Merkle manifest of records: one root that vouches for every field of every row.

Records of a group (hits of a document, documents of a language) are the leaves of a binary tree
in their order; the roots of all groups, in the order of the groups, are the leaves of one more.
Built levels are stored as node rows that know their parent row, and a recursive Spark query
climbs from every leaf to the root: it appends the siblings it meets and folds the digest of the
record as it is now, which gives the stored root exactly when the record is unchanged.

A stored row bundles ``STRIDE`` levels: the siblings of a node up to its ancestor in the block of
``2 ** STRIDE`` nodes it belongs to.  The climb then joins once a block, not once a level.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri.llm.positions import in_order
from kuronuri.llm.tables import stored

#: The fields of a hit, the project's own record, and their order inside a document.
HIT_FIELDS = ("doc_id", "entity_type", "start", "end", "score", "original", "replacement", "reason",
              "source")
HIT_ORDER = ("start", "end", "entity_type")
#: Tree levels in one stored row; a block has two to the power of this many nodes.
STRIDE = 8
#: At most two to the power of this many leaves meet one copy of a node row.
PART_BITS = 12


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A field in a leaf: ``-`` for null, else UTF-8 byte count, ``:`` and the value."""
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(
        F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def record_digest(fields: Sequence[Column]) -> Column:
    return digest(*[encoded(c) for c in fields])


def _bits(n: Column) -> Column:
    """Levels above ``n`` leaves: how often they halve, rounding up, until one is left."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def _pairs(below: Column) -> Column:
    """The level above: every two neighbours as one digest, a last single one alone."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(below) - 1) / 2).cast("int")),
        lambda i: digest(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.lit(""))),
    )


def _block_levels(digests: str, depth: str, frame: DataFrame) -> tuple[DataFrame, Column]:
    """Columns ``__l1`` .. of a block's levels up to its depth, and the digest on top."""
    names = [digests]
    for k in range(1, STRIDE + 1):
        frame = frame.withColumn(f"__l{k}", F.when(F.col(depth) >= k, _pairs(F.col(names[-1]))))
        names.append(f"__l{k}")
    top = F.coalesce(*[F.get(F.col(n), F.lit(0)) for n in reversed(names)])
    return frame, top


def _path(place: Column, digests: str, depth: str) -> Column:
    """Siblings of the node at ``place`` of its block, level by level: ``left`` and ``right``, of
    which at most one is not empty."""
    steps = []
    for k in range(STRIDE):
        level = F.col(digests if k == 0 else f"__l{k}")
        at = F.shiftright(place, k)
        odd = at.bitwiseAND(1) == 1
        none = F.lit("")
        steps.append(F.struct(
            F.unhex(F.when(odd, F.get(level, at - 1)).otherwise(none)).alias("left"),
            F.unhex(F.when(odd, none).otherwise(F.coalesce(F.get(level, at + 1), none)))
            .alias("right"),
        ))
    return F.slice(F.array(*steps), 1, F.col(depth))


def _one_level(nodes: DataFrame, more: Sequence[str]) -> DataFrame:
    """Node rows with their paths, from ``nodes(tree, n, pos, digest, *more)``.

    ``n`` is the number of nodes of the tree on this level.  Blocks of ``2 ** STRIDE`` neighbours
    come together, so no task gathers more than that.  Adds ``up``, the position of the block,
    ``top``, its digest, and ``path``.
    """
    item = F.struct("pos", "digest", *more)
    blocks = nodes.groupBy("tree", "n", F.shiftright("pos", STRIDE).alias("up")).agg(
        F.sort_array(F.collect_list(item)).alias("xs"))
    depth = F.least(_bits(F.col("n")), F.lit(STRIDE))
    blocks = blocks.withColumns(
        {"__depth": depth, "__l0": F.transform("xs", lambda x: x.digest)})
    blocks, top = _block_levels("__l0", "__depth", blocks)
    rows = F.transform(
        "xs", lambda x, i: F.struct(x.alias("x"), _path(i, "__l0", "__depth").alias("path")))
    return blocks.select("tree", "n", "up", top.alias("top"), F.explode(rows).alias("r")).select(
        "tree", "n", "up", "top", "r.path", "r.x.*")


def _tree(leaves: DataFrame, most: int, more: Sequence[str] = ()) -> list[DataFrame]:
    """Stored node rows of all trees, level by level; ``most`` is the size of the largest tree."""
    out, nodes, extra = [], leaves, list(more)
    while True:
        rows = stored(_one_level(nodes, extra), "merkle-nodes")
        out.append(rows)
        if most <= 1 << STRIDE:
            return out
        most = -(-most >> STRIDE)
        nodes = rows.where(F.col("n") > 1 << STRIDE).select(
            "tree", F.shiftright(F.col("n") + ((1 << STRIDE) - 1), STRIDE).alias("n"),
            F.col("up").alias("pos"), F.col("top").alias("digest")).distinct()
        extra = []


def _subroots(levels: list[DataFrame]) -> DataFrame:
    """``tree, subroot``: what remains of every tree."""
    tops = [
        rows.where(F.col("n") <= 1 << STRIDE).select("tree", F.col("top").alias("subroot"))
        for rows in levels
    ]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out.distinct()


def manifest(records: DataFrame, fields: Sequence[str] = HIT_FIELDS, group: str = "doc_id",
             order: Sequence[str] = HIT_ORDER, keep: Sequence[str] = (),
             now: dict[str, Column] | None = None) -> DataFrame:
    """Root, subroots and proofs of ``records``, by default the hits of masked documents.

    A leaf is the digest of ``fields``; leaves of a ``group`` stand in ``order`` (null first), equal
    ones by their digest.  ``now`` gives fields as they are found to be now: a changed record does
    not climb to the root.  Returns one row per record: the columns ``keep``, ``group``, ``leaf``,
    ``subroot``, ``root``, ``proof_sha256`` (digest of all siblings on the way), ``folded_root``
    (from the record as it is now and the stored siblings) and ``verified``.

    Nulls are fields and groups of their own (``-``); an empty table gives no rows; a record that
    is there several times is several leaves; columns that are not named are not read.  A text of
    any length is one field.  Values are taken as Spark casts them to strings.
    """
    keep, now = [c for c in keep if c != group], now or {}
    leaf = record_digest([F.col(c) for c in fields])
    # Numbered names, so that no column of the records can clash with those of the tree.
    held = [group, *keep]
    plain = [f"__c{i}" for i in range(len(held))]
    today = F.lit(None).cast("string")
    for c, value in now.items():  # digests of changed records only
        today = F.when(value.eqNullSafe(F.col(c)), today).otherwise(
            record_digest([now.get(f, F.col(f)) for f in fields]))
    ordered = [f"__o{i}" for i in range(len(order))]
    leaves = records.select(
        *[F.col(c).alias(p) for c, p in zip(held, plain, strict=True)],
        *[F.col(c).alias(p) for c, p in zip(order, ordered, strict=True)],
        leaf.alias("leaf"), today.alias("today"),
    ).withColumn("today", F.coalesce("today", "leaf"))
    keys = [F.col("__c0"), *[F.col(p) for p in ordered], F.col("leaf"), F.col("today")]
    leaves = in_order(leaves, keys, "__at").drop(*ordered)

    groups = leaves.groupBy("__c0").agg(
        F.min("__at").alias("__first"), F.count("*").cast("long").alias("n"))
    groups = in_order(groups, [F.col("__c0")], "tree")
    known = stored(groups.select(
        F.col("__c0").alias("__g"), "__first", "n", "tree"), "merkle-groups")
    size = known.agg(F.max("n"), F.count("*")).first()
    most, n_groups = size[0] or 0, size[1]
    placed = leaves.join(known, F.col("__c0").eqNullSafe(F.col("__g"))).select(
        "tree", "n", (F.col("__at") - F.col("__first")).alias("pos"), F.col("leaf").alias("digest"),
        "today", *plain)
    levels = _tree(placed, most, ["today", *plain])
    subroots = stored(_subroots(levels), "merkle-subroots")
    tops = _tree(
        subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("n"),
                        F.col("tree").alias("pos"), F.col("subroot").alias("digest")), n_groups)
    root = _subroots(tops).select(F.col("subroot").alias("root"))

    nodes = stored(_node_rows(levels, tops, known), "merkle-climb")
    climbed = _climb(levels[0], nodes, plain)
    ends = known.select("tree", (_rows_above(F.col("n")) + _rows_above(F.lit(n_groups)))
                        .alias("last")).join(subroots, "tree").crossJoin(F.broadcast(root))
    return (
        climbed.join(stored(ends, "merkle-ends"), "tree").where(F.col("step") == F.col("last"))
        .select(
            *[F.col(p).alias(c) for c, p in zip(held, plain, strict=True)], "leaf", "subroot", "root",
            F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"),
            F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
        )
    )


def _rows_above(n: Column) -> Column:
    """Stored rows between a leaf of a tree with ``n`` leaves and its top, the leaf's own included."""
    return F.greatest(F.lit(1), F.ceil(_bits(n) / STRIDE)).cast("int")


def _node_rows(levels: list[DataFrame], tops: list[DataFrame], known: DataFrame) -> DataFrame:
    """``tree, part, step, at, next_at, path``: what a leaf meets on its way, above its own row.

    ``step`` counts stored rows from the leaf.  Rows high up are met by many leaves; they stand here
    once for every ``2 ** PART_BITS`` leaves below them (``part``), so that no copy is met by more.
    """
    out = []

    def parts(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(first, last)).alias("part")

    sizes = known.select("tree", F.col("n").alias("leaves"))
    for step, rows in enumerate(levels[1:], 1):
        shift = STRIDE * step
        first = F.shiftright(F.shiftleft("pos", shift), PART_BITS)
        last = F.shiftright(
            F.least(F.shiftleft(F.col("pos") + 1, shift), F.col("leaves")) - 1, PART_BITS)
        out.append(rows.join(sizes, "tree").select(
            "tree", parts(first, last), F.lit(step).alias("step"), F.col("pos").alias("at"),
            F.when(F.col("n") > 1 << STRIDE, F.col("up")).otherwise(F.lit(0)).alias("next_at"),
            "path"))
    # Above a tree's own top every leaf of it takes the same way: one row a tree, part and step.
    own = known.select(F.col("tree").alias("t"), F.col("n").alias("leaves"))
    for step, rows in enumerate(tops):
        met = own.withColumn("pos", F.shiftright("t", STRIDE * step))
        out.append(met.join(rows.drop("tree"), "pos").select(
            F.col("t").alias("tree"),
            parts(F.lit(0).cast("long"), F.shiftright(F.col("leaves") - 1, PART_BITS)),
            (_rows_above(F.col("leaves")) + step).alias("step"), F.lit(0).cast("long").alias("at"),
            F.lit(0).cast("long").alias("next_at"), "path"))
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


_CLIMB = """
with recursive climb as (
  select tree, shiftright(pos, {part_bits}) as part, 1 as step,
         case when n > {block} then up else 0L end as at, {kept} digest as leaf,
         aggregate(path, today, (d, s) -> sha2(concat(lower(hex(s.left)), d, lower(hex(s.right))), 256))
           as folded,
         aggregate(path, cast('' as binary), (p, s) -> concat(p, s.left, s.right)) as proof
  from {leaves}
  union all
  select c.tree, c.part, c.step + 1, n.next_at, {kept_c} c.leaf,
         aggregate(n.path, c.folded,
                   (d, s) -> sha2(concat(lower(hex(s.left)), d, lower(hex(s.right))), 256)),
         aggregate(n.path, c.proof, (p, s) -> concat(p, s.left, s.right))
  from climb c join {nodes} n
    on n.tree = c.tree and n.part = c.part and n.step = c.step and n.at = c.at)
select * from climb limit all
"""


def _climb(leaves: DataFrame, nodes: DataFrame, kept: Sequence[str]) -> DataFrame:
    """The way of every leaf, one row a step; the last one has all siblings and the folded root.

    ``LIMIT ALL`` lifts Spark's limit on the rows of a recursive query; the number of its steps is
    the logarithm of the table's size to the base of a block.
    """
    text = (
        _CLIMB.replace("{part_bits}", str(PART_BITS)).replace("{block}", str(1 << STRIDE))
        .replace("{kept}", "".join(f"{c}, " for c in kept))
        .replace("{kept_c}", "".join(f"c.{c}, " for c in kept))
    )
    return leaves.sparkSession.sql(text, leaves=leaves, nodes=nodes)
