"""Document fingerprints by spot signatures.

Works on the library's documents ``docs(doc_id, text)``.  A signature is a common word (anchor) and
the content words that follow it; a document's fingerprint is the set of its signatures.  Fingerprints
are compared by Jaccard similarity, and sets that differ too much in length never meet.
DataFrame functions only.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kuronuri.functions.arrays import let
from kuronuri.llm.positions import in_order
from kuronuri.llm.tables import docs_of

# Common words of English, German, French, Spanish and Japanese.
ANCHORS = (
    "the a an is was are be of to in and that for on with as by at it this from or "
    "der die das und ist von zu mit den dem ein eine nicht auf für im des auch sich "
    "le la les de et est un une en que dans pour du au par qui "
    "el los las del y es por con para no se su lo "
    "の は を に が と で も へ や から まで"
).split()
#: Content words in a signature.
CHAIN = 2
#: Rows of a stretch of documents put in order at once.
STRETCH = 2000

_A = "(?:" + "|".join(ANCHORS) + ") "
_INNER = f"(?:{_A})*+"
_SPOT = f"(?<=\\x20)(?=({_A}" + f"{_INNER}[^\\x20]+\\x20" * CHAIN + "))"
_HIRA, _KANJI = r"[\x{3041}-\x{309F}]", r"[\x{4E00}-\x{9FFF}\x{30A0}-\x{30FF}]"


def spaced(text: Column) -> Column:
    """Lower case, everything but letters and digits as one blank, a blank at both ends.

    Between kana and other Japanese letters stands a blank too, since particles are anchors there.
    """
    low = F.lower(text)
    parted = F.when(
        low.rlike(_HIRA),
        F.regexp_replace(F.regexp_replace(low, f"({_KANJI})({_HIRA})", "$1 $2"),
                         f"({_HIRA})({_KANJI})", "$1 $2"),
    ).otherwise(low)
    return F.regexp_replace(F.concat(F.lit(" "), parted, F.lit(" ")), r"[^\p{L}\p{N}]+", " ")


def signatures(text: Column) -> Column:
    """The distinct signatures of a text as sorted eight-digit hashes.

    A text with words but no chain has one signature, all its words; one without words has none.
    """

    # Each step is bound, so that it is done once for all its uses.
    def of_plain(plain: Column) -> Column:
        spots = F.transform(
            F.regexp_extract_all(plain, F.lit(_SPOT), F.lit(1)),
            # Anchors inside the chain go; the first one has no blank before it.
            lambda s: F.regexp_replace(s, f"(?<=\\x20){_A}", ""),
        )
        hashed = F.array_distinct(F.transform(spots, lambda s: F.substring(F.md5(s), 1, 8)))
        whole = F.when(plain == " ", F.array().cast("array<string>")).otherwise(
            F.array(F.substring(F.md5(plain), 1, 8)))
        return let(hashed, lambda h: F.when(F.size(h) > 0, F.sort_array(h)).otherwise(whole))

    return let(spaced(text), of_plain)


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two fingerprints, 0 where it can not reach ``least``.

    Two empty ones are alike.  Their lengths alone bound the similarity: where these say no, the
    sets are not compared.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    exact = both / (F.size(a) + F.size(b) - both)
    return (
        F.when(large == 0, 1.0)
        .when((small == 0) | (small < large * least), 0.0)
        .otherwise(F.when(exact >= least, exact).otherwise(0.0))
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint``: the signatures of every whole text.

    Null text reads as empty.  Rows stay one for one; other columns are left out.
    """
    return docs_of(docs).select("doc_id", signatures(F.col("text")).alias("fingerprint"))


def followed(docs: DataFrame, mark: Callable[[Column], Column] | None = None) -> DataFrame:
    """``doc_id, text, next_text``: every document with the text of the next one by ``doc_id``.

    The last is followed by the first; null ids come last; rows of one id, or without one, follow by
    the hashes of their texts.  Ids may be of any type that has an order.  Documents are dealt out in stretches
    of ascending ids and put in order there; of each stretch one row, its first, goes to the one before.
    ``mark`` adds what it makes of a text as ``mark`` and ``next_mark``, worked out once a row before rows move.
    """
    mark = mark or (lambda text: F.lit(None).cast("string"))
    key = [F.col("doc_id").isNull().alias("k0"), F.col("doc_id").alias("k1"),
           F.xxhash64("text").alias("k2")]
    rows = docs_of(docs)
    order = in_order(rows.select(*key), [F.col("k0"), F.col("k1"), F.col("k2")], "at")
    # One row in STRETCH comes to the driver: where stretches begin.
    cuts = order.where(F.col("at") % STRETCH == 0).orderBy("at").drop("at").collect()
    if not cuts:
        return rows.select("doc_id", "text", mark(F.col("text")).alias("mark"),
                           F.col("text").alias("next_text"), mark(F.col("text")).alias("next_mark"))
    kind = rows.select(F.struct(*key).alias("k")).schema["k"].dataType.simpleString()
    edges = F.from_json(
        F.lit(json.dumps([r.asDict() for r in cuts], default=str)), f"array<{kind}>")
    placed = rows.withColumn("stretch", _at(edges, len(cuts), F.struct(*key)))
    firsts = placed.groupBy("stretch").agg(F.min_by("text", F.struct(*key)).alias("first_text"))
    # One row per stretch; its number alone tells the one before, the last one comes before the first.
    known = sorted(r.stretch for r in firsts.select("stretch").collect())
    to = F.create_map(*[F.lit(x) for k, s in enumerate(known) for x in (s, known[k - 1])])
    firsts = firsts.select(F.element_at(to, F.col("stretch")).alias("before"), "first_text",
                           mark(F.col("first_text")).alias("first_mark"))
    inner = placed.withColumn("mark", mark(F.col("text"))).withColumn(
        "lead", F.lead(F.struct("text", "mark")).over(W.partitionBy("stretch").orderBy(*key)))
    # Both sides are dealt by stretch, so texts do not move again.
    ended = F.col("lead").isNull()
    return inner.join(firsts, F.col("stretch") == F.col("before"), "left").select(
        "doc_id", "text", "mark",
        F.when(ended, F.col("first_text")).otherwise(F.col("lead.text")).alias("next_text"),
        F.when(ended, F.col("first_mark")).otherwise(F.col("lead.mark")).alias("next_mark"))


def _at(edges: Column, n: int, key: Column) -> Column:
    """How many of the ``n`` sorted edges are at most the key, found by halving."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return let(key, lambda k: F.aggregate(
        steps, F.lit(0),
        lambda at, step: at + F.when(F.get(edges, at + step - 1) <= k, step).otherwise(F.lit(0))))


def _packed(prints: Column) -> Column:
    """Signatures as four bytes each."""
    return F.unhex(F.array_join(prints, ""))


def _unpacked(packed: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(packed)), F.lit(".{8}"), F.lit(0))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next document, and their likeness.

    The edited text has the first half (rounded up) of the text and then as many code points from
    the start of the next document as are missing, or all of them.  Returns ``doc_id, n_chars,
    edited, fingerprint, edited_fingerprint, near_edited, near_next``; fingerprints are arrays.  Null
    texts are empty; rows that repeat follow one another; an empty table gives no rows.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    texts = followed(docs, lambda t: _packed(signatures(t))).withColumn("edited", F.concat(
        F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half)))
    marked = texts.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "edited",
        _unpacked(F.col("mark")).alias("fingerprint"),
        signatures(F.col("edited")).alias("edited_fingerprint"),
        _unpacked(F.col("next_mark")).alias("next_fingerprint"))
    own = F.col("fingerprint")
    return marked.select(
        "doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
        likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        likeness(own, F.col("next_fingerprint")).alias("near_next"))


def similar_pairs(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """``a, b, near``: pairs of distinct fingerprints of likeness ``least`` or more.

    ``prints`` has ``fingerprint`` arrays; ``a`` and ``b`` name distinct ones (as joined text), so
    that copies count once.  Sets are partitioned by length so that only neighbouring lengths meet, and
    within these on one of their rarest signatures; likeness is then computed for pairs whose lengths allow it.
    """
    width = -math.log(least)
    sets = prints.where(F.size("fingerprint") > 0).select(
        F.array_join("fingerprint", ",").alias("name"), "fingerprint").dropDuplicates(["name"])
    sizes = sets.withColumn("n", F.size("fingerprint")).withColumn(
        "part", F.floor(F.log("n") / width + 1e-9))
    spread = sizes.select("name", "n", "part", F.explode("fingerprint").alias("s"))
    counted = spread.join(spread.groupBy("s").agg(F.count("*").alias("df")), "s")
    rank = F.row_number().over(W.partitionBy("name").orderBy("df", "s"))
    first = counted.withColumn("place", rank).where(
        F.col("place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    a = first.select("s", F.col("name").alias("a"), F.col("n").alias("na"), F.col("part").alias("p"))
    b = first.select("s", F.col("name").alias("b"), F.col("n").alias("nb"), F.explode(
        F.array("part", F.col("part") - 1)).alias("p"))
    pairs = a.join(b, ["s", "p"]).where(
        (F.col("a") != F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = likeness(F.split("a", ","), F.split("b", ","), least)
    return pairs.select("a", "b", near.alias("near")).where(F.col("near") >= least)
