"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Works on the library's documents ``docs(doc_id, text)`` and returns its hits: the columns of a hits
table (``entity_type, start, end, score, original, reason``) as an array per document, offsets in
code points, end exclusive.  Everything is an expression on the document's own row: no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri.functions.arrays import empty, fold_emit, let
from kuronuri.functions.spans import splice
from kuronuri.functions.text import blocks
from kuronuri.llm.tables import docs_of

HIT = (
    "struct<start:int,ord:int,end:int,entity_type:string,score:double,original:string,reason:string>"
)
#: Code points on either side of a span in which context words count.
CONTEXT = 40
#: What context words add to the score of a proposal.
CONTEXT_GAIN = 0.3
#: Proposals below this score are dropped.
MIN_SCORE = 0.5


@dataclass(frozen=True)
class Kind:
    """One kind of personal data.

    ``regex`` proposes spans, leftmost and without overlaps.  ``needs`` is a cheap pattern found in
    every text that holds one.  ``valid`` confirms a proposal, ``score`` is its score without
    context, ``context`` the words that raise it.
    """

    entity_type: str
    regex: str
    needs: str
    score: float
    context: str
    valid: str = "any"


# Runs are possessive and start where a run starts (or where the last match ended), so that long
# runs cost linear time and no recursion; the matches are those of the plain patterns.
KINDS = (
    Kind("EMAIL",
         r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"@[A-Za-z0-9-]", 0.9, r"(?i)e-?mail|contact|メール|連絡先"),
    Kind("IP", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
         r"[0-9]\.[0-9]", 0.6, r"(?i)\bip\b|host|server|address|アドレス", "octets"),
    Kind("CARD", r"[0-9](?:[\x20-]?+[0-9])++",
         r"[0-9](?:[\x20-]?[0-9]){13}", 0.7, r"(?i)card|visa|credit|tarjeta|karte|カード", "luhn"),
    Kind("PHONE", r"\+[0-9][\x20().0-9-]+[0-9]",
         r"\+[0-9]", 0.7, r"(?i)phone|tel|call|fax|mobile|電話|携帯", "phone"),
    Kind("IBAN", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
         r"(?![A-Za-z0-9])",
         r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", 0.6, r"(?i)iban|account|bank|konto|口座", "mod97"),
    Kind("MY_NUMBER", r"(?<![0-9-])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}(?![0-9-])",
         r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}", 0.3, r"(?i)my\x20?number|マイナンバー|個人番号",
         "mod11"),
)
#: The kinds that count as base; the others are added by the method.
BASE = ("EMAIL", "IP", "CARD", "PHONE")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _values(digits: Column) -> Column:
    """The digits from the last to the first, as numbers."""
    return F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
                       lambda c: c.cast("int"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def luhn(digits: Column) -> Column:
    """Luhn: every second digit from the right is doubled, digit sums add up to a multiple of 10."""
    return _sum(
        F.transform(
            _values(digits),
            lambda v, i: F.when(i % 2 == 0, v).when(v > 4, v * 2 - 9).otherwise(v * 2),
        )
    ) % 10 == 0


def mod97(value: Column) -> Column:
    """Bank account number: first four characters moved behind, letters as 10..35, remainder 1."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        n = F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return (acc * F.when(n > 9, 100).otherwise(10) + n) % 97

    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.length(plain).between(15, 34) & (F.aggregate(chars, F.lit(0), add) == 1)


def mod11(digits: Column) -> Column:
    """Twelve-digit personal number: weights 2..7, 2..6 from the right, check digit last."""
    weighted = F.transform(
        F.slice(_values(digits), 2, 11),
        lambda v, i: v * F.when(i < 6, i + 2).otherwise(i - 4).cast("int"),
    )
    rest = _sum(weighted) % 11
    check = F.when(rest <= 1, 0).otherwise(F.lit(11) - rest)
    return F.substring(digits, 12, 1).cast("int") == check


def _valid(kind: Kind, m: Column) -> Column:
    if kind.valid == "octets":
        octet = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return m.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z")
    if kind.valid == "luhn":
        return F.length(_digits(m)).between(14, 19) & luhn(_digits(m))
    if kind.valid == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind.valid == "mod97":
        return mod97(m)
    if kind.valid == "mod11":
        return mod11(_digits(m))
    return F.lit(True)


def _kind_hits(text: Column, kind: Kind, ord_: int, min_score: float) -> Column:
    """Hits of one kind: running lengths of gaps and matches give the offsets."""
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0)).alias("m"),
        F.split(text, kind.regex, -1).alias("g"),
    )

    def walk(v: Column) -> Column:
        rows = F.arrays_zip(
            F.slice(v.g, 1, F.size(v.m)).alias("gap"), v.m.alias("m"),
            F.slice(v.g, 2, F.size(v.m)).alias("behind"),
        )

        def step(st, x):
            start = st.pos + F.length(x.gap)
            end = start + F.length(x.m)
            near = F.concat(F.right(x.gap, F.lit(CONTEXT)), F.lit("\n"),
                            F.substring(x.behind, 1, CONTEXT)).rlike(kind.context)
            score = F.lit(kind.score) + F.when(near, CONTEXT_GAIN).otherwise(0.0)
            reason = F.concat(F.lit(f"pattern+{kind.valid}"),
                              F.when(near, "+context").otherwise(""))
            keep = _valid(kind, x.m) & (score >= min_score)
            return F.struct(end.alias("pos")), keep, F.struct(
                start.alias("start"), F.lit(ord_).alias("ord"), end.alias("end"),
                F.lit(kind.entity_type).alias("entity_type"),
                F.least(score, F.lit(1.0)).alias("score"), x.m.alias("original"),
                reason.alias("reason"),
            )

        return fold_emit(rows, F.struct(F.lit(0).alias("pos")), step, HIT)

    return F.when(text.rlike(kind.needs), let(parts, walk)).otherwise(empty(HIT))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS,
             min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id, text, hits``: all personal data of every whole text, by start, then kind.

    Null text reads as empty and has no hits; a null ``doc_id`` and repeated rows stay as they are,
    each with its own hits; other columns are left out.
    """
    rows = docs_of(docs)
    found = F.concat(*[_kind_hits(F.col("text"), k, i, min_score) for i, k in enumerate(kinds)])
    return rows.withColumn("hits", F.array_sort(found))


def mask_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS,
             min_score: float = MIN_SCORE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, hits`` and the ``keep`` columns; every hit in the text gives way to its label.

    A hit inside an earlier one has no label of its own; of two that overlap, the second label
    stands behind the first.  Null text stays null.
    """
    was_null = docs.select("doc_id", "text", *keep).withColumn("__null", F.col("text").isNull())
    rows = was_null.withColumn("text", F.coalesce("text", F.lit("")))
    found = F.concat(*[_kind_hits(F.col("text"), k, i, min_score) for i, k in enumerate(kinds)])

    def outermost(hits: Column) -> Column:
        def step(st, x):
            return (
                F.struct(F.greatest(st.pos, x.end).alias("pos")), x.end > st.pos,
                F.struct(x.start.alias("start"), x.end.alias("end"),
                         F.concat(F.lit("["), x.entity_type, F.lit("]")).alias("out")),
            )

        return fold_emit(hits, F.struct(F.lit(0).alias("pos")), step,
                         "struct<start:int,end:int,out:string>")

    masked = let(
        F.struct(blocks(F.col("text")).alias("p"), F.length("text").alias("n"),
                 outermost(F.col("hits")).alias("e")),
        lambda v: splice(v.p, v.n, v.e),
    )
    return (
        rows.withColumn("hits", F.array_sort(found))
        .withColumn("text", F.when(F.col("__null"), F.lit(None).cast("string"))
                    .when(F.size("hits") == 0, F.col("text")).otherwise(masked))
        .drop("__null")
    )
