"""Contract parties: who is defined as which label in the header of a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.functions.arrays import empty, let
from kuronuri.functions.regex import SPACE, java_regex, match_spans
from kuronuri.functions.text import strip

_END = r"\z"


def clean_name(name: Column) -> Column:
    """Entity name without role word in front and without joining particles around it.

    One pass takes each leading word as often as it stands there (never the whole
    name), then each trailing particle once while more than two characters are
    there.  Passes repeat until nothing changes.
    """
    roles = "|".join(vocab.NAME_ROLE_PREFIXES)
    start = strip(F.regexp_replace(strip(name), f"^(?:{roles})[・:：]?{SPACE}*", ""))
    lead = [f"(?s)^(?:{'[)]' if w == ')' else w}{SPACE}*)+(?=.)" for w in vocab.NAME_LEADING]
    trail = [f"(?s)^(?=.{{3}})(.*?){SPACE}*{w}{_END}" for w in vocab.NAME_TRAILING]
    dirty = (
        "(?s)^(?:" + "|".join(w.replace(")", "[)]") for w in vocab.NAME_LEADING) + ").|"
        "..[" + "".join(vocab.NAME_TRAILING) + "]" + _END
    )

    def one_pass(s: Column) -> Column:
        for rx in lead:
            s = F.regexp_replace(s, rx, "")
        for rx in trail:
            s = F.regexp_replace(s, rx, "$1")
        return s

    # Every pass that changes anything removes a character, and a name that is
    # clean is passed on untouched.
    def clean(s: Column) -> Column:
        passes = F.aggregate(
            F.sequence(F.lit(1), F.length(s)), s,
            lambda t, _: F.when(t.rlike(dirty), one_pass(t)).otherwise(t),
        )
        return F.when(s.rlike(dirty), passes).otherwise(s)

    return let(start, clean)


DEFINITION = (
    "struct<kind:int,label:string,entity_name:string,position:string,start:int,end:int>"
)


def _definition(kind: int, label: Column, name: Column, position: Column, m: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), label.alias("label"), name.alias("entity_name"),
        position.alias("position"), m.s.alias("start"), m.e.alias("end"),
    )


def _name(raw: Column) -> Column:
    return let(clean_name(raw), lambda n: F.when(F.length(n) >= 2, n).otherwise(F.lit("")))


def position_define(label: Column) -> Column:
    return (
        F.when(label.isin(*vocab.TRADITIONAL_LABELS), label)
        .when(label.isin(*vocab.ROLE_NAMES), "role")
        .when(label.isin(*vocab.STRUCTURAL_TERMS), "structural")
        .otherwise("custom")
    )


def position_reverse(label: Column) -> Column:
    return F.when(label.isin(*vocab.TRADITIONAL_LABELS), label).otherwise("custom")


def position_role(label: Column) -> Column:
    return (
        F.when(label.isin(*vocab.ROLE_NAMES), "role")
        .when(label.isin(*vocab.STRUCTURAL_TERMS), "structural")
        .otherwise("custom")
    )


def define_matches(head: Column) -> Column:
    """Definitions of the form ``NAME（以下「LABEL」という）``."""
    ms = match_spans(head, java_regex(vocab.PARTY_DEFINE), (("以下",), ("という",)), groups=(1, 2))
    return F.transform(
        ms,
        lambda m: let(
            strip(m.g2), lambda lb: _definition(1, lb, _name(m.g1), position_define(lb), m)
        ),
    )


def reverse_matches(head: Column) -> Column:
    """Definitions of the form ``「LABEL」（NAME）``."""
    needs = (("「", "『", "｢", '"'), ("（", "("))
    ms = match_spans(head, java_regex(vocab.PARTY_REVERSE), needs, groups=(1, 2))
    return F.transform(
        ms,
        lambda m: let(
            strip(m.g1), lambda lb: _definition(2, lb, _name(m.g2), position_reverse(lb), m)
        ),
    )


def role_matches(head: Column) -> Column:
    """Definitions of the form ``以下「LABEL」という`` with or without a name."""
    ms = match_spans(head, java_regex(vocab.PARTY_ROLE), (("以下",), ("という",)), groups=(1,))
    return F.transform(
        ms,
        lambda m: let(
            strip(m.g1), lambda lb: _definition(3, lb, F.lit(""), position_role(lb), m)
        ),
    )


def head_of(text: Column, chars: int = vocab.HEAD_CHARS) -> Column:
    """The head of a text, for a caller that wants no more than that scanned."""
    return text.substr(1, chars)


def dedupe_definitions(defs: Column) -> Column:
    """First definition of each label wins; a blank label defines nothing."""

    def firsts(v: Column) -> Column:
        return F.filter(
            v.defs, lambda d, i: (d.label != "") & (F.array_position(v.labels, d.label) == i + 1)
        )

    return let(
        F.struct(defs.alias("defs"), F.transform(defs, lambda d: d.label).alias("labels")), firsts
    )


def definitions(text: Column) -> Column:
    return dedupe_definitions(
        F.concat(define_matches(text), reverse_matches(text), role_matches(text))
    )


def with_parties(docs: DataFrame) -> DataFrame:
    """Add ``definitions``, ``self_names``, ``counter_names`` and ``party_labels``.

    Texts without a quoted definition skip the work; most rows of a mixed
    collection do.
    """
    text = F.col("text")
    docs = docs.withColumn(
        "definitions",
        F.concat(define_matches(text), reverse_matches(text), role_matches(text)),
    ).withColumn(
        "definitions",
        F.when(F.size("definitions") == 0, empty(DEFINITION)).otherwise(
            dedupe_definitions(F.col("definitions"))
        ),
    )
    return docs.withColumns(
        {
            "self_names": self_names(F.col("definitions")),
            "counter_names": counter_names(F.col("definitions")),
            "party_labels": F.transform("definitions", lambda d: d.label),
        }
    )


def _named(defs: Column) -> Column:
    return F.filter(defs, lambda d: (d.kind == 1) & (d.entity_name != ""))


def self_names(defs: Column) -> Column:
    """Names of 甲, and of the first role label while no own name is known."""
    own = F.filter(_named(defs), lambda d: (d.label == "甲") | (d.position == "role"))
    kept = F.filter(own, lambda d, i: (d.label == "甲") | (i == 0))
    return F.array_distinct(F.transform(kept, lambda d: d.entity_name))


def counter_names(defs: Column) -> Column:
    kept = F.filter(_named(defs), lambda d: d.label == "乙")
    return F.array_distinct(F.transform(kept, lambda d: d.entity_name))


def allowlist(policy_terms: Sequence[str], self_names: Column, labels: Column,
              once: Column | None = None) -> Column:
    """Distinct terms that stay readable, in order of their source."""

    def lits(words):
        return F.array(*[F.lit(w) for w in words]).cast("array<string>")

    parts = [
        lits(policy_terms), self_names, labels, lits(vocab.TRADITIONAL_LABELS),
        lits(vocab.STRUCTURAL_TERMS),
    ]
    if once is not None:
        parts.append(F.coalesce(once, lits(())))
    return F.array_distinct(F.concat(*parts))


def parties(docs: DataFrame) -> DataFrame:
    """One row per definition."""
    return (
        with_parties(docs)
        .select("doc_id", F.explode_outer("definitions").alias("d"))
        .where(F.col("d").isNotNull())
        .select("doc_id", "d.label", "d.entity_name", "d.position", "d.start", "d.end")
    )
