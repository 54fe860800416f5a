"""The whole job: documents to masked texts, hits, review queue and summary.

From the text to the masked text every step is an expression on the document's
own row.  Nothing is shuffled, unless override tables are joined by ``doc_id``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.functions.arrays import let
from kuronuri.functions.spans import (
    candidate,
    company_expand_end,
    drop_kept,
    resolve_final,
    splice,
)
from kuronuri.functions.text import blocks, cut, norm_terms
from kuronuri.operators.detect import DEFAULT_PATTERNS, with_candidates
from kuronuri.operators.dictionary import DictMatcher, with_terms
from kuronuri.operators.overrides import Overrides, with_overrides
from kuronuri.operators.party import allowlist, with_parties
from kuronuri.operators.replace import (
    first_seen_numbers,
    is_review,
    needs_number,
    reason_of,
    replacement_of,
)
from kuronuri.policy import Policy
from kuronuri.vocab import Pattern

HIT_FIELDS = (
    "entity_type", "start", "end", "score", "original", "replacement", "reason", "source",
)


def forced_candidates(forced: Column) -> Column:
    return F.transform(
        forced,
        lambda f: candidate(f.start, f.end, f.entity, 1.0, source="forced", label=f.label,
                            forced_reason=f.reason),
    )


def expand_spans(spans: Column, pieces: Column, length: Column) -> Column:
    """Final extent and text of each resolved span."""

    def one(r: Column) -> Column:
        plain = r.source != "forced"
        end = F.when(
            plain & (r.entity == "COMPANY"),
            company_expand_end(pieces, length, r.original, r.end),
        ).otherwise(r.end)
        return let(
            end,
            lambda e: candidate(
                r.start, e, r.entity, r.score, r.source, r.pattern, r.label, r.forced_reason,
                r.ord,
                F.when(plain & (e == r.end), r.original).otherwise(
                    cut(pieces, r.start, F.least(e, length))
                ),
            ),
        )

    return F.transform(spans, one)


def mask(docs: DataFrame, policy: Policy | None = None, overrides: Overrides | None = None,
         matchers: Sequence[DictMatcher] = (),
         patterns: Sequence[Pattern] = DEFAULT_PATTERNS,
         terms: DataFrame | None = None) -> DataFrame:
    """Mask ``docs(doc_id, text)``.

    ``matchers`` are short lists of dictionary terms; ``terms(entity, term, score, bounded)`` is a
    table of them, of any size, that is joined to the texts.

    The result has one row per document: ``masked``, the arrays ``hits`` and
    ``review``, and the party columns.  Several outputs can be taken from it; to
    compute it once, write it out first (see ``sources.sinks.write_result``).
    """
    policy = policy or Policy()
    d = with_parties(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    d = with_overrides(d, overrides, policy.priorities)
    d = d.withColumn(
        "allow",
        allowlist(policy.allow_terms, F.col("self_names"), F.col("party_labels"), F.col("once")),
    )
    kinds = None
    if terms is not None:
        d, kinds = with_terms(d, terms), "dict_kinds"
    d = with_candidates(d, policy, matchers, patterns, kinds=kinds)
    # Counted once for a document, not for every span of it.
    length, pieces = F.col("__length"), F.col("pieces")
    d = d.withColumns({"pieces": blocks(F.col("text")), "__length": F.length("text")})
    d = d.withColumn(
        "spans",
        drop_kept(
            resolve_final(
                F.concat("candidates", forced_candidates(F.col("forced"))), policy.priorities
            ),
            F.col("keep"),
        ),
    )
    d = d.withColumn("spans", expand_spans(F.col("spans"), pieces, length))

    # Terms are compared in normal form.  Fixed allow terms are normalized here,
    # the rest together with the span texts.
    d = d.withColumn(
        "norms",
        norm_terms(
            F.concat(
                F.transform("spans", lambda s: s.original), "self_names", "party_labels", "once"
            )
        ),
    )
    fixed = sorted(
        {
            " ".join(unicodedata.normalize("NFKC", t).split())
            for t in (*policy.allow_terms, *vocab.TRADITIONAL_LABELS, *vocab.STRUCTURAL_TERMS)
        }
    )
    n = F.size("spans")
    d = d.withColumns(
        {
            "allow_norm": F.concat(
                F.slice("norms", n + 1, F.size("norms")), F.array(*[F.lit(t) for t in fixed])
            ),
            "rows": F.zip_with(
                "spans", F.slice("norms", 1, n),
                lambda c, t: F.struct(c.alias("c"), t.alias("norm")),
            ),
        }
    )
    d = d.withColumn(
        "rows",
        F.transform(
            "rows",
            lambda r: F.struct(
                r.c.alias("c"), r.norm.alias("norm"),
                reason_of(r.c, r.norm, F.col("allow_norm"), pieces, length, policy.mode)
                .alias("reason"),
            ),
        ),
    )
    d = d.withColumn(
        "numbers",
        first_seen_numbers(
            F.transform(
                "rows",
                lambda r: F.when(
                    needs_number(r, policy),
                    F.struct(r.c.entity.alias("entity"), r.norm.alias("norm")),
                ),
            )
        ),
    )
    d = d.withColumn(
        "hits",
        F.zip_with(
            "rows", "numbers",
            lambda r, k: F.struct(
                r.c.entity.alias("entity_type"), r.c.start.alias("start"),
                r.c.end.alias("end"), r.c.score.alias("score"),
                r.c.original.alias("original"),
                replacement_of(r, k, policy).alias("replacement"),
                r.reason.alias("reason"), r.c.source.alias("source"),
            ),
        ),
    )
    edits = F.transform(
        "hits",
        lambda h: F.struct(h.start.alias("start"), h.end.alias("end"), h.replacement.alias("out")),
    )
    d = d.withColumns(
        {
            "masked": F.when(F.size("hits") == 0, F.col("text")).otherwise(
                splice(pieces, length, edits)
            ),
            "review": F.filter("hits", lambda h: is_review(h, policy.review_threshold)),
        }
    )
    return d.select(
        *docs.columns, "masked", "hits", "review", "tier", "definitions", "self_names",
        "counter_names", "party_labels", "forced", "keep", "once",
    )
