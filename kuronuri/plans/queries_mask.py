"""Registered queries of the whole job and of its tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kuronuri.operators import report
from kuronuri.operators.detect import chunk_bounds, tier, with_candidates
from kuronuri.operators.overrides import Overrides
from kuronuri.operators.party import allowlist, with_parties
from kuronuri.plans import fixtures as fx
from kuronuri.plans import oracle as o
from kuronuri.plans.catalog import query
from kuronuri.plans.masking import mask
from kuronuri.policy import Policy

MASKED = (
    "select s.doc_id, masked, cast(count(h.s) as integer) as n_hits from spliced s"
    " left join hits h on h.doc_id = s.doc_id group by s.doc_id, masked"
)


def _masked(result):
    return result.select("doc_id", "masked", F.size("hits").alias("n_hits"))


@query("mask_documents", o.chain(MASKED))
def mask_documents(spark, sf_dir):
    """Flagship: documents and contracts through the three length tiers."""
    return _masked(mask(fx.mixed(spark, sf_dir)))


@query("splice_mask", o.chain(MASKED, tier="fast"))
def splice_mask(spark, sf_dir):
    return _masked(mask(fx.mixed(spark, sf_dir), Policy(force_fast=True)))


@query("mask_black", o.chain(MASKED, tier="fast", mode="BLACK"))
def mask_black(spark, sf_dir):
    return _masked(mask(fx.mixed(spark, sf_dir), Policy(force_fast=True, mode="BLACK")))


@query("replace_decide", o.chain(f"select {o.HIT_COLUMNS} from hits"))
def replace_decide(spark, sf_dir):
    """All hits with replacement and reason."""
    return report.hits_table(mask(fx.mixed(spark, sf_dir))).drop("hit_no")


@query("review_flag", o.chain(f"select {o.HIT_COLUMNS}, true as review_flag from hits where {o.REVIEW}"))
def review_flag(spark, sf_dir):
    return report.review_table(mask(fx.mixed(spark, sf_dir))).drop("review_no")


# Overrides derived from the customers: a keep-span over the e-mail line, a forced
# span over a fixed range with and without a label, and rows that must vanish.
FORCED = "select doc_id, s, e, entity, label, freason from ({})".format(
    " union all ".join(
        f"select concat('c', c_custkey) as doc_id, {row} from customer"
        for row in (
            "4 as s, 14 as e, 'CUSTOM' as entity, 'XX' as label, 'forced:ui_override' as freason",
            "60 + c_custkey % 40, 64 + c_custkey % 40, 'PERSON', cast(null as varchar), 'forced:mask_once'",
            "60 + c_custkey % 40, 63 + c_custkey % 40, 'PERSON', 'lost', 'forced:mask_once'",
        )
    )
)
KEEP = "select concat('c', c_custkey) as doc_id, 75 as s, 90 as e from customer"
ONCE = "select concat('c', c_custkey) as doc_id, '¥' || (10 + c_custkey % 90) || ',000' as term from customer"


def overrides(spark, sf_dir) -> Overrides:
    c = fx.table(spark, sf_dir, "customer")
    doc = F.expr("concat('c', c_custkey)").alias("doc_id")

    def rows(start, end, entity, label, reason):
        return c.select(
            doc, F.expr(start).cast("string").alias("start"), F.expr(end).cast("string").alias("end"),
            F.lit(entity).alias("entity"), F.lit(label).cast("string").alias("label"),
            F.lit(reason).cast("string").alias("reason"),
        )

    forced = (
        rows("4", "14", None, "XX", "forced:ui_override")
        .unionByName(rows("60 + c_custkey % 40", "64 + c_custkey % 40", "PERSON", None, None))
        .unionByName(rows("60 + c_custkey % 40", "63 + c_custkey % 40", "PERSON", "lost", None))
        .unionByName(rows("30", "30", "PERSON", "void", None))
        .unionByName(rows("'x'", "30", "PERSON", "void", None))
        .unionByName(rows("-1", "30", "PERSON", "void", None))
    )
    keep = c.select(doc, F.lit(75).alias("start"), F.lit(90).alias("end")).unionByName(
        c.select(doc, F.lit(5).alias("start"), F.lit(5).alias("end"))
    )
    once = c.select(doc, F.expr("concat('¥', 10 + c_custkey % 90, ',000')").alias("term"))
    return Overrides(forced, keep, once)


@query("mask_overrides",
       o.chain(f"select {o.HIT_COLUMNS} from hits", tier="fast", src=fx.CONTRACTS_SQL, forced=FORCED, keep=KEEP, once=ONCE))
def mask_overrides(spark, sf_dir):
    """Contracts with forced spans, keep-spans and one-off allowed terms."""
    docs = fx.contracts(spark, sf_dir)
    result = mask(docs, Policy(force_fast=True), overrides(spark, sf_dir))
    return report.hits_table(result).drop("hit_no")


def _candidates(spark, sf_dir, policy):
    docs = with_parties(fx.mixed(spark, sf_dir)).withColumn(
        "allow", allowlist(policy.allow_terms, F.col("self_names"), F.col("party_labels"))
    )
    found = with_candidates(docs, policy)
    return (
        found.select("doc_id", F.explode_outer("candidates").alias("c"))
        .where(F.col("c").isNotNull())
        .select("doc_id", "c.start", "c.end", "c.entity", "c.score", "c.original")
    )


def _found_sql(size: int = 1 << 30) -> str:
    return (
        f"with recursive corpus as materialized ({fx.MIXED_SQL}), {o.parties_cte()}, {o.full_cte(size, 300)}"
        ' select doc_id, cast(s as integer) as start, cast(e as integer) as "end", entity, score,'
        " m as original from found"
    )


@query("detect_full", _found_sql())
def detect_full(spark, sf_dir):
    """Full tier over whole texts of any length: case ignored, contained spans dropped, first fold."""
    return _candidates(spark, sf_dir, Policy())


@query("detect_chunked", _found_sql(2_000))
def detect_chunked(spark, sf_dir):
    """Chunks of 2,000 characters, so that many texts have several."""
    return _candidates(spark, sf_dir, Policy(chunk_size=2_000))


@query(
    "chunk_split",
    f"with recursive corpus as materialized ({fx.CORPUS_SQL}), {o.chunks_cte('corpus', 1000, 100)}"
    " select doc_id, cast(off as integer) as off, cast(len as integer) as len from chunks",
)
def chunk_split(spark, sf_dir):
    return (
        fx.corpus(spark, sf_dir)
        .select("doc_id", F.explode(chunk_bounds(F.col("text"), 1000, 100)).alias("c"))
        .select("doc_id", "c.off", "c.len")
    )


@query(
    "tier_route",
    f"select doc_id, case when length(text) >= 20000 then 'fast' when length(text) >= 3000"
    f" then 'chunked' else 'full' end as tier from ({fx.CORPUS_SQL})",
)
def tier_route(spark, sf_dir):
    policy = Policy(chunk_size=3000, fast_threshold_chars=20000)
    return fx.corpus(spark, sf_dir).select("doc_id", tier(F.length("text"), policy).alias("tier"))
