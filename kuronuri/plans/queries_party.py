"""Registered queries on contract parties and allow-lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from kuronuri.operators import party
from kuronuri.plans import fixtures as fx
from kuronuri.plans import oracle as o
from kuronuri.plans.catalog import query
from kuronuri.policy import Policy

SRC = f"{fx.MIXED_SQL} union all {fx.PARTY_TEXTS_SQL}"
CTE = f"with corpus as materialized ({SRC}), {o.parties_cte()}"
DEF_COLUMNS = (
    "doc_id, label, entity_name, position, cast(s as integer) as start, cast(e as integer) as \"end\""
)


def docs(spark, sf_dir):
    return fx.mixed(spark, sf_dir).unionByName(fx.party_texts(spark, sf_dir))


def _one_form(name, matches, needs):
    # One form only, over texts that can hold it.
    sql = (
        f"with heads as materialized (select doc_id, text from ({SRC}) where {o.QUOTED} and {needs})"
        f" select {DEF_COLUMNS} from ({o.party_defs(name[6:])})"
    )

    @query(name, sql)
    def run(spark, sf_dir):
        found = matches(F.col("text"))
        return (
            docs(spark, sf_dir).select("doc_id", F.explode_outer(found).alias("d"))
            .where(F.col("d").isNotNull())
            .select("doc_id", "d.label", "d.entity_name", "d.position", "d.start", "d.end")
        )


_one_form("party_define", party.define_matches, "contains(text, 'という')")
_one_form("party_reverse", party.reverse_matches, "true")
_one_form("party_role", party.role_matches, "contains(text, 'という')")


@query("party_dedupe", f"{CTE} select {DEF_COLUMNS} from defs")
def party_dedupe(spark, sf_dir):
    return party.parties(docs(spark, sf_dir))


# Labels of all kinds, spread over the parts.
LABELS = ("甲", "癸", "委託者", "乙", "本契約", "本項", "発注者", "利用者")
LABEL_SQL = "case p_partkey % 8 " + " ".join(
    f"when {i} then {o.q(w)}" for i, w in enumerate(LABELS)
) + " end"


def _position_sql(*tests):
    return "case " + " ".join(
        f"when {o.in_list('label', words)} then {value}" for words, value in tests
    ) + " else 'custom' end"


_TRAD = (party.vocab.TRADITIONAL_LABELS, "label")
_ROLE = (party.vocab.ROLE_NAMES, "'role'")
_STRUCT = (party.vocab.STRUCTURAL_TERMS, "'structural'")


@query(
    "party_position",
    f"select p_partkey, label, {_position_sql(_TRAD, _ROLE, _STRUCT)} as in_define,"
    f" {_position_sql(_TRAD)} as in_reverse, {_position_sql(_ROLE, _STRUCT)} as in_role"
    f" from (select p_partkey, {LABEL_SQL} as label from part)",
)
def party_position(spark, sf_dir):
    label = F.col("label")
    return (
        fx.table(spark, sf_dir, "part")
        .select("p_partkey", F.expr(LABEL_SQL).alias("label"))
        .select("p_partkey", "label", party.position_define(label).alias("in_define"),
                party.position_reverse(label).alias("in_reverse"),
                party.position_role(label).alias("in_role"))
    )


# Names with joining words around them, one form per part.
NAME_FORMS = (
    "concat('　', p_name, ' ')", "concat('と', p_name, 'は')", "concat('及びと', p_name)",
    "concat('委託者・', p_name)", "concat('甲：、および ', p_name, 'のは')", "'及びとAは'", "'とと'",
    "concat('）)・', p_name, 'が を に')", "'はは'", "concat('乙', p_brand, ' と')",
)
NAME_SQL = "case p_partkey % 10 " + " ".join(
    f"when {i} then {e}" for i, e in enumerate(NAME_FORMS)
) + " end"


@query(
    "party_clean_name",
    f"select p_partkey, {o.clean_name('raw')} as name from (select p_partkey, {NAME_SQL} as raw from part)",
)
def party_clean_name(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(
        "p_partkey", party.clean_name(F.expr(NAME_SQL)).alias("name")
    )


@query(
    "party_self_counter",
    f"{CTE} select doc_id, 'self' as side, name from self_names"
    " union all select doc_id, 'counter', name from counter_names",
)
def party_self_counter(spark, sf_dir):
    p = party.with_parties(docs(spark, sf_dir))

    def side(name):
        return F.transform(f"{name}_names", lambda n: F.struct(F.lit(name).alias("side"), n.alias("name")))

    # Parties are read once for both sides; the outer form keeps the optimizer from copying them into a filter.
    rows = p.select("doc_id", F.explode_outer(F.concat(side("self"), side("counter"))).alias("x"))
    return rows.where(F.col("x").isNotNull()).select("doc_id", "x.side", "x.name")


def _allow(spark, sf_dir):
    p = party.with_parties(docs(spark, sf_dir)).withColumn(
        "once", F.array(F.concat(F.lit("once "), "doc_id"), F.lit("甲"))
    )
    return p.select(
        "doc_id",
        party.allowlist(
            Policy().allow_terms, F.col("self_names"), F.col("party_labels"), F.col("once")
        ).alias("terms"),
    )


ALLOW_SQL = f"{CTE} select doc_id, term from allow union select doc_id, concat('once ', doc_id) from corpus"


@query("allowlist_build", ALLOW_SQL)
def allowlist_build(spark, sf_dir):
    # The outer form keeps the optimizer from building all lists twice, once in a filter on their size.
    rows = _allow(spark, sf_dir).select("doc_id", F.posexplode_outer("terms").alias("n", "term"))
    return rows.where(F.col("n").isNotNull()).drop("n")


@query(
    "union_allowlist",
    f"select doc_id, cast(count(*) as integer) as n_terms from ({ALLOW_SQL}) group by doc_id",
)
def union_allowlist(spark, sf_dir):
    """Size of each list: a set union, so no term counts twice."""
    return _allow(spark, sf_dir).select("doc_id", F.size("terms").alias("n_terms"))


@query(
    "agg_distinct_terms",
    f"{CTE} select doc_id, string_agg(name, '|' order by kind, s) as names from"
    " (select doc_id, entity_name as name, min(kind) as kind, min(s) as s from"
    "  (select doc_id, entity_name, kind, s from defs where entity_name <> '' and kind <= 2)"
    "  group by doc_id, entity_name) group by doc_id",
)
def agg_distinct_terms(spark, sf_dir):
    """All names of a document, each once, in order."""
    p = party.with_parties(docs(spark, sf_dir))
    names = F.array_distinct(
        F.filter(F.transform("definitions", lambda d: d.entity_name), lambda n: n != "")
    )
    return (
        p.select("doc_id", F.array_join(names, "|").alias("names")).where(F.col("names") != "")
    )


@query(
    "limit_scan",
    f"select doc_id, substr(text, 1, 8000) as head from ({SRC})",
)
def limit_scan(spark, sf_dir):
    """The head of a text: what a caller scans who asks for no more."""
    return docs(spark, sf_dir).select("doc_id", party.head_of(F.col("text")).alias("head"))
