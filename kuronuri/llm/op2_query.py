"""Query ``op2_pii``: personal data of all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kuronuri.llm.pii import BASE, CONTEXT, KINDS, find_pii
from kuronuri.llm.registry import query
from kuronuri.llm.tables import documents

_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"


def _luhn(digits: str) -> str:
    doubled = f"2 * substr({digits}, i, 1)::int"
    return (
        f"list_sum([case when (length({digits}) - i) % 2 = 0 then substr({digits}, i, 1)::int "
        f"when {doubled} > 9 then {doubled} - 9 else {doubled} end "
        f"for i in range(1, length({digits}) + 1)]) % 10 = 0"
    )


_PLAIN = "replace(m, ' ', '')"
_TURNED = f"(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4))"
# Remainders letter by letter, since the whole number has up to 68 digits.
_MOD97 = (
    f"length({_PLAIN}) between 15 and 34 and list_reduce(list_prepend(0, "
    f"[case when ascii(c) >= 65 then ascii(c) - 55 else ascii(c) - 48 end "
    f"for c in string_split({_TURNED}, '')]), "
    "lambda a, n: (a * (case when n > 9 then 100 else 10 end) + n) % 97) = 1"
)
_MOD11_SUM = (
    f"(list_sum([substr({_DIGITS}, 12 - i, 1)::int * (case when i < 7 then i + 1 else i - 5 end) "
    "for i in range(1, 12)]) % 11)"
)
_SQL = {
    # entity: (pattern, pattern of the match's own text in the group, validity)
    "EMAIL": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "IP": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
           "list_max([p::hugeint for p in string_split(m, '.')]) <= 255"),
    "CARD": (r"[0-9](?:[\x20-]?[0-9])+",
             f"length({_DIGITS}) between 14 and 19 and {_luhn(_DIGITS)}"),
    "PHONE": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 10 and 15"),
}


def _kind_sql(entity: str, ord_: int) -> str:
    regex, valid = _SQL[entity]
    kind = KINDS[ord_]
    context = kind.context.replace("'", "''")
    return f"""
        select doc_id, row_no, s as start, {ord_} as ord, s + length(m) as "end",
               '{entity.lower()}' as kind
        from (select doc_id, row_no, m, gap, behind,
                     coalesce(sum(length(gap) + length(m)) over before, 0) + length(gap) as s
              from (select doc_id, row_no, generate_subscripts(ms, 1) as i, unnest(ms) as m,
                           unnest(gs[1:len(ms)]) as gap, unnest(gs[2:len(ms) + 1]) as behind
                    from (select doc_id, row_no, regexp_extract_all(text, '{regex}') as ms,
                                 string_split_regex(text, '{regex}') as gs from d))
              window before as (partition by row_no order by i
                                rows between unbounded preceding and 1 preceding))
        where {valid} and {kind.score} + (case when regexp_matches(
              right(gap, {CONTEXT}) || chr(10) || left(behind, {CONTEXT}), '{context}')
              then 0.3 else 0 end) >= 0.5"""


ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as row_no
           from documents),
hits as ({' union all '.join(_kind_sql(k, i) for i, k in enumerate(BASE))}),
per as (select row_no,
               count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip,
               count(*) filter (kind = 'card') as n_card,
               count(*) filter (kind = 'phone') as n_phone,
               string_agg(kind || ':' || start || ':' || "end", ',' order by start, ord) as spans
        from hits group by row_no)
select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip,
       coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
       sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join per using (row_no)
"""


def _digest(hits: Column) -> Column:
    return F.array_join(
        F.transform(hits, lambda h: F.concat_ws(":", F.lower(h.entity_type), h.start, h.end)), ","
    )


# The given tables hold no bank account or personal numbers, so that the SQL needs base kinds only.
@query("op2_pii", ORACLE)
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir)).withColumn(
        "base", F.filter("hits", lambda h: h.entity_type.isin(*BASE))
    )

    def count(entity: str) -> Column:
        return F.size(F.filter("base", lambda h: h.entity_type == entity)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k.lower()}") for k in BASE],
        F.sha2(_digest(F.col("base")), 256).alias("base_sha256"),
        _digest(F.col("hits")).alias("spans"),
    )
