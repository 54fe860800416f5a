"""Query ``op12_manifest``: leaf, root and proof of every document, with some tampered with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuronuri.llm.merkle import manifest
from kuronuri.llm.registry import query
from kuronuri.llm.tables import documents

_LEAF = " || ".join(
    f"case when {c} is null then '-' else strlen(({c})::varchar)::varchar || ':' || ({c})::varchar end"
    for c in ("doc_id", "source", "lang", "{n}", "text"))

# Levels are lists per language; every leaf then climbs by its place in them.
ORACLE = f"""
with recursive bit(i, k, c) as (
  select i, 0, i from range(256) t(i)
  union all select i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) from bit where k < 8),
tab as (select list(c order by i) as tab from bit where k = 8),
d as (
  select row_number() over () as row_no, doc_id, lang,
         sha256({_LEAF.format(n='n_chars')}) as leaf,
         case when xor(list_reduce(
                list_prepend(4294967295::bigint,
                             list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
                lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0
              then sha256({_LEAF.format(n='(n_chars + 1)')}) end as changed
  from documents, tab),
p as (select *, row_number() over (partition by lang order by doc_id, leaf) - 1 as place,
             coalesce('=' || lang, '') as g
      from d),
up as (
  select g, 0 as level, list(leaf order by place) as xs from p group by g
  union all
  select g, level + 1, list_transform(range(0, (len(xs) + 1) // 2),
    lambda i: sha256(xs[2 * i + 1] || coalesce(xs[2 * i + 2], '')))
  from up where len(xs) > 1),
sub as (select g, xs[1] as subroot, level as top, row_number() over (order by g) - 1 as place
        from up where len(xs) = 1),
over as (
  select 0 as level, list(subroot order by place) as xs from sub
  union all
  select level + 1, list_transform(range(0, (len(xs) + 1) // 2),
    lambda i: sha256(xs[2 * i + 1] || coalesce(xs[2 * i + 2], '')))
  from over where len(xs) > 1),
levels as (
  select sub.g, up.level, up.xs from up join sub on sub.g = up.g and up.level < sub.top
  union all
  select sub.g, sub.top + over.level, over.xs from over, sub where len(over.xs) > 1),
climb as (
  select row_no, g, 0 as level, place, coalesce(changed, leaf) as folded, '' as proof from p
  union all
  select c.row_no, c.g, c.level + 1, (case when c.level + 1 = s.top then s.place else c.place // 2 end),
    case when (case when c.level = s.top then s.place else c.place end) % 2 = 1
         then sha256(l.xs[c.place] || c.folded)
         else sha256(c.folded || coalesce(l.xs[c.place + 2], '')) end,
    c.proof || case when c.place % 2 = 1 then l.xs[c.place] else coalesce(l.xs[c.place + 2], '') end
  from (select climb.*, sub.top as t from climb join sub using (g)) c
  join sub s on s.g = c.g join levels l on l.g = c.g and l.level = c.level),
ended as (
  select row_no, arg_max(folded, level) as folded_root, sha256(arg_max(proof, level)) as proof_sha256
  from climb group by row_no)
select p.doc_id, p.leaf, sub.subroot, root.xs[1] as root, e.proof_sha256, e.folded_root,
       e.folded_root = root.xs[1] as verified
from p join sub using (g) join ended e using (row_no) join over root on len(root.xs) = 1
"""


@query("op12_manifest", ORACLE)
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(
        documents(spark, sf_dir), ("doc_id", "source", "lang", "n_chars", "text"), "lang",
        ("doc_id",), keep=("doc_id",),
        now={"n_chars": F.when(picked, F.col("n_chars") + 1).otherwise(F.col("n_chars"))},
    ).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
