"""Query ``op6_fingerprints``: fingerprints of all documents and of their edited texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuronuri.llm.registry import query
from kuronuri.llm.spotsigs import ANCHORS, edited_pairs
from kuronuri.llm.tables import documents

_LIST = ", ".join(f"'{a}'" for a in ANCHORS)

# Chains by joining each anchor with the content words behind it, counted along the text.
ORACLE = rf"""
with d as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
l as (select *, coalesce(lead(text) over (order by doc_id),
                         first_value(text) over (order by doc_id)) as next_text from d),
e as (select doc_id, n, text, next_text,
             left(text, (n - n // 2)::int) || left(next_text, (n // 2)::int) as edited from l),
t as (select doc_id, 1 as v, text as t from e union all select doc_id, 2, edited from e
      union all select doc_id, 3, next_text from e),
p as (select doc_id, v, regexp_replace(' ' || regexp_replace(regexp_replace(lower(t),
        '([\x{{4E00}}-\x{{9FFF}}\x{{30A0}}-\x{{30FF}}])([\x{{3041}}-\x{{309F}}])', '\1 \2', 'g'),
        '([\x{{3041}}-\x{{309F}}])([\x{{4E00}}-\x{{9FFF}}\x{{30A0}}-\x{{30FF}}])', '\1 \2', 'g')
        || ' ', '[^\p{{L}}\p{{N}}]+', ' ', 'g') as plain from t),
w as (select doc_id, v, i, word, word in ({_LIST}) as anchor
      from (select doc_id, v, unnest(string_split(trim(plain, ' '), ' ')) as word,
                   generate_subscripts(string_split(trim(plain, ' '), ' '), 1) as i from p)
      where word <> ''),
c as (select *, sum(case when anchor then 0 else 1 end) over (partition by doc_id, v order by i) as k
      from w),
s as (select distinct a.doc_id, a.v,
             left(md5(a.word || ' ' || x.word || ' ' || y.word || ' '), 8) as sig
      from c a join c x on x.doc_id = a.doc_id and x.v = a.v and not x.anchor and x.k = a.k + 1
      join c y on y.doc_id = a.doc_id and y.v = a.v and not y.anchor and y.k = a.k + 2
      where a.anchor),
f as (select p.doc_id, p.v, case when s.sigs is not null then s.sigs when plain = ' ' then []
             else [left(md5(plain), 8)] end as sigs
      from p left join (select doc_id, v, list_sort(list(sig)) as sigs from s group by doc_id, v) s
      on s.doc_id = p.doc_id and s.v = p.v),
j as (select a.doc_id, a.sigs as own, b.sigs as edited, c.sigs as next,
             len(list_intersect(a.sigs, b.sigs)) as both2, len(list_intersect(a.sigs, c.sigs)) as both3
      from f a join f b on b.doc_id = a.doc_id and b.v = 2 join f c on c.doc_id = a.doc_id and c.v = 3
      where a.v = 1)
select e.doc_id, e.n::bigint as n_chars, sha256(e.edited) as edited_sha256,
       array_to_string(j.own, ',') as fingerprint, array_to_string(j.edited, ',') as edited_fingerprint,
       case when len(own) + len(j.edited) = 0 then 1.0::double
            else both2::double / (len(own) + len(j.edited) - both2) end as near_edited,
       case when len(own) + len(next) = 0 then 1.0::double
            else both3::double / (len(own) + len(next) - both3) end as near_next
from e join j using (doc_id)
"""


@query("op6_fingerprints", ORACLE)
def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("fingerprint", ",").alias("fingerprint"),
        F.array_join("edited_fingerprint", ",").alias("edited_fingerprint"),
        "near_edited", "near_next")
