"""Query ``op10_jaccard``: near duplicates among all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kuronuri.llm.jaccard_join import similar_documents
from kuronuri.llm.registry import query
from kuronuri.llm.tables import documents

# All pairs by shared shingles, then components by the least id that spreads along links.
ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (select distinct doc_id, unnest(
        case when len(ws) >= 5 then [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)]
             when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh
      from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared
          from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b
          where 100 * shared >= 80 * (x.n + y.n - shared)),
reach as (select doc_id, doc_id as root from w
          union
          select links.b, reach.root from reach join links on links.a = reach.doc_id)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles,
       min(reach.root) as component_id
from w left join n using (doc_id) join reach using (doc_id) group by w.doc_id
"""


@query("op10_jaccard", ORACLE)
def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir))
