"""Query ``op11_decontaminate``: test items in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuronuri.llm.decontaminate import find_contamination
from kuronuri.llm.registry import query
from kuronuri.llm.tables import documents

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    r" 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLE = f"""
with d as (select row_number() over () as row_no, doc_id, {_WORDS} as ws from documents),
b as (select item_id::varchar as item_id, {_WORDS} as ws from benchmark),
win as (
  select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') as w
  from (select *, unnest(range(1, len(ws) - k + 2)) as i
        from (select *, least(len(ws), 10) as k from b where len(ws) > 0))),
sizes as (select distinct k from win),
place as (
  select row_no, i, k, array_to_string(ws[i:i + k - 1], ' ') as w
  from (select row_no, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, sizes where len(ws) >= k)),
hit as (select row_no, i, win.k, item_id from place join win using (k, w)),
word as (select row_no, count(distinct j) as n_hit
         from (select distinct row_no, unnest(range(i, i + k)) as j from hit) group by row_no),
item as (select row_no, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
         from (select distinct row_no, item_id from hit) group by row_no)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
       coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join word using (row_no) left join item using (row_no)
"""


@query("op11_decontaminate", ORACLE)
def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))
