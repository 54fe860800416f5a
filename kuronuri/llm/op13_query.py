"""Query ``op13_importance``: a draw of documents that resembles the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kuronuri.llm.importance import resample
from kuronuri.llm.op11_query import _WORDS
from kuronuri.llm.registry import query
from kuronuri.llm.tables import documents

# Check sums of distinct words by a table of 256 entries; counts and sums document by document.
ORACLE = f"""
with recursive bit(i, k, c) as (
  select i, 0, i from range(256) t(i)
  union all select i, k + 1, xor(c >> 1, 3988292384 * (c & 1)) from bit where k < 8),
tab as (select list(c order by i) as tab from bit where k = 8),
d as (select row_number() over () as row_no, doc_id, {_WORDS} as ws from documents),
f as (select row_no, unnest(ws) as w from d),
g as (select unnest({_WORDS}) as w from benchmark),
v as (select w, hex(encode(w)) as x from (select w from f union select w from g)),
crc as (
  select w, xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(1, length(x), 2),
        lambda i: (instr('0123456789ABCDEF', substr(x, i, 1)) - 1) * 16
                  + instr('0123456789ABCDEF', substr(x, i + 1, 1)) - 1)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from v, tab),
s as (select bucket, count(*) as s from f join crc using (w) group by bucket),
t as (select bucket, count(*) as t from g join crc using (w) group by bucket),
gain as (
  select b.bucket, floor(1000 * ln(
    ((coalesce(t, 0) + 1)::double * ((select count(*) from f) + 10000)::double)
    / ((coalesce(s, 0) + 1)::double * ((select count(*) from g) + 10000)::double)))::bigint as gain
  from range(10000) b(bucket) left join s using (bucket) left join t using (bucket)),
weight as (select row_no, sum(gain)::bigint as weight
           from f join crc using (w) join gain using (bucket) group by row_no),
e as (
  select d.row_no, doc_id, len(ws)::bigint as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((
           ('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double)
           / 4294967296::double)))::bigint as score
  from d left join weight using (row_no)),
r as (select row_no, row_number() over (order by score desc, doc_id) as rank
      from e where n_features >= 20
      qualify rank <= (select count(*) * 10 // 100 from e where n_features >= 20))
select doc_id, n_features, weight, score, rank from e left join r using (row_no)
"""


@query("op13_importance", ORACLE)
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(
        documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), n=1,
        buckets=10_000, percent=10, min_words=20, seed=2024)
