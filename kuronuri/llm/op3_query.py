"""Query ``op3_mix``: mixing all documents by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuronuri.llm.mixing import mix_sources
from kuronuri.llm.registry import query
from kuronuri.llm.tables import documents

#: The fixed values of the query.
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 17

# Water-filling round by round, as it is told; the operator finds the level at once.
ORACLE = r"""
with recursive d as (
  select doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, 'null')), 1, 8))::bigint as draw
  from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last)
             as n from d group by source),
w as (select source, source_size, n, [5.0, 2.0, 1.0][((n - 1) % 3 + 1)::int]::double as weight,
             2.0 * source_size as cap, 1.5 * sum(source_size) over () as total from s),
rounds as (
  select 0 as round, source, weight, cap, total, false as clamped,
         total * weight / sum(weight) over () as target from w
  union all
  select round + 1, source, weight, cap, total, clamped or target >= cap,
         case when clamped or target >= cap then cap else
           (total - sum(case when clamped or target >= cap then cap else 0 end) over ()) * weight
           / sum(case when clamped or target >= cap then 0 else weight end) over () end
  from rounds where round < (select count(*) from s)),
goal as (select w.source, w.source_size, r.target::double as target,
                floor(r.target / greatest(w.source_size, 1) + 1e-12)::bigint as whole
         from w join rounds r on w.source is not distinct from r.source
         where r.round = (select count(*) from s)),
t as (select d.doc_id, d.size, g.source_size, g.target, g.whole,
             greatest(0, round(g.target - g.whole * g.source_size))::bigint
             - coalesce(sum(d.size) over (partition by d.source order by d.draw, d.doc_id, d.size
                        rows between unbounded preceding and 1 preceding), 0) as room
      from d join goal g on d.source is not distinct from g.source)
select doc_id, size, source_size::bigint as source_size, target,
       (whole * size + least(greatest(room, 0), size))::bigint as taken
from t
"""


@query("op3_mix", ORACLE)
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir), WEIGHTS, SHARE, MAX_EPOCHS, SEED)
    return mixed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("repeats") * F.col("size") + F.col("part")).alias("taken"),
    )
