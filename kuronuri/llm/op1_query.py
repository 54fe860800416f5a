"""Query ``op1_licenses``: licences of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kuronuri.llm.licenses import AFTER, BEFORE, LEAST, TEMPLATES, scan_licenses
from kuronuri.llm.registry import query
from kuronuri.llm.tables import documents

#: The tables have no paths: documents lie in folders by source, language and hundreds of ids, and a
#: short one that names a licence is a licence file of its language folder, from which the others there
#: inherit.  The length only names the file: every text is scanned whole.
SHORT_TEXT = 300
PATH = (
    "concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), "
    f"case when length(text) <= {SHORT_TEXT} and text like '%icense%' then '/LICENSE-' "
    "else concat('/', coalesce(cast(floor(doc_id / 100) as int), -1), '/') end, coalesce(doc_id, -1), '.txt')"
)
_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
_TOLD = r"[^\s]*(?:licen[cs]|copyright|permission|redistribut|public\x20domain|rights\x20reserved)[^\s]*"
_PASSAGE = rf"(?i)(?:[^\s]+[\x20\t]+){{0,{BEFORE}}}{_TOLD}(?:[\x20\t]+[^\s]+){{0,{AFTER}}}"
_ROWS = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(TEMPLATES))

ORACLE = rf"""
with f as (select doc_id, coalesce(text, '') as text, {PATH} as path from documents),
parts as (select doc_id, generate_subscripts(ps, 1) as n, unnest(ps) as passage
          from (select doc_id, case when path like '%/LICENSE-%' then [text]
                                    else regexp_extract_all(text, '{_PASSAGE}') end as ps from f)),
told as (select template, license, unnest(regexp_extract_all(lower(t), '{_WORD}')) as w
         from (values {_ROWS}) v(template, license, t)),
tf as (select doc_id, n, w, count(*) as tf
       from (select doc_id, n, unnest(regexp_extract_all(lower(passage), '{_WORD}')) as w from parts)
       where w in (select w from told) group by all),
idf as (select w, ln((1.0 + (select count(*) from parts)) / (1 + coalesce(df, 0))) + 1 as idf
        from (select distinct w from told) left join
             (select w, count(*) as df from tf group by w) using (w)),
theirs as (select template, license, w, count(*) * any_value(idf) as tw from told join idf using (w)
           group by template, license, w),
tn as (select template, sqrt(sum(tw * tw)) as tn from theirs group by template),
own as (select doc_id, n, w, tf * idf as pw from tf join idf using (w)),
pn as (select doc_id, n, sqrt(sum(pw * pw)) as pn from own group by doc_id, n),
near as (select doc_id, n, license, round(sum(pw * tw) / (tn * pn), 9) as similarity
         from own join theirs using (w) join tn using (template) join pn using (doc_id, n)
         group by doc_id, n, template, license, tn, pn),
best as (select doc_id, license, similarity from near where similarity >= {LEAST}
         qualify row_number() over (partition by doc_id order by similarity desc, license) = 1),
placed as (select doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, license, similarity
           from f left join best using (doc_id)),
said as (select dir as above, license as from_above from placed
         where license is not null and path like '%/LICENSE-%'
         qualify row_number() over (partition by dir order by similarity desc, path) = 1),
nearest as (select doc_id, above, from_above from placed join said
            on starts_with(dir || '/', above || '/')
            qualify row_number() over (partition by doc_id order by length(above) desc) = 1)
select doc_id, path, coalesce(license, from_above) as license, similarity,
       case when license is null then above end as inherited_from
from placed left join nearest using (doc_id)
"""


@query("op1_licenses", ORACLE)
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir).withColumn("path", F.expr(PATH)))
