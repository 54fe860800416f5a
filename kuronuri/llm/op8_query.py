"""Query ``op8_quality``: quality rules over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kuronuri.llm.quality import LineRules, clean_lines
from kuronuri.llm.registry import query
from kuronuri.llm.tables import documents

_R = LineRules()
_BARE = r"regexp_replace({0}, '[\x20\x09-\x0D]', '', 'g')"
_SYM = r"regexp_replace({0}, '[#*$%&|<>]', '', 'g')"


def _quoted(regex: str) -> str:
    return "'" + regex.replace("'", "''") + "'"


ORACLE = rf"""
with d as (
  select row_number() over () as row_no, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
             list_filter(string_split(text, chr(10)), lambda l: length({_BARE.format('l')}) > 0) as lines
      from d),
three as (select row_no, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as win
          from (select row_no, ws, unnest(range(1, len(ws) - 1)) as i from w)),
twice as (select row_no, i from three
          qualify count(*) over (partition by row_no, win) > 1),
rep as (select row_no, count(distinct i + k) as n_repeat_words
        from twice, (values (0), (1), (2)) t(k) group by row_no),
line as (select row_no, l, min(j) as j, count(*) as n
         from (select row_no, unnest(lines) as l, generate_subscripts(lines, 1) as j from w)
         group by row_no, l),
good as (select row_no, sum(length({_BARE.format('l')})) as left_chars, count(*) as n_good
         from line
         where not (
           (length(l) - length({_SYM.format('l')})) * 100 > length(l) * {_R.max_symbols_pct}
           or (length(l) >= {_R.min_unended_chars} and not regexp_matches(l, {_quoted(_R.terminal)}))
           or regexp_matches(l, {_quoted(_R.separators)})
           or (length(l) <= {_R.max_boilerplate_chars}
               and regexp_matches(l, {_quoted(_R.boilerplate)}))
           or (length(l) >= {_R.min_shout_chars} and upper(l) = l and lower(l) <> l))
         group by row_no),
per as (select w.row_no, doc_id, len(ws) as n_words, length({_BARE.format('text')}) as word_chars,
               length(text) - length({_SYM.format('text')}) as n_symbols,
               len(lines) - coalesce(k.n_lines, 0) as n_dup_lines,
               coalesce(n_repeat_words, 0) as n_repeat_words,
               len(lines) - coalesce(n_good, 0) as n_failed_lines,
               coalesce(left_chars, 0) as left_chars
        from w left join rep using (row_no) left join good using (row_no)
        left join (select row_no, count(*) as n_lines from line group by row_no) k using (row_no)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
             case when word_chars = 0 then 0.0::double
                  else (word_chars - left_chars) * 100.0::double / word_chars end as lost_pct
      from per)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars,
       n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed,
       (not base_failed and lost_pct <= {_R.max_lost_pct}) as kept,
       n_failed_lines::bigint as n_failed_lines, lost_pct
from f
"""


@query("op8_quality", ORACLE)
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_failed_lines", "lost_pct",
    )
