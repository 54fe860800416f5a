"""Building blocks of the check SQL: spans by regular expression without look-around.

The check engine has no look-around.  Where a pattern needs it, text is first cut
into runs of characters that a match and its neighbours can consist of; inside a
run every start is tried, and the neighbours are tested by hand.
"""

from __future__ import annotations

from contextlib import contextmanager

from kuronuri import vocab
from kuronuri.plans import fixtures as fx

WORD = r"\p{L}\p{N}_"
SPACE = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
S, NS = f"[{SPACE}]", f"[^{SPACE}]"
D = r"\p{Nd}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def matches(src: str, rx: str, where: str = "") -> str:
    """``(doc_id, i, s, m)`` of all matches of ``rx``; s is the 0-based start."""
    guard = f" where {where}" if where else ""
    return f"""
 select doc_id, i,
  cast(sum(length(gg)) over (partition by doc_id order by i)
  + coalesce(sum(length(mm)) over (partition by doc_id order by i
             rows between unbounded preceding and 1 preceding), 0) as bigint) as s, mm as m
 from (select doc_id, unnest(m) as mm, unnest(g[:len(m)]) as gg,
              generate_subscripts(m, 1) as i
       from (select doc_id, regexp_extract_all(text, {q(rx)}) as m,
                    string_split_regex(text, {q(rx)}) as g
             from {src}{guard}) where len(m) > 0)"""


def plain(src: str, rx: str, pre: int = 0, post: int = 0) -> str:
    """Spans ``(doc_id, s, e, m)``; ``pre`` and ``post`` characters are context only."""
    return f"""
 select doc_id, s + {pre} as s, s + length(m) - {post} as e,
        substr(m, {pre + 1}, length(m) - {pre + post}) as m
 from ({matches(src, rx)})"""


def in_runs(src: str, run: str, core: str, before: str, after: str) -> str:
    """Spans of ``core`` with no ``before`` character in front and no ``after`` behind."""
    return f"""
 select doc_id, s, s + length(m) as e, m from (
  with recursive cand as materialized (
   select doc_id, s + j - 1 as s, m,
          row_number() over (partition by doc_id order by s + j - 1) as rn
   from (select doc_id, s, j,
                regexp_extract(substr(run, j), {q(f'^({core})(?:[^{after}]|$)')}, 1) as m
         from (select doc_id, s, m as run, unnest(range(1, length(m) + 1)) as j
               from ({matches(src, run)}))
         where j = 1 or not regexp_matches(substr(run, j - 1, 1), {q(f'[{before}]')}))
   where m <> ''),
  walk as (
   select doc_id, rn, s, m, true as used, s + length(m) as pos from cand where rn = 1
   union all
   select c.doc_id, c.rn, c.s, c.m, c.s >= w.pos,
          case when c.s >= w.pos then c.s + length(c.m) else w.pos end
   from walk w join cand c on c.doc_id = w.doc_id and c.rn = w.rn + 1)
  select doc_id, s, m from walk where used)"""


KANJI = "[一-龥]"
_NUM = rf"(?:{D}{{1,3}}(?:,{D}{{3}})+|{D}+)(?:\.{D}+)?"
CORP = "(?:株式会社|有限会社|合同会社)"


def detector(key: str, src: str = "corpus", full: bool = False) -> str:
    """Spans of one pattern; ``full`` ignores case and lets dots meet newlines."""
    i = "(?i)" if full else ""
    if key == "det_email":
        return in_runs(src, rf"[{WORD}.%+@-]+",
                       i + r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
                       rf"{WORD}.-", rf"{WORD}.-")
    if key == "det_phone":
        return in_runs(src, rf"[{D}ー-]+", rf"0{D}{{1,4}}[-ー]?{D}{{1,4}}[-ー]?{D}{{3,4}}", D, D)
    if key == "det_postal":
        return in_runs(src, rf"[{D}ー-]+", rf"{D}{{3}}[-ー]?{D}{{4}}", D, D)
    if key == "det_compact_id":
        return in_runs(src, rf"[A-Za-z{D}]+", i + rf"[A-Z]{{1,3}}{D}{{2,6}}", "A-Za-z0-9", "A-Za-z0-9")
    if key == "det_hyphen_id":
        return in_runs(src, rf"[A-Za-z{D}-]+",
                       i + rf"[A-Z]{{2,10}}-{D}{{2,4}}(?:-[A-Z0-9]{{1,6}}){{1,6}}",
                       "A-Za-z0-9", "A-Za-z0-9")
    if key == "det_name_line":
        return plain(src, rf"(?m)^[\t \x{{3000}}]*{KANJI}{{1,4}}[\t \x{{3000}}]+{KANJI}{{1,4}}[\t \x{{3000}}]*$")
    if key == "det_contact":
        return plain(src, rf"担当[:：]{KANJI}{{2,4}}", 3)
    if key == "det_contact_paren":
        return plain(src, rf"\(担当[:：]{KANJI}{{2,4}}\)", 4, 1)
    if key == "det_contact_fwparen":
        return plain(src, rf"（担当[:：]{KANJI}{{2,4}}）", 4, 1)
    if key == "det_age_colon":
        return plain(src, rf"年齢[:：]{D}{{1,3}}", 3)
    if key == "det_age_line":
        return plain(src, rf"\n{D}{{1,3}}\n(?:男|女)\n", 1, 3)
    if key == "det_money":
        return plain(src, rf"[¥￥]{S}*{_NUM}|{_NUM}{S}*(?:円|万円|千円|百万円)")
    if key == "det_ymd":
        return plain(src, rf"{D}{{4}}[/.年-]{S}*{D}{{1,2}}[/.月-]{S}*{D}{{1,2}}{S}*日?")
    if key == "det_wareki":
        return plain(src, i + rf"(?:令和|平成|昭和|R|H|S){S}*(?:{D}{{1,2}}|元){S}*年")
    if key == "det_address":
        dot = "(?s:.)" if full else r"[^\n]"
        return plain(src, f"{dot}{dot}??[都道府県]{dot}{{1,30}}?[市区町村]{dot}{{0,40}}")
    if key == "det_company_prefix":
        return plain(src, rf"{CORP}{S}*{NS}{{1,30}}")
    if key == "det_company_suffix":
        return plain(src, rf"{NS}{{1,30}}{S}*{CORP}")
    if key == "det_company_abbr":
        return plain(src, rf"(?:（株）|\(株\)){S}*{NS}{{1,30}}")
    if key == "det_parties":
        return (
            f" select doc_id, s, s + 1 as e, m from ({matches(src, f'[{WORD}]+')})"
            " where m in ('甲', '乙', '丙', '丁')"
        )
    raise KeyError(key)


def detections(src: str = "corpus", keys=tuple(vocab.PATTERNS), full: bool = False) -> str:
    """Union of patterns: ``(doc_id, s, e, entity, score, pattern, ord, m)``."""
    parts = []
    for i, key in enumerate(vocab.PATTERNS):
        if key in keys:
            p = vocab.PATTERNS[key]
            parts.append(
                f"select doc_id, s, e, {q(p.entity)} as entity, cast({p.score} as double) as score,"
                f" {q(p.name)} as pattern, {i} as ord, m from ({detector(key, src, full)})"
            )
    return "\nunion all ".join(parts)


def with_corpus(body: str, src: str = fx.CORPUS_SQL) -> str:
    return f"with corpus as materialized ({src})\n{body}"


# --- parties ------------------------------------------------------------------------

_QO, _QC, _QIN = r'[「『｢"]', r'[」』｣"]', r'[^」』｣"]'
DEFINE = (
    rf"(?m)(?:^|[。、，,\n・と]){S}*([^{SPACE}（(「『。、，,]{{2,60}}?){S}*(?:（|\(){S}*以下{S}*"
    rf"{_QO}({_QIN}{{1,20}}){_QC}{S}*という{S}*(?:。|）|\))"
)
REVERSE = rf"{_QO}({_QIN}{{1,10}}){_QC}{S}*(?:（|\()({S}*[^\n]{{2,60}}?){S}*(?:）|\))"
ROLE = rf"以下{S}*{_QO}({_QIN}{{1,20}}){_QC}{S}*という"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{S}+|{S}+$')}, '', 'g')"


def clean_name(x: str, passes: int = 4) -> str:
    roles = "|".join(vocab.NAME_ROLE_PREFIXES)
    x = strip(f"regexp_replace({strip(x)}, {q(f'^(?:{roles})[・:：]?{S}*')}, '')")
    for _ in range(passes):
        for w in vocab.NAME_LEADING:
            w = "[)]" if w == ")" else w
            x = f"regexp_replace({x}, {q(f'(?s)^(?:{w}{S}*)+(.)')}, {q(chr(92) + '1')})"
        for w in vocab.NAME_TRAILING:
            x = f"regexp_replace({x}, {q(f'(?s)^(..+?){S}*{w}$')}, {q(chr(92) + '1')})"
    return x


def in_list(x: str, words) -> str:
    return f"{x} in ({', '.join(q(w) for w in words)})"


def party_matches(src: str, rx: str, groups) -> str:
    """``(doc_id, s, e, g1, g2)``."""
    cols = ", ".join(f"regexp_extract_all(text, {q(rx)}, {g}) as a{g}" for g in groups)
    pick = ", ".join(f"a{g}[i] as g{g}" for g in groups)
    return f"""select x.doc_id, s, s + length(m) as e, {pick}
 from ({matches(src, rx)}) x join (select doc_id, {cols} from {src}) y on x.doc_id = y.doc_id"""


def party_defs(kind: str, src: str = "heads") -> str:
    """``(kind, doc_id, label, entity_name, position, s, e)`` of one form."""
    if kind == "define":
        base, label, name = party_matches(src, DEFINE, (1, 2)), strip("g2"), clean_name("g1")
        pos = (f"case when {in_list('label', vocab.TRADITIONAL_LABELS)} then label"
               f" when {in_list('label', vocab.ROLE_NAMES)} then 'role'"
               f" when {in_list('label', vocab.STRUCTURAL_TERMS)} then 'structural' else 'custom' end")
        n = 1
    elif kind == "reverse":
        base, label, name = party_matches(src, REVERSE, (1, 2)), strip("g1"), clean_name("g2")
        pos = f"case when {in_list('label', vocab.TRADITIONAL_LABELS)} then label else 'custom' end"
        n = 2
    else:
        base, label, name = party_matches(src, ROLE, (1,)), strip("g1"), "''"
        pos = (f"case when {in_list('label', vocab.ROLE_NAMES)} then 'role'"
               f" when {in_list('label', vocab.STRUCTURAL_TERMS)} then 'structural' else 'custom' end")
        n = 3
    return f"""select {n} as kind, doc_id, label, case when length(name) >= 2 then name else '' end as entity_name,
 {pos} as position, s, e from (select doc_id, s, e, {label} as label, {name} as name from ({base}))"""


#: Every form of definition has one of these.
QUOTED = "(contains(text, '「') or contains(text, '『') or contains(text, '｢') or contains(text, '\"'))"


def parties_cte(src: str = "corpus") -> str:
    """CTEs ``heads, alldefs, defs, self_names, counter_names, allow``."""
    fixed = (*vocab.TRADITIONAL_LABELS, *vocab.STRUCTURAL_TERMS)
    return f"""heads as materialized (select doc_id, text from {src} where {QUOTED}),
alldefs as materialized ({party_defs('define')} union all {party_defs('reverse')} union all {party_defs('role')}),
defs as materialized (select * exclude (rn) from (select *, row_number() over (partition by doc_id, label order by kind, s) as rn
 from alldefs where label <> '') where rn = 1),
own as (select *, row_number() over (partition by doc_id order by s) as rn from defs
 where kind = 1 and entity_name <> '' and (label = '甲' or position = 'role')),
self_names as (select distinct doc_id, entity_name as name from own where label = '甲' or rn = 1),
counter_names as (select distinct doc_id, entity_name as name from defs
 where kind = 1 and entity_name <> '' and label = '乙'),
allow as materialized (select doc_id, name as term from self_names union select doc_id, label from defs
 union select doc_id, unnest([{', '.join(q(w) for w in fixed)}]) from {src})"""


# --- folds --------------------------------------------------------------------------


#: Priorities and label formats that the check SQL is built with.
USED = {"priorities": vocab.PRIORITIES, "formats": vocab.LABEL_FORMATS}


@contextmanager
def policy_values(priorities, formats):
    """Build SQL for a policy with values of its own."""
    before = dict(USED)
    USED.update(priorities=priorities, formats=formats)
    try:
        yield
    finally:
        USED.update(before)


def prio(entity: str) -> str:
    cases = " ".join(f"when {q(k)} then {v}" for k, v in USED["priorities"].items())
    return f"case {entity} {cases} else 0 end"


def resolve(src: str, name: str, order: str, by: str = "doc_id") -> str:
    """CTEs that walk ``src`` and leave the kept rows in ``name``.

    ``src`` needs ``s, e, entity, score, forced``; ``order`` sorts equal starts.
    """
    return f"""{name}_c as materialized (select *, forced_rank as k0, -pr as k1, s - e as k2, -score as k3,
  row_number() over (partition by {by} order by s, {order}) as rn
 from (select *, case when forced then 0 else 1 end as forced_rank, {prio('entity')} as pr from {src})),
{name}_w as (
 select {by}, rn, 1 as slot, rn as cur, e as cur_e, k0, k1, k2, k3 from {name}_c where rn = 1
 union all
 select c.{by}, c.rn,
  case when c.s < w.cur_e then w.slot else w.slot + 1 end,
  case when c.s < w.cur_e and not ((c.k0, c.k1, c.k2, c.k3) < (w.k0, w.k1, w.k2, w.k3)) then w.cur else c.rn end,
  case when c.s < w.cur_e and not ((c.k0, c.k1, c.k2, c.k3) < (w.k0, w.k1, w.k2, w.k3)) then w.cur_e else c.e end,
  case when c.s < w.cur_e and not ((c.k0, c.k1, c.k2, c.k3) < (w.k0, w.k1, w.k2, w.k3)) then w.k0 else c.k0 end,
  case when c.s < w.cur_e and not ((c.k0, c.k1, c.k2, c.k3) < (w.k0, w.k1, w.k2, w.k3)) then w.k1 else c.k1 end,
  case when c.s < w.cur_e and not ((c.k0, c.k1, c.k2, c.k3) < (w.k0, w.k1, w.k2, w.k3)) then w.k2 else c.k2 end,
  case when c.s < w.cur_e and not ((c.k0, c.k1, c.k2, c.k3) < (w.k0, w.k1, w.k2, w.k3)) then w.k3 else c.k3 end
 from {name}_w w join {name}_c c on c.{by} = w.{by} and c.rn = w.rn + 1),
{name} as materialized (select c.* exclude (rn, k0, k1, k2, k3, forced_rank, pr)
 from (select {by}, slot, arg_max(cur, rn) as cur from {name}_w group by {by}, slot) k
 join {name}_c c on c.{by} = k.{by} and c.rn = k.cur)"""


FINAL_ORDER = "k0, k1, k2, k3, ord"
FIRST_ORDER = "s - e, ord"


def final_order() -> str:
    return "forced_rank, -pr, s - e, -score, ord"


def chunks_cte(src: str, size: int, overlap: int) -> str:
    """CTE ``chunks(doc_id, n, off, len)`` of texts that are long enough."""
    cut = (
        f"case when pos + {size} < length(text) then "
        f"case when instr(reverse(substr(text, pos + {size // 2} + 1, {size - size // 2})), chr(10)) > 0 "
        f"then pos + {size} - instr(reverse(substr(text, pos + {size // 2} + 1, {size - size // 2})), chr(10)) + 1 "
        f"else pos + {size} end else length(text) end"
    )
    return f"""walk as (
 select doc_id, 0 as n, 0 as pos, {cut.replace('pos', '0')} as stop from {src} where length(text) > {size}
 union all
 select doc_id, n + 1, pos, {cut} from (
  select w.doc_id, w.n, case when w.stop - {overlap} <= w.pos then w.stop else w.stop - {overlap} end as pos, c.text
  from walk w join {src} c on c.doc_id = w.doc_id) where pos < length(text)),
chunks as materialized (select doc_id, n, pos as off, stop - pos as len from walk
 union all select doc_id, 0, 0, length(text) from {src} where length(text) <= {size})"""


def full_cte(size: int = 1 << 30, overlap: int = 300, src: str = "corpus") -> str:
    """CTEs that end in ``found``: candidates of the full tier over chunks."""
    return f"""{chunks_cte(src, size, overlap)},
pieces as materialized (select concat(c.doc_id, '#', n) as doc_id, c.doc_id as doc, off,
 substr(text, off + 1, len) as text from chunks c join {src} t on t.doc_id = c.doc_id),
raw as materialized ({detections('pieces', full=True)}),
held as materialized (select r.*, false as forced, p.doc, p.off from raw r join pieces p on p.doc_id = r.doc_id
 where not exists (select 1 from raw d where d.doc_id = r.doc_id and d.entity = r.entity
  and d.s <= r.s and d.e >= r.e and (-d.score, d.s, d.s - d.e, d.ord) < (-r.score, r.s, r.s - r.e, r.ord))
 and not exists (select 1 from allow a where a.doc_id = p.doc and a.term = r.m)),
{resolve('held', 'piecewise', 's - e, -score, ord')},
moved as (select doc as doc_id, s + off as s, e + off as e, entity, score, pattern, ord, m, forced, off
 from piecewise),
{resolve('moved', 'found', 's - e, off, ord')}"""


def fast_cte(src: str = "corpus") -> str:
    """CTE ``found``: candidates of the fast tier."""
    return f"""found as materialized (select d.*, false as forced from ({detections(src)}) d
 where not exists (select 1 from allow a where a.doc_id = d.doc_id and a.term = d.m))"""


# --- decisions ------------------------------------------------------------------------


def norm(x: str) -> str:
    """White space collapsed and trimmed; enough for texts without compatibility forms."""
    return f"trim(regexp_replace({x}, {q(S + '+')}, ' ', 'g'))"


def date_granular(x: str) -> str:
    w = rf"(令和|平成|昭和|R|H|S){S}*({D}{{1,2}}|元){S}*年"
    y = rf"({D}{{4}})[/.年-]{S}*({D}{{1,2}})[/.月-]{S}*({D}{{1,2}}){S}*(日)?"
    return (f"case when regexp_matches({x}, {q(w)}) then concat(regexp_extract({x}, {q(w)}, 1),"
            f" regexp_extract({x}, {q(w)}, 2), '年') when regexp_matches({x}, {q(y)})"
            f" then concat(regexp_extract({x}, {q(y)}, 1), '年') else '[DATE]' end")


def first_prefix(x: str, names) -> str:
    return "case " + " ".join(f"when starts_with({x}, {q(n)}) then {q(n)}" for n in names) + " end"


def address_cte(src: str, key: str, x: str, name: str, granularity: str = "UNTIL_CITY") -> str:
    """CTE ``name(key, coarse)`` for the distinct texts of ``src``."""
    split = r"^([^\n][^\n]??[都道府県])([^\n]*)"
    tail = {
        "FULL_MASK": "'[ADDRESS]'",
        "UNTIL_PREF": "coalesce(pref, '[ADDRESS]')",
        "UNTIL_CITY": "case when pref is null then '[ADDRESS]' when starts_with(muni, pref) then muni"
        r" else concat(pref, regexp_extract(rest, '^([^\n]{1,10}?[市区町村])', 1)) end",
    }[granularity]
    return f"""{name} as (select {key}, case when t = '' then '' else {tail} end as coarse
 from (select *, {first_prefix('concat(pref, rest)', vocab.MUNICIPALITIES)} as muni
 from (select {key}, t, coalesce(listed, nullif(regexp_extract(t, {q(split)}, 1), '')) as pref,
  case when listed is not null then substr(t, length(listed) + 1) else regexp_extract(t, {q(split)}, 2) end as rest
 from (select *, {first_prefix('t', vocab.PREFECTURES)} as listed
 from (select distinct {key}, {strip(x)} as t from {src})))))"""


def money_context(text: str, s: str, e: str) -> str:
    words = "|".join(vocab.MONEY_WORDS)
    w = vocab.MONEY_WINDOW
    lo = f"greatest({s} - {w}, 0)"
    return f"regexp_matches(substr({text}, {lo} + 1, least({e} + {w}, length({text})) - {lo}), {q(words)})"


def label_sql(entity: str, n: str) -> str:
    cases = []
    for k, t in USED["formats"].items():
        if "{n}" in t:
            a, b = t.split("{n}")
            cases.append(f"when {q(k)} then concat({q(a)}, {n}, {q(b)})")
        elif "{n" in t:
            a, b = t.split("{n:02d}")
            cases.append(f"when {q(k)} then concat({q(a)}, lpad(cast({n} as varchar), cast(greatest(2, length(cast({n} as varchar))) as integer), '0'), {q(b)})")
        else:
            cases.append(f"when {q(k)} then {q(t)}")
    return (f"case {entity} {' '.join(cases)} else concat('[', {entity}, '_',"
            f" lpad(cast({n} as varchar), cast(greatest(2, length(cast({n} as varchar))) as integer), '0'), ']') end")


def decide_cte(mode: str = "LABEL", src: str = "spans") -> str:
    """CTE ``hits`` for ``src(doc_id, s, e, entity, score, m, forced, label, freason)``."""
    fixed = ", ".join(q(t) for t in dict.fromkeys(("甲", "乙", "丙", "丁", *vocab.TRADITIONAL_LABELS, *vocab.STRUCTURAL_TERMS)))
    black = f"repeat('■', greatest(3, length(m)))"
    numbered = "entity not in (" + ", ".join(["''", *(q(k) for k, t in USED["formats"].items() if "{n" not in t)]) + ")"
    tail = ("else 'mask:black'" if mode == "BLACK" else
            "when entity = 'DATE' then 'mask:date_granular' when entity = 'ADDRESS' then 'mask:address_granular' else 'mask:stable_id'")
    return f"""judged as materialized (select x.*, {norm('m')} as norm_m,
 case when forced then freason when entity = 'PARTIES' then 'keep:parties'
  when {norm('m')} <> '' and ({norm('m')} in ({fixed}) or exists (select 1 from allow a where a.doc_id = x.doc_id and {norm('a.term')} = {norm('m')}))
   then 'keep:allowlist'
  when entity = 'MONEY' and not {money_context('t.text', 's', 'e')} then 'keep:money_no_context'
  {tail} end as reason
 from {src} x join corpus t on t.doc_id = x.doc_id),
{address_cte("(select m from judged where entity = 'ADDRESS')", 'm', 'm', 'addr')},
named as (select doc_id, entity, norm_m, dense_rank() over (partition by doc_id, entity order by min(s)) as n
 from judged where {q(mode)} = 'LABEL' and {numbered} and ((forced and coalesce(label, '') = '') or reason = 'mask:stable_id')
 group by doc_id, entity, norm_m),
hits as materialized (select j.doc_id, j.s, j.e, j.entity, j.score, j.m, j.reason, case when forced then 'forced' else 'analyzer' end as source,
 case when {q(mode)} = 'BLACK' and (forced or reason = 'mask:black') then {black.replace('m)', 'j.m)')}
  when forced and coalesce(label, '') <> '' then label
  when not forced and starts_with(reason, 'keep:') then j.m
  when reason = 'mask:date_granular' then {date_granular('j.m')}
  when reason = 'mask:address_granular' then addr.coarse
  else {label_sql('j.entity', 'coalesce(n, 0)')} end as repl
 from judged j left join named k on k.doc_id = j.doc_id and k.entity = j.entity and k.norm_m = j.norm_m
 left join addr on addr.m = j.m and j.entity = 'ADDRESS')"""


SPLICE = """spliced as (select t.doc_id, concat(coalesce(string_agg(concat(substr(text, last + 1, greatest(s - last, 0)), repl), '' order by s), ''),
 case when max(e) is null then any_value(text) else substr(any_value(text), cast(max(e) as bigint) + 1) end) as masked
 from corpus t left join (select *, coalesce(max(e) over (partition by doc_id order by s
  rows between unbounded preceding and 1 preceding), 0) as last from hits) h on h.doc_id = t.doc_id group by t.doc_id)"""

HIT_COLUMNS = """doc_id, entity as entity_type, cast(s as integer) as start, cast(e as integer) as "end", score,
 m as original, repl as replacement, reason, source"""
REVIEW = "((score <> 0 and score < 0.8) or reason = 'keep:money_no_context' or source = 'forced')"


def chain(select: str, tier: str = "full", mode: str = "LABEL", src: str = fx.MIXED_SQL,
          forced: str | None = None, keep: str | None = None, once: str | None = None) -> str:
    """The whole job over ``src`` and a final select over its CTEs.

    ``forced(doc_id, s, e, entity, label, freason)``, ``keep(doc_id, s, e)`` and
    ``once(doc_id, term)`` are selects.
    """
    found = full_cte() if tier == "full" else fast_cte()
    parties = parties_cte()
    if once:
        parties = parties[:-1] + f" union {once})"
    add = (
        f" union all select doc_id, s, e, entity, 1.0 as score, 1000000 as ord, cast(null as varchar) as m, true as forced, label, freason from ({forced})"
        if forced else ""
    )
    drop = (
        f" where not exists (select 1 from ({keep}) k where k.doc_id = r.doc_id and r.s < k.e and r.e > k.s)"
        if keep else ""
    )
    return f"""with recursive corpus as materialized ({src}),
{parties},
{found},
every as (select doc_id, s, e, entity, score, ord, m, forced, cast(null as varchar) as label, cast(null as varchar) as freason from found{add}),
{resolve('every', 'resolved', final_order())},
spans as materialized (select r.* exclude (m), case when forced then substr(t.text, r.s + 1, r.e - r.s) else r.m end as m
 from resolved r join corpus t on t.doc_id = r.doc_id{drop}),
{decide_cte(mode)},
{SPLICE}
{select}"""
