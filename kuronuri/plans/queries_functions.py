"""Registered queries on scalar functions, predicates, sources and small projections."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from kuronuri.functions import text as tx
from kuronuri.functions.spans import company_expand_end, overlap, priority
from kuronuri.operators.dictionary import company_terms, detect_term_table, keyword_terms
from kuronuri.operators.layout import doc_warnings
from kuronuri.operators.overrides import normalize_forced, normalize_keep
from kuronuri.plans import fixtures as fx
from kuronuri.plans import oracle as o
from kuronuri.plans.catalog import query
from kuronuri.policy import Policy, load_policy
from kuronuri.sources.terms import parse_lines
from kuronuri.sources.texts import decode_auto


def case(key: str, exprs) -> str:
    n = len(exprs)
    return f"case {key} % {n} " + " ".join(f"when {i} then {e}" for i, e in enumerate(exprs)) + " end"


def part(spark, sf_dir):
    return fx.table(spark, sf_dir, "part")


# --- text functions over whole documents ----------------------------------------------


@query(
    "fn_norm_term",
    f"select doc_id, {o.norm('t')} as term from"
    f" (select doc_id, translate(text, '（）：', '():') as t from ({fx.MIXED_SQL}))",
)
def fn_norm_term(spark, sf_dir):
    """Normal form of whole texts (their compatibility forms are round brackets, colon and blank)."""
    return fx.mixed(spark, sf_dir).select("doc_id", tx.norm_term(F.col("text")).alias("term"))


ESCAPED = (
    "replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'),"
    " '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'), chr(10), '<br>')"
)


@query("fn_html_escape", f"select doc_id, {ESCAPED} as html from ({fx.CORPUS_SQL})")
def fn_html_escape(spark, sf_dir):
    return fx.corpus(spark, sf_dir).select("doc_id", tx.html_escape(F.col("text")).alias("html"))


_LINE = o.strip("replace(text, chr(10), ' ')")


@query(
    "fn_short",
    f"select doc_id, case when length(t) > 28 then concat(substr(t, 1, 27), '…') else t end as preview"
    f" from (select doc_id, {_LINE} as t from ({fx.CORPUS_SQL}))",
)
def fn_short(spark, sf_dir):
    return fx.corpus(spark, sf_dir).select("doc_id", tx.short(F.col("text")).alias("preview"))


@query("fn_black", f"select doc_id, repeat('■', greatest(3, length(text))) as bar from ({fx.CORPUS_SQL})")
def fn_black(spark, sf_dir):
    return fx.corpus(spark, sf_dir).select("doc_id", tx.black(F.col("text")).alias("bar"))


@query(
    "japanese_ratio",
    "select doc_id, case when length(text) = 0 then 0.0 else"
    " length(regexp_replace(text, '[^\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}]', '', 'g')) / length(text) end"
    f" as ratio from ({fx.CORPUS_SQL})",
)
def japanese_ratio(spark, sf_dir):
    return fx.corpus(spark, sf_dir).select("doc_id", tx.japanese_ratio(F.col("text")).alias("ratio"))


@query(
    "doc_warnings",
    "select doc_id, concat_ws('|', case when ratio < 0.2 then 'warning:pdf_low_japanese_ratio' end,"
    " case when n = 0 then 'warning:pdf_no_char_map' end,"
    " case when contains(text, '<w:ins') or contains(text, '<w:del') then 'warning:track_changes_detected' end)"
    " as warnings from (select doc_id, concat(text, case when length(text) % 2 = 0 then '<w:del/>' else '' end) as text,"
    " length(text) % 3 as n, case when length(text) = 0 then 0.0 else"
    " length(regexp_replace(text, '[^\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}]', '', 'g')) / length(text) end"
    f" as ratio from ({fx.CORPUS_SQL}))",
)
def doc_warnings_(spark, sf_dir):
    c = fx.corpus(spark, sf_dir)
    xml = F.concat("text", F.when(F.length("text") % 2 == 0, "<w:del/>").otherwise(""))
    warnings = doc_warnings(F.col("text"), F.length("text") % 3 != 0, xml)
    return c.select("doc_id", F.array_join(warnings, "|").alias("warnings"))


LABEL_N = "cast(p_partkey % 150 as integer)"
LABEL_E = case("p_partkey", ("'PERSON'", "'COMPANY'", "'EMAIL'", "'PARTIES'", "'CUSTOM'"))


@query(
    "fn_label_format",
    f"select p_partkey, {o.label_sql('e', 'n')} as label from"
    f" (select p_partkey, {LABEL_N} as n, {LABEL_E} as e from part)",
)
def fn_label_format(spark, sf_dir):
    from kuronuri.operators.replace import stable_label

    p = part(spark, sf_dir).select("p_partkey", F.expr(LABEL_N).alias("n"), F.expr(LABEL_E).alias("e"))
    return p.select("p_partkey", stable_label(F.col("e"), F.col("n"), Policy()).alias("label"))


PIECE = case("p_partkey", ("'■■■■'", "'[PERSON_01]'", "''", "'■a'"))


@query(
    "fn_piece_black",
    f"select p_partkey, case when r <> '' and replace(r, '■', '') = '' then repeat('■', p_size) else r end as piece"
    f" from (select p_partkey, p_size, {PIECE} as r from part)",
)
def fn_piece_black(spark, sf_dir):
    return part(spark, sf_dir).select(
        "p_partkey", tx.piece_black(F.expr(PIECE), F.col("p_size")).alias("piece")
    )


@query(
    "fn_overlap",
    "select l_orderkey, l_linenumber, l_partkey % 20 < l_suppkey % 20 + 3 and"
    " l_partkey % 20 + cast(l_quantity as integer) % 9 > l_suppkey % 20 as hit from lineitem",
)
def fn_overlap(spark, sf_dir):
    a, b = F.col("l_partkey") % 20, F.col("l_suppkey") % 20
    n = F.col("l_quantity").cast("int") % 9
    return fx.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", overlap(a, a + n, b, b + 3).alias("hit")
    )


DATES = case("p_partkey", (
    "concat('令和', p_size, '年')", "concat('  R ', p_size % 9, ' 年 5月')", "'平成元年 2001/1/2'",
    "concat(1990 + p_size, '/', p_size % 12 + 1, '/', p_size % 28 + 1)",
    "concat('契約 ', 1990 + p_size, '年 ', p_size % 12 + 1, '月', p_size % 28 + 1, '日')",
    "concat(1990 + p_size, '-0', p_size % 9 + 1, '.03')", "'未定'", "''",
))
_Y = rf"({o.D}{{4}})[/.年-]{o.S}*({o.D}{{1,2}})[/.月-]{o.S}*({o.D}{{1,2}}){o.S}*(日)?"
_W = rf"(令和|平成|昭和|R|H|S){o.S}*({o.D}{{1,2}}|元){o.S}*年"


@query(
    "fn_date_granular",
    f"select p_partkey, {o.date_granular('d')} as year, case when regexp_matches(d, {o.q(_W)}) then {o.date_granular('d')}"
    f" when regexp_matches(d, {o.q(_Y)}) then concat(regexp_extract(d, {o.q(_Y)}, 1), '年',"
    f" cast(cast(regexp_extract(d, {o.q(_Y)}, 2) as integer) as varchar), '月') else '[DATE]' end as ym,"
    f" '[DATE]' as full_mask from (select p_partkey, {DATES} as d from part)",
)
def fn_date_granular(spark, sf_dir):
    d = part(spark, sf_dir).select("p_partkey", F.expr(DATES).alias("d"))
    return d.select(
        "p_partkey", tx.date_granular(F.col("d")).alias("year"),
        tx.date_granular(F.col("d"), "YM").alias("ym"),
        tx.date_granular(F.col("d"), "FULL_MASK").alias("full_mask"),
    )


ADDRESSES = case("p_partkey", (
    "concat('東京都千代田区丸の内', p_size)", "concat(' 奈川県横浜市西区', p_size)", "'神奈川県横浜市西区'",
    "concat('京都府京都市左京区', p_size)", "'愛知県豊田市元町'", "'北海道函館市若松町'", "'XY県どこかの村'",
    "concat('no address ', p_size)", "'大阪府大阪市北区'", "'東京都'", "'   '",
))
_GRAINS = ("UNTIL_CITY", "UNTIL_PREF", "FULL_MASK")
_ADDR_CTES = ", ".join(o.address_cte("src", "a", "a", g.lower(), g) for g in _GRAINS)


@query(
    "fn_address_granular",
    f"with src as (select p_partkey, {ADDRESSES} as a from part), {_ADDR_CTES}"
    " select p_partkey, " + ", ".join(f"{g.lower()}.coarse as {g.lower()}_text" for g in _GRAINS)
    + " from src " + " ".join(f"join {g.lower()} on {g.lower()}.a = src.a" for g in _GRAINS),
)
def fn_address_granular(spark, sf_dir):
    d = part(spark, sf_dir).select("p_partkey", F.expr(ADDRESSES).alias("a"))
    return d.select(
        "p_partkey",
        *[tx.address_granular(F.col("a"), g).alias(f"{g.lower()}_text") for g in _GRAINS],
    )


PATHS = case("doc_id", (
    "concat('in/', source, '/', doc_id, '.TXT')", "concat(source, '/a..b:', doc_id, '.docx')",
    "concat('x/', lang, '|', doc_id, '.Pdf. .')", "concat('C:\\\\', source, '?', doc_id)",
    "concat(source, '/')", "concat('/', '.', doc_id)", "concat('a.b/', doc_id, '.DOCX')",
))
PATHS_DUCK = PATHS.replace("\\\\", "\\")
_BASE = "regexp_replace(path, '^.*/', '')"


@query(
    "safe_name",
    "select doc_id, coalesce(nullif(regexp_replace(regexp_replace(replace(b, '..', '_'),"
    " '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '[ .]+$', ''), ''), 'document') as name"
    f" from (select doc_id, {_BASE} as b from (select doc_id, {PATHS_DUCK} as path from documents))",
)
def safe_name(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", tx.safe_name(F.expr(PATHS)).alias("name")
    )


@query(
    "src_route_ext",
    "select doc_id, case when ext = '.docx' then 'docx' when ext = '.pdf' then 'pdf' else 'text' end as route"
    " from (select doc_id, lower(case when regexp_matches(b, '^\\.*[^.].*\\.[^.]*$')"
    " then regexp_extract(b, '(\\.[^.]*)$', 1) else '' end) as ext"
    f" from (select doc_id, {_BASE} as b from (select doc_id, {PATHS_DUCK} as path from documents)))",
)
def src_route_ext(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", tx.route_ext(F.expr(PATHS)).alias("route")
    )


# --- sources ----------------------------------------------------------------------------


@query("src_text_decode", f"select doc_id, text from ({fx.CONTRACTS_SQL})")
def src_text_decode(spark, sf_dir):
    """Contracts stored as bytes of two encodings come back as the same texts."""
    wide = F.expr("cast(substr(doc_id, 2) as int) % 2 = 0")
    raw = fx.contracts(spark, sf_dir).select(
        "doc_id",
        F.when(wide, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8")).alias("raw"))
    return raw.select("doc_id", decode_auto(F.col("raw")).alias("text"))


LINES = case("p_partkey", ("concat('  ', p_name, p_partkey, ' ')", "concat('# ', p_name)", "'   '", "concat(p_brand, '　')"))


def _lines(spark, sf_dir):
    return part(spark, sf_dir).select(
        F.col("p_partkey").alias("ord"), F.expr(LINES).alias("value"), F.col("p_size").alias("size")
    )


TERM_SQL = (
    f"select ord, term from (select p_partkey as ord, {o.strip(LINES)} as term from part)"
    " where term <> '' and not starts_with(term, '#')"
)


@query("src_term_list", TERM_SQL)
def src_term_list(spark, sf_dir):
    return parse_lines(_lines(spark, sf_dir))


@query(
    "src_dict_terms",
    "select term, cast(row_number() over (order by length(term) desc, ord) as integer) as place from"
    f" ({TERM_SQL})",
)
def src_dict_terms(spark, sf_dir):
    """All terms of a list, longest first: lengths, then lines inside each, are running counts."""
    from kuronuri.operators.ordinals import row_number_in, running

    terms = parse_lines(_lines(spark, sf_dir)).withColumn("len", F.length("term"))
    inside = row_number_in(terms, ["len"], "ord", "nth")
    sizes = terms.groupBy("len").agg(F.count("*").alias("n"))
    before = running(
        sizes.select(F.lit(0).alias("g"), "len", (-F.col("len")).alias("neg"), "n"),
        ["g"], "neg", F.col("n"), "longer").select("len", "longer")
    return inside.join(before, "len").select(
        "term", (F.col("longer") + F.col("nth")).cast("int").alias("place"))


_POLICY = """entities: [{name: EMAIL, priority: 100}, {name: DATE}, {name: ID, priority: 7}]
global: {allowlist: {terms: [甲, 乙]}}
review: {threshold: 0.5}
performance: {nlp_chunk_size: 100}
"""


@query(
    "src_policy",
    "select n_nationkey, case n_nationkey % 3 when 0 then 100 when 1 then 0 else 7 end as priority,"
    " n_nationkey / 10.0 < 0.5 as in_review, concat('甲', case when n_nationkey >= 100 then 'x' else '乙' end) as terms,"
    " concat(0, '/', 100, '/', 300, '/', 'LABEL') as others from nation",
)
def src_policy(spark, sf_dir):
    """A policy file with some sections: its values and the defaults, as literals over the nations."""
    with tempfile.NamedTemporaryFile("w", suffix=".yaml", encoding="utf-8") as f:
        f.write(_POLICY)
        f.flush()
        p = load_policy(f.name)
    names = F.array(*[F.lit(n) for n in p.priorities])
    entity = F.get(names, (F.col("n_nationkey") % 3).cast("int"))
    return fx.table(spark, sf_dir, "nation").select(
        "n_nationkey", priority(entity, p.priorities).alias("priority"),
        (F.col("n_nationkey") / 10 < p.review_threshold).alias("in_review"),
        F.lit("".join(p.allow_terms)).alias("terms"),
        F.lit(f"{p.fast_threshold_chars}/{p.chunk_size}/{p.chunk_overlap}/{p.mode}").alias("others"),
    )


# --- dictionaries -----------------------------------------------------------------------


def _dict_sql(select: str, col: str, bounded: bool) -> str:
    # Brands run from 1 to 25, so the longest term at a place is one of these.
    core = "Supplier#[0-9]{9}" if bounded else "Brand#(?:1[0-9]|2[0-5]|[1-9])"
    if bounded:
        spans = o.in_runs("corpus", rf"[{o.WORD}#]+", "(?i)" + core, o.WORD, o.WORD)
    else:
        spans = o.plain("corpus", core)
    return (
        f"with corpus as materialized ({DICT_SQL}) select doc_id, cast(s as integer) as start,"
        f" cast(e as integer) as \"end\", m as original from ({spans})"
        f" where lower(m) in (select lower(t) from (select distinct {col} as t from {select}))"
    )


# Texts in which names stand alone, next to letters, next to each other and in capitals.
DICT_TEXT = (
    "concat('Brand#', k % 60, 'Brand#', (k * 7) % 60, ' (', s_name, ') ', upper(s_name), 'x ',"
    " s_name, '・', s_name, 'の')"
)
DICT_SQL = (
    f"select concat('o', k) as doc_id, {DICT_TEXT} as text from (select o_orderkey as k, s_name from orders"
    " join supplier on s_suppkey = o_orderkey % (select count(*) from supplier))"
    f" union all {fx.DOCUMENTS_SQL}"
)


def _dict_docs(spark, sf_dir):
    supplier = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    count = supplier.agg(F.count("*").alias("n")).scalar()
    lines = fx.texts(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % count).alias("s_suppkey")
    ).join(supplier, "s_suppkey")
    return lines.select(
        F.expr("concat('o', k)").alias("doc_id"), F.expr(DICT_TEXT).alias("text")
    ).unionByName(fx.documents(spark, sf_dir))


@query("det_dict_company", _dict_sql("supplier", "s_name", True))
def det_dict_company(spark, sf_dir):
    """All supplier names as company terms."""
    terms = company_terms(fx.table(spark, sf_dir, "supplier"), "s_name")
    return detect_term_table(_dict_docs(spark, sf_dir), terms).select(
        "doc_id", "start", "end", "original")


@query("det_dict_keyword", _dict_sql("part", "p_brand", False))
def det_dict_keyword(spark, sf_dir):
    """Brands as keywords."""
    terms = keyword_terms(fx.table(spark, sf_dir, "part"), "p_brand")
    return detect_term_table(_dict_docs(spark, sf_dir), terms).select(
        "doc_id", "start", "end", "original")


# --- predicates -------------------------------------------------------------------------

RAW_SPANS = (
    "select l_orderkey as doc_id, l_linenumber as seq,"
    " case l_partkey % 7 when 0 then 'x' when 1 then null else cast(l_partkey % 30 - 5 as string) end as start,"
    " cast(l_suppkey % 30 as string) as stop,"
    " case l_partkey % 3 when 0 then 'PERSON' end as entity,"
    " case l_partkey % 4 when 0 then 'forced:ui_override' end as reason from lineitem"
)


def raw_spans(spark, sf_dir):
    return fx.table(spark, sf_dir, "lineitem").selectExpr(
        *[
            "l_orderkey as doc_id", "l_linenumber as seq",
            "case l_partkey % 7 when 0 then 'x' when 1 then null else cast(l_partkey % 30 - 5 as string) end as start",
            "cast(l_suppkey % 30 as string) as end",
            "case l_partkey % 3 when 0 then 'PERSON' end as entity",
            "case l_partkey % 4 when 0 then 'forced:ui_override' end as reason",
        ]
    )


_VALID = (
    f"(select *, try_cast(start as integer) as s, try_cast(stop as integer) as e from ({RAW_SPANS}))"
    " where s >= 0 and s < e"
)


@query(
    "forced_normalize",
    "select doc_id, s as start, e as \"end\", coalesce(entity, 'CUSTOM') as entity, cast(null as varchar) as label,"
    f" coalesce(reason, 'forced:mask_once') as reason from {_VALID}",
)
def forced_normalize(spark, sf_dir):
    return normalize_forced(raw_spans(spark, sf_dir))


@query("keep_normalize", f'select doc_id, s as start, e as "end" from {_VALID}')
def keep_normalize(spark, sf_dir):
    return normalize_keep(raw_spans(spark, sf_dir))


ALLOWED = "concat(p_name, case when p_size > 25 then '' else '!' end)"
ALLOW_TERM = case("p_partkey", ("p_name", "concat(' ', replace(p_name, ' ', '　'), ' ')", "replace(p_name, ' ', '  ')", "''", "concat(p_name, 'x')"))


@query(
    "allow_match",
    f"select p_partkey, t <> '' and t in (select {o.norm(ALLOWED)} from part) as allowed"
    f" from (select p_partkey, {o.norm(ALLOW_TERM)} as t from part)",
)
def allow_match(spark, sf_dir):
    """Terms against an allow table by normal form: a join, for lists of any size."""
    p = part(spark, sf_dir)
    allow = (
        p.select(F.expr(ALLOWED).alias("a")).distinct()
        .select(tx.norm_term(F.col("a")).alias("t")).distinct().withColumn("ok", F.lit(True))
    )
    terms = p.select("p_partkey", tx.norm_term(F.expr(ALLOW_TERM)).alias("t"))
    return terms.join(allow, "t", "left").select(
        "p_partkey", (F.coalesce("ok", F.lit(False)) & (F.col("t") != "")).alias("allowed")
    )


@query(
    "money_context",
    f"with corpus as materialized ({fx.MIXED_SQL}) select x.doc_id, cast(s as integer) as start, {o.money_context('t.text', 's', 's + length(m)')} as has_context"
    f" from ({o.matches('corpus', '[0-9]+')}) x join corpus t on t.doc_id = x.doc_id",
)
def money_context(spark, sf_dir):
    """Every run of digits: does it stand near a money word?"""
    from kuronuri.functions.regex import match_spans

    docs = fx.mixed(spark, sf_dir).select(
        "doc_id", tx.blocks(F.col("text")).alias("pieces"), F.length("text").alias("n"),
        F.explode(match_spans(F.col("text"), "[0-9]+")).alias("m"),
    )
    ctx = tx.money_context(F.col("pieces"), F.col("n"), F.col("m.s"), F.col("m.e"))
    return docs.select("doc_id", F.col("m.s").alias("start"), ctx.alias("has_context"))


_BODY = "[^ \\t\\r\\n、。,.，．:：;；()（）\\[\\]［］{}｛｝<>＜＞《》【】「」『』\"''“”‘’・/\\\\|?!？!]{0,80}"
_CORPS = "株式会社|有限会社|合同会社|合名会社|合資会社|\\(株\\)|（株）"


@query(
    "company_expand",
    f"with corpus as materialized ({fx.MIXED_SQL}) select x.doc_id, cast(s as integer) as start,"
    f" cast(s + length(m) + length(regexp_extract(substr(t.text, s + length(m) + 1), '^[ \\t\\r\\n]*{_BODY}')) as integer) as \"end\""
    f" from ({o.matches('corpus', _CORPS)}) x join corpus t on t.doc_id = x.doc_id",
)
def company_expand(spark, sf_dir):
    """Spans that hold only a designator grow over the name on their right."""
    from kuronuri.functions.regex import match_spans

    docs = fx.mixed(spark, sf_dir).select(
        "doc_id", tx.blocks(F.col("text")).alias("pieces"), F.length("text").alias("n"),
        F.explode(match_spans(F.col("text"), _CORPS)).alias("m"),
    )
    end = company_expand_end(F.col("pieces"), F.col("n"), F.col("m.m"), F.col("m.e"))
    return docs.select("doc_id", F.col("m.s").alias("start"), end.cast("int").alias("end"))


@query(
    "win_context",
    f"with corpus as materialized ({fx.MIXED_SQL}) select x.doc_id, cast(s as integer) as start,"
    " replace(substr(t.text, greatest(s - 24, 0) + 1, s + length(m) + 24 - greatest(s - 24, 0)), chr(10), ' ') as preview"
    f" from ({o.matches('corpus', '[0-9]+')}) x join corpus t on t.doc_id = x.doc_id",
)
def win_context(spark, sf_dir):
    from kuronuri.functions.regex import match_spans

    docs = fx.mixed(spark, sf_dir).select(
        "doc_id", tx.blocks(F.col("text")).alias("pieces"), F.length("text").alias("n"),
        F.explode(match_spans(F.col("text"), "[0-9]+")).alias("m"),
    )
    preview = tx.context_preview(F.col("pieces"), F.col("n"), F.col("m.s"), F.col("m.e"))
    return docs.select("doc_id", F.col("m.s").alias("start"), preview.alias("preview"))
