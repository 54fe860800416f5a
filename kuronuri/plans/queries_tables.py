"""Registered queries on tables of spans, hits, segments and positioned characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.functions.regex import java_regex, match_spans
from kuronuri.operators import layout, report, review, segments
from kuronuri.operators.detect import detect_fast, pattern_spans
from kuronuri.operators.overrides import keep_anti
from kuronuri.operators.resolve import resolve_chains, resolve_islands
from kuronuri.plans import fixtures as fx
from kuronuri.plans import oracle as o
from kuronuri.plans.catalog import query
from kuronuri.plans.masking import mask
from kuronuri.policy import Policy
from kuronuri.sources import runs, sinks
from kuronuri.sources.folders import run_folder
from kuronuri.sources.texts import payload_spans, read_payloads

# --- spans laid out over the orders: one document per customer -----------------------------

ENTITIES = ("PERSON", "COMPANY", "ID", "DATE", "CUSTOM", "PARTIES", "")
_ENTITY = "case o_orderkey % 7 " + " ".join(
    f"when {i} then '{e}'" for i, e in enumerate(ENTITIES)
) + " end"
SPAN_COLUMNS = {
    "doc_id": "o_custkey",
    "seq": "o_orderkey",
    "start": "cast((o_orderkey * 37) % 400 as int)",
    "stop": "cast((o_orderkey * 37) % 400 + 1 + o_orderkey % 23 as int)",
    "entity": _ENTITY,
    "score": "cast((o_orderkey % 11) / 10.0 as double)",
    "forced": "o_orderkey % 13 = 0",
    "original": "concat('T', o_orderkey % 40)",
    "span_id": "concat('span_', o_orderkey)",
}
SPANS_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in SPAN_COLUMNS.items()) + " from orders"


def spans(spark, sf_dir):
    cols = [F.expr(e).alias(n) for n, e in SPAN_COLUMNS.items()]
    return (
        fx.table(spark, sf_dir, "orders").select(*cols)
        .withColumn("source", F.when(F.col("forced"), "forced").otherwise("analyzer"))
        .withColumnRenamed("stop", "end").drop("forced")
    )


def candidates(spark, sf_dir):
    return spans(spark, sf_dir).withColumn("ord", F.col("seq").cast("int"))


_CANDS = (
    "cands as (select doc_id, start as s, stop as e, entity, score, seq as ord, seq, forced,"
    f" original from ({SPANS_SQL}))"
)
_KEPT = 'doc_id, cast(s as integer) as start, cast(e as integer) as "end", entity, score, cast(ord as integer) as ord'


def _kept(df):
    return df.select("doc_id", "start", "end", "entity", "score", "ord")


@query("resolve_final", f"with recursive {_CANDS}, {o.resolve('cands', 'kept', o.final_order())} select {_KEPT} from kept")
def resolve_final_(spark, sf_dir):
    return _kept(resolve_chains(candidates(spark, sf_dir)))


_PLAIN = "plain as (select * replace (false as forced) from cands)"


@query("resolve_first", f"with recursive {_CANDS}, {_PLAIN}, {o.resolve('plain', 'kept', 's - e, ord')} select {_KEPT} from kept")
def resolve_first_(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("source", F.lit("analyzer"))
    return _kept(resolve_chains(c))


@query("resolve_islands", f"with recursive {_CANDS}, {o.resolve('cands', 'kept', o.final_order())} select {_KEPT} from kept")
def resolve_islands_(spark, sf_dir):
    return _kept(resolve_islands(candidates(spark, sf_dir), width=64))


KEEP_SQL = "select o_custkey as doc_id, cast((o_orderkey * 91) % 400 as int) as s, cast((o_orderkey * 91) % 400 + o_orderkey % 5 as int) as e from orders"


@query(
    "join_keep_anti",
    f"select doc_id, span_id, start, stop as \"end\" from ({SPANS_SQL}) a where not exists (select 1 from ({KEEP_SQL}) k"
    " where k.s < k.e and k.doc_id = a.doc_id and a.start < k.e and a.stop > k.s)",
)
def join_keep_anti(spark, sf_dir):
    keep = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as doc_id", "cast((o_orderkey * 91) % 400 as int) as start",
        "cast((o_orderkey * 91) % 400 + o_orderkey % 5 as int) as end",
    )
    s = spans(spark, sf_dir).select("doc_id", "span_id", "start", "end")
    return keep_anti(s, keep)


@query(
    "win_span_ids",
    "select doc_id, seq, concat('span_', lpad(cast(n as varchar), 6, '0')) as span_no,"
    " concat('m', lpad(cast(n as varchar), 6, '0')) as mark_no from (select doc_id, seq,"
    f" row_number() over (partition by doc_id order by start, stop, seq) as n from ({SPANS_SQL}))",
)
def win_span_ids(spark, sf_dir):
    from kuronuri.operators.ordinals import row_number_in

    s = row_number_in(spans(spark, sf_dir), ["doc_id"], "start", "n", 64, ["end", "seq"])
    return s.select("doc_id", "seq", F.format_string("span_%06d", "n").alias("span_no"),
                    F.format_string("m%06d", "n").alias("mark_no"))


@query(
    "win_stable_id",
    "with f as (select doc_id, entity, original, min(start) as first from ({0}) group by all),"
    " k as (select *, row_number() over (partition by doc_id, entity order by first, original) as n from f)"
    " select s.doc_id, seq, {1} as label from ({0}) s join k on k.doc_id = s.doc_id and k.entity = s.entity"
    " and k.original = s.original".format(SPANS_SQL, o.label_sql("s.entity", "n")),
)
def win_stable_id(spark, sf_dir):
    h = spans(spark, sf_dir).withColumnRenamed("original", "norm")
    return report.stable_ids(h).select("doc_id", "seq", "label")


@query(
    "agg_by_entity",
    f"select doc_id, coalesce(nullif(entity, ''), 'UNKNOWN') as entity_type, cast(count(*) as bigint) as n from ({SPANS_SQL}) group by all",
)
def agg_by_entity(spark, sf_dir):
    h = spans(spark, sf_dir).withColumnRenamed("entity", "entity_type")
    m = report.by_entity_map(h)
    return m.select("doc_id", F.explode("by_entity").alias("entity_type", "n"))


@query("sort_candidates", f"select doc_id, seq, cast(row_number() over (partition by doc_id order by start, start - stop, seq) as integer) as place from ({SPANS_SQL})")
def sort_candidates(spark, sf_dir):
    from kuronuri.operators.ordinals import row_number_in

    s = spans(spark, sf_dir).withColumn("neg", F.col("start") - F.col("end"))
    return row_number_in(s, ["doc_id"], "start", "place", 64, ["neg", "seq"]).select("doc_id", "seq", "place")


@query("sort_detections", f"select doc_id, span_id, cast(row_number() over (partition by doc_id order by start, -stop, span_id) as integer) as id from ({SPANS_SQL})")
def sort_detections(spark, sf_dir):
    return review.number_detections(spans(spark, sf_dir), after_manual_add=True).select("doc_id", "span_id", "id")


@query(
    "union_candidates",
    o.with_corpus(
        f'select doc_id, cast(s as integer) as start, cast(e as integer) as "end", entity from ({o.detections(keys=("det_email", "det_postal"))})'
        " union all select doc_id, 0, 4, 'CUSTOM' from corpus", fx.MIXED_SQL),
)
def union_candidates(spark, sf_dir):
    """Analyzer and forced spans in one bag."""
    from kuronuri.functions.spans import candidate

    pats = [vocab.PATTERNS[k] for k in ("det_email", "det_postal")]
    forced = F.array(candidate(0, 4, "CUSTOM", 1.0, source="forced"))
    both = F.concat(pattern_spans(F.col("text"), pats), forced)
    return (
        fx.mixed(spark, sf_dir).select("doc_id", F.explode(both).alias("c"))
        .select("doc_id", "c.start", "c.end", "c.entity")
    )


# --- the review loop ------------------------------------------------------------------------

_DETS = f"""(select *, seq % 3 <> 0 as enabled, case when seq % 5 = 0 then concat('<', original, '>') when seq % 5 = 1 then '' end as mask_override,
 seq % 4 = 0 as is_review, case when forced then 'forced:x' else 'mask:stable_id' end as reason from ({SPANS_SQL}))"""


def dets(spark, sf_dir):
    return (
        spans(spark, sf_dir).withColumnRenamed("entity", "entity_type")
        .withColumns(
            {
                "enabled": F.expr("seq % 3 <> 0"),
                "mask_override": F.expr("case when seq % 5 = 0 then concat('<', original, '>') when seq % 5 = 1 then '' end"),
                "is_review": F.expr("seq % 4 = 0"),
                "reason": F.expr("case when source = 'forced' then 'forced:x' else 'mask:stable_id' end"),
            }
        )
    )


@query("filter_detections", f"select doc_id, span_id from {_DETS} where is_review and (contains(lower(entity), 't1') or contains(lower(original), 't1') or contains(lower(reason), 't1'))")
def filter_detections(spark, sf_dir):
    return review.filter_detections(dets(spark, sf_dir), " T1 ", review_only=True).select("doc_id", "span_id")


@query(
    "collect_overrides",
    f"select doc_id, start, stop as \"end\", cast(null as varchar) as label, 'keep' as reason from {_DETS} where not enabled"
    " union all select doc_id, start, stop, mask_override, case when coalesce(mask_override, '') <> '' then 'forced:ui_override' else 'forced:manual_add' end"
    f" from {_DETS} where enabled and (forced or coalesce(mask_override, '') <> '')",
)
def collect_overrides(spark, sf_dir):
    d = dets(spark, sf_dir)
    keep = review.keep_spans(d).select("doc_id", "start", "end", F.lit(None).cast("string").alias("label"), F.lit("keep").alias("reason"))
    return keep.unionByName(review.forced_masks(d).drop("entity"))


@query(
    "text_replace_reviewed",
    f"select doc_id, span_id, coalesce(nullif(mask_override, ''), concat('[', entity, ']')) as label,"
    f" repeat('■', greatest(3, length(original))) as bar from {_DETS}",
)
def text_replace_reviewed(spark, sf_dir):
    def r(blackout):
        return review.reviewed_replacement(F.col("entity_type"), F.col("original"), F.col("mask_override"), blackout)

    return dets(spark, sf_dir).select("doc_id", "span_id", r(False).alias("label"), r(True).alias("bar"))


OPS = ("ALWAYS_KEEP", "ALWAYS_MASK_AS_COMPANY", "KEEP_ONCE", "MASK_ONCE", "EDIT", "ALWAYS_KEEP")
_OP = "case o_orderkey % 6 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(OPS)) + " end"
# Every order acts on its own span, on the one of the order before, or on none.
_TARGET = "case o_orderkey % 4 when 3 then concat('none_', o_orderkey) when 2 then concat('span_', o_orderkey) else concat('span_', o_orderkey - o_orderkey % 4) end"
ACTIONS_SQL = (
    f"select s.doc_id, seq, span_id, op from (select o_orderkey as seq, {_TARGET} as span_id, {_OP} as op from orders) a"
    f" join (select doc_id, span_id from ({SPANS_SQL})) s using (span_id)"
)


def actions(spark, sf_dir):
    a = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("seq"), F.expr(_TARGET).alias("span_id"), F.expr(_OP).alias("op")
    )
    return a.join(spans(spark, sf_dir).select("doc_id", "span_id"), "span_id")


_JOINED = f"(select a.doc_id, seq, span_id, op, original from ({ACTIONS_SQL}) a join (select doc_id, span_id, original from ({SPANS_SQL})) s using (doc_id, span_id))"


def joined(spark, sf_dir):
    raw = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"),
        F.expr("case o_orderkey % 4 when 3 then 'none' else concat('span_', o_orderkey) end").alias("span_id"),
        F.expr(_OP).alias("op"),
    )
    return review.join_actions(raw, spans(spark, sf_dir))


_RAW_JOINED = f"(select o_custkey as doc_id, o_orderkey as seq, concat('span_', o_orderkey) as span_id, {_OP} as op, concat('T', o_orderkey % 40) as original from orders where o_orderkey % 4 <> 3)"


@query("join_action_span", f"select doc_id, seq, span_id, op, original from {_RAW_JOINED}")
def join_action_span(spark, sf_dir):
    return joined(spark, sf_dir).select("doc_id", "seq", "span_id", "op", "original")


_HAVE = "(select distinct concat('T', p_size * 3) as term from part)"


def have_terms(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").selectExpr("concat('T', p_size * 3) as term").distinct()


@query("apply_always_keep", f"select term from {_HAVE} union select original from {_RAW_JOINED} where op = 'ALWAYS_KEEP'")
def apply_always_keep(spark, sf_dir):
    return review.extend_allowlist(joined(spark, sf_dir), have_terms(spark, sf_dir))


@query("apply_always_company", f"select term from {_HAVE} union select original from {_RAW_JOINED} where op = 'ALWAYS_MASK_AS_COMPANY'")
def apply_always_company(spark, sf_dir):
    return review.extend_companies(joined(spark, sf_dir), have_terms(spark, sf_dir))


@query(
    "apply_skipped",
    f"select doc_id, seq, op, original as term, op not in ('ALWAYS_KEEP', 'ALWAYS_MASK_AS_COMPANY') as skipped from {_RAW_JOINED} j"
    f" where op <> 'ALWAYS_KEEP' or (original not in (select term from {_HAVE}) and not exists (select 1 from {_RAW_JOINED} k"
    " where k.op = 'ALWAYS_KEEP' and k.original = j.original and (k.doc_id, k.seq) < (j.doc_id, j.seq)))",
)
def apply_skipped(spark, sf_dir):
    """The log of all actions, with those that did nothing marked."""
    return review.applied_log(joined(spark, sf_dir), have_terms(spark, sf_dir))


_ONCE = (
    f"with a as (select doc_id, span_id, arg_max(op, seq) as last, bool_or(op = 'MASK_ONCE') as f from ({ACTIONS_SQL})"
    " where op in ('KEEP_ONCE', 'MASK_ONCE') group by doc_id, span_id)"
    " select d.doc_id, d.span_id, coalesce(last = 'MASK_ONCE', enabled) as enabled,"
    f" case when f or forced then 'forced' else 'analyzer' end as source from {_DETS} d left join a using (doc_id, span_id)"
)


@query("apply_once", _ONCE)
def apply_once(spark, sf_dir):
    out = review.apply_once(dets(spark, sf_dir), actions(spark, sf_dir))
    return out.select("doc_id", "span_id", "enabled", "source")


@query("stream_review", _ONCE)
def stream_review(spark, sf_dir):
    """The same clicks as a stream of files, some of them repeated, in the order in which files come."""
    from kuronuri.streaming.review_stream import action_stream, read_clicks, write_clicks

    out = run_folder(spark, "clicks")
    a = actions(spark, sf_dir).select("doc_id", "span_id", "seq", "op")
    # Dealt by the click, so that clicks on one span come in several files.
    a.unionByName(a.where("seq % 5 = 0")).repartition(4, "seq").write.parquet(f"{out}/actions")
    keys = "doc_id bigint, span_id string"
    clicks = action_stream(spark, f"{out}/actions", f"{keys}, seq bigint, op string", max_files=2)
    write_clicks(clicks, f"{out}/state", f"{out}/checkpoint").awaitTermination()
    decided = review.apply_clicks(dets(spark, sf_dir), read_clicks(spark, f"{out}/state", keys))
    return decided.select("doc_id", "span_id", "enabled", "source")


@query(
    "join_review_span",
    "with r as (select *, row_number() over (partition by doc_id order by start, seq) as j from"
    f" (select * from {_DETS} where score < 0.8 and score <> 0)),"
    f" f as (select doc_id, start, stop, entity, min(span_id) as span_id from {_DETS} where enabled group by all)"
    " select r.doc_id, concat('rev_', lpad(cast(j as varchar), 6, '0')) as id, f.span_id from r join f"
    " on f.doc_id = r.doc_id and f.start = r.start and f.stop = r.stop and f.entity = r.entity",
)
def join_review_span(spark, sf_dir):
    """Review rows against the enabled spans; numbers were given before the join."""
    from kuronuri.operators.ordinals import row_number_in

    d = dets(spark, sf_dir).withColumns({"mark_id": F.col("span_id"), "replacement": F.lit("")})
    r = row_number_in(d.where("score < 0.8 and score <> 0"), ["doc_id"], "start", "review_no", 64, ["seq"])
    return review_spans(d.where("enabled"), r).select("doc_id", "id", "span_id")


review_spans = report.review_spans

_REVIEWED = f"(select concat('c', doc_id) as doc_id, start, stop, span_id, entity, original, mask_override from {_DETS} where enabled)"


@query(
    "splice_reviewed",
    f"""with recursive corpus as ({fx.CONTRACTS_SQL}),
 e as (select *, row_number() over (partition by doc_id order by start, span_id) as rn,
  coalesce(nullif(mask_override, ''), concat('[', entity, ']')) as repl from {_REVIEWED}),
 w as (select doc_id, rn, true as used, start, stop, 0 as last, repl, stop as pos from e where rn = 1
  union all select e.doc_id, e.rn, e.start >= w.pos, e.start, e.stop, w.pos, e.repl, case when e.start >= w.pos then e.stop else w.pos end
  from w join e on e.doc_id = w.doc_id and e.rn = w.rn + 1)
 select t.doc_id, concat(coalesce(string_agg(concat(substr(text, last + 1, start - last), repl), '' order by start), ''),
  substr(any_value(text), coalesce(max(stop), 0) + 1)) as masked from corpus t left join (select * from w where used) w on w.doc_id = t.doc_id group by t.doc_id""",
)
def splice_reviewed(spark, sf_dir):
    d = dets(spark, sf_dir).withColumn("doc_id", F.expr("concat('c', doc_id)"))
    return review.mask_reviewed(fx.contracts(spark, sf_dir), d)


# Hand-made selections on the contracts: right, too long, moved, far off and lost.
_MANUAL = {
    "doc_id": "concat('c', c_custkey)",
    "kind": "cast(c_custkey % 6 as int)",
    "start": "cast(case c_custkey % 6 when 0 then 4 when 1 then 4 when 2 then 60 when 3 then 300 else 4 end as int)",
    "stop": "cast(case c_custkey % 6 when 0 then 8 when 1 then 30 when 2 then 64 when 3 then 304 when 5 then 4 else 9 end as int)",
    "sel": "case c_custkey % 6 when 0 then 'Supp' when 1 then 'Supp' when 2 then '契約日 ' when 3 then 'Supp' when 4 then 'nowhere' else 'x' end",
    "entity": "case c_custkey % 2 when 0 then 'company' else 'PERSON' end",
}
_MANUAL_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in _MANUAL.items()) + " from customer"
_LOCATED = f"""located as (select m.doc_id, entity, text,
 case when kind in (2, 3) then instr(text, sel) - 1 else start end as s,
 case kind when 1 then start + length(sel) when 2 then instr(text, sel) - 1 + length(sel) when 3 then instr(text, sel) - 1 + length(sel) else stop end as e
 from (select * from ({_MANUAL_SQL}) where stop > start) m join ({fx.CONTRACTS_SQL}) t on t.doc_id = m.doc_id)"""


def manual(spark, sf_dir):
    m = fx.table(spark, sf_dir, "customer").select(*[F.expr(e).alias(n) for n, e in _MANUAL.items()])
    return m.withColumnRenamed("stop", "end")


@query("forced_relocate", f'with {_LOCATED} select doc_id, cast(s as integer) as start, cast(e as integer) as "end" from located')
def forced_relocate(spark, sf_dir):
    return review.relocate(manual(spark, sf_dir), fx.contracts(spark, sf_dir)).select(
        "doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")
    )


def _ends(side, words, expr):
    return "case " + " ".join(f"when {expr.format(n=len(w))} = '{w}' then {side.format(n=len(w))}" for w in words)


_EXPAND = (
    "case when upper(entity) = 'COMPANY' then "
    + _ends("s - {n}", vocab.MANUAL_LEFT, "substr(text, greatest(s - {n}, 0) + 1, s - greatest(s - {n}, 0))")
    + " else s end else s end as s2, case when upper(entity) = 'COMPANY' then "
    + _ends("e + {n}", vocab.MANUAL_RIGHT, "substr(text, e + 1, {n})") + " else e end else e end as e2"
)


@query("forced_company_expand", f'with {_LOCATED} select doc_id, cast(s2 as integer) as start, cast(e2 as integer) as "end" from (select *, {_EXPAND} from located)')
def forced_company_expand(spark, sf_dir):
    found = review.relocate(manual(spark, sf_dir), fx.contracts(spark, sf_dir))
    return review.expand_manual_company(found).select(
        "doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")
    )


@query(
    "forced_dedupe",
    f"with d as (select doc_id, entity, start, stop, span_id, enabled, forced from {_DETS}),"
    " m as (select distinct doc_id, upper(entity) as entity, start + start % 2 as start, stop + start % 2 as stop from d)"
    " select d.doc_id, d.span_id, enabled or (forced and m.doc_id is not null) as enabled from d left join m"
    " on m.doc_id = d.doc_id and m.entity = upper(d.entity) and m.start = d.start and m.stop = d.stop"
    " union all select doc_id, concat('manual_', start, '_', stop), true from m where not exists (select 1 from d"
    " where d.forced and d.doc_id = m.doc_id and upper(d.entity) = m.entity and d.start = m.start and d.stop = m.stop)",
)
def forced_dedupe(spark, sf_dir):
    """Manual spans that repeat known ones: forced ones are enabled, others are added."""
    d = dets(spark, sf_dir)
    odd = F.col("start") % 2
    again = d.select(
        "doc_id", F.col("entity_type").alias("entity"), (F.col("start") + odd).alias("start"),
        (F.col("end") + odd).alias("end"), F.lit("").alias("text"),
    )
    return review.add_manual(d, again).select("doc_id", "span_id", "enabled")


# --- segments: conversations as documents, turns as segments --------------------------------

_SEG_SQL = """segs as materialized (select conv_id as doc_id, turn as seg_no, case turn % 4 when 0 then 'H' when 1 then 'P' when 2 then 'P' else 'C' end as kind, text,
 cast(coalesce(sum(length(text) + 1) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint) as g_start from conversations),
corpus as materialized (select conv_id as doc_id, string_agg(concat(text, chr(10)), '' order by turn) as text from conversations group by conv_id)"""
_STOP_RX = rf"[{o.WORD}]+\.{o.S}[{o.WORD}]+"
STOP = r"\w+\.\s\w+"
_HITS_SQL = f"""hits as materialized (select doc_id, cast(i as integer) as hit_no, s as start, s + length(m) as stop, m as original,
 case when i % 7 = 0 then 'keep:allowlist' else 'mask:stable_id' end as reason, case when i % 2 = 0 then '■■■' else concat('[X', i, ']') end as replacement from ({o.matches('corpus', _STOP_RX)}))"""
_PAIR_SQL = """pairs as (select h.doc_id, hit_no, seg_no, greatest(start, g_start) - g_start as local_start, least(stop, g_start + length(text)) - g_start as local_end,
 not (start >= g_start and stop <= g_start + length(text)) as overlap, replacement, reason from hits h join segs s on s.doc_id = h.doc_id and g_start < stop and g_start + length(text) > start)"""
_SEG_CTE = f"with {_SEG_SQL}, {_HITS_SQL}, {_PAIR_SQL}"


def seg_table(spark, sf_dir):
    c = fx.texts(spark, sf_dir, "conversations")
    kind = F.expr("case turn % 4 when 0 then 'H' when 1 then 'P' when 2 then 'P' else 'C' end")
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seg_no"), kind.alias("kind"), "text")


def _stops(docs):
    """Every ``word. word`` of a text, within or across lines."""
    found = match_spans(F.col("text"), java_regex(STOP))
    return (
        docs.select("doc_id", F.posexplode(found).alias("i", "m"))
        .select(
            "doc_id", (F.col("i") + 1).alias("hit_no"), F.col("m.s").alias("start"), F.col("m.e").alias("end"),
            F.col("m.m").alias("original"),
            F.when((F.col("i") + 1) % 7 == 0, "keep:allowlist").otherwise("mask:stable_id").alias("reason"),
            F.when((F.col("i") + 1) % 2 == 0, "■■■").otherwise(F.concat(F.lit("[X"), F.col("i") + 1, F.lit("]"))).alias("replacement"),
        )
    )


def _seg_pairs(spark, sf_dir):
    seg = segments.segment_offsets(seg_table(spark, sf_dir), width=4)
    hits = _stops(segments.assemble(seg_table(spark, sf_dir), width=4))
    return seg, hits, segments.hit_segments(hits, seg)


@query(
    "win_segment_offsets",
    f"with {_SEG_SQL} select doc_id, concat(kind, lpad(cast(seg_no as varchar), 6, '0')) as seg_id, g_start, g_start + length(text) as g_end from segs",
)
def win_segment_offsets(spark, sf_dir):
    return segments.segment_offsets(seg_table(spark, sf_dir), width=4).select("doc_id", "seg_id", "g_start", "g_end")


@query("segment_text", f"with {_SEG_SQL} select doc_id, text from corpus")
def segment_text(spark, sf_dir):
    return segments.assemble(seg_table(spark, sf_dir), width=4)


@query("join_hit_segment", f"{_SEG_CTE} select doc_id, hit_no, seg_no, cast(local_start as integer) as local_start, cast(local_end as integer) as local_end, overlap from pairs")
def join_hit_segment(spark, sf_dir):
    return _seg_pairs(spark, sf_dir)[2].select("doc_id", "hit_no", "seg_no", "local_start", "local_end", "overlap")


@query(
    "segment_overlap_reason",
    f"{_SEG_CTE}, n as (select doc_id, hit_no, count(*) as n, bool_or(overlap) as o from pairs group by all)"
    " select h.doc_id, h.hit_no, case when starts_with(reason, 'keep') then reason when n is null then 'warning:segment_not_found'"
    " when n > 1 or o then 'warning:segment_overlap_applied' else reason end as reason from hits h left join n on n.doc_id = h.doc_id and n.hit_no = h.hit_no",
)
def segment_overlap_reason(spark, sf_dir):
    _, hits, pairs = _seg_pairs(spark, sf_dir)
    return segments.overlap_reasons(hits, pairs).select("doc_id", "hit_no", "reason")


@query("maskable_hits", f"{_SEG_CTE} select doc_id, hit_no from hits where not starts_with(reason, 'keep')")
def maskable_hits(spark, sf_dir):
    return segments.maskable(_stops(segments.assemble(seg_table(spark, sf_dir)))).select("doc_id", "hit_no")


@query(
    "splice_segment",
    f"""{_SEG_CTE}, p as (select *, case when replacement = '■■■' then repeat('■', local_end - local_start) else replacement end as out,
  coalesce(lag(local_end) over (partition by doc_id, seg_no order by local_start), 0) as last from pairs where not starts_with(reason, 'keep'))
 select s.doc_id, s.seg_no, concat(coalesce(string_agg(concat(substr(text, last + 1, local_start - last), out), '' order by local_start), ''),
  substr(any_value(text), coalesce(max(local_end), 0) + 1)) as masked from segs s left join p on p.doc_id = s.doc_id and p.seg_no = s.seg_no group by s.doc_id, s.seg_no""",
)
def splice_segment(spark, sf_dir):
    seg, _, pairs = _seg_pairs(spark, sf_dir)
    return segments.splice_segments(seg, segments.maskable(pairs)).select("doc_id", "seg_no", "masked")


# --- positioned characters: two runs per turn, three turns per page ---------------------------

_HALF = "length(text) // 2"
_RUN_SQL = f"""runs as materialized (select doc_id, run_no, page, line, text, x0, x0 + 10.0 * length(text) as x1, cast(12.0 * line + 1.5 * half as double) as y0, cast(12.0 * line + 1.5 * half + 10 as double) as y1,
 length(text) + case when half = 1 then 1 else 0 end + case when half = 1 and line = max(line) over (partition by doc_id, page) then 1 else 0 end as n
 from (select conv_id as doc_id, turn * 2 + h as run_no, cast(turn // 3 as integer) as page, turn as line, h as half,
  case h when 0 then substr(text, 1, {_HALF}) else substr(text, {_HALF} + 1) end as text, 5.0 + h as x0 from conversations, (values (0), (1)) v(h))),
placed as (select *, cast(coalesce(sum(n) over (partition by doc_id order by run_no rows between unbounded preceding and 1 preceding), 0) as bigint) as base from runs),
chars as materialized (select doc_id, page, line, base + i - 1 as pos, x0 + (i - 1) * ((x1 - x0) / greatest(length(text), 1)) as x0, x0 + i * ((x1 - x0) / greatest(length(text), 1)) as x1, y0, y1, ch
 from (select *, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as i from placed where length(text) > 0)),
corpus as materialized (select doc_id, string_agg(concat(text, repeat(chr(10), n - length(text))), '' order by run_no) as text from runs group by doc_id)"""
_COVER_SQL = f"""{_HITS_SQL}, covered as materialized (select h.doc_id, hit_no, c.* exclude (doc_id) from hits h join chars c on c.doc_id = h.doc_id and c.pos >= h.start and c.pos < h.stop where ch <> chr(10))"""
_RECT_SQL = "rects as (select doc_id, hit_no, page, line, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from covered group by doc_id, hit_no, page, line)"
_LAYOUT = f"with {_RUN_SQL}, {_COVER_SQL}, {_RECT_SQL}"


def run_table(spark, sf_dir):
    t, half = F.col("text"), F.floor(F.length("text") / 2).cast("int")
    c = fx.texts(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("h"))
    r = c.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") * 2 + F.col("h")).alias("run_no"),
        F.floor(F.col("turn") / 3).cast("int").alias("page"), F.col("turn").alias("line"), "h",
        F.when(F.col("h") == 0, t.substr(F.lit(1), half)).otherwise(t.substr(half + 1, F.length("text"))).alias("text"),
        (F.col("h") + 5.0).alias("x0"), (F.col("turn") * 12.0 + F.col("h") * 1.5).alias("y0"),
    )
    return r.withColumns({"x1": F.col("x0") + F.length("text") * 10.0, "y1": F.col("y0") + 10.0}).drop("h")


def _layout(spark, sf_dir):
    placed = layout.place_runs(run_table(spark, sf_dir), width=8)
    return placed, _stops(layout.placed_text(placed, width=8))


@query("win_char_positions", f"with {_RUN_SQL} select doc_id, cast(pos as integer) as pos, page, x0, y0, x1, y1, ch from chars where ch <> chr(10)")
def win_char_positions(spark, sf_dir):
    """Every drawn character; the text with its breaks is checked by ``chars_text``."""
    chars = layout.char_positions(run_table(spark, sf_dir), width=8)
    return chars.where(F.col("ch") != "\n").select("doc_id", "pos", "page", "x0", "y0", "x1", "y1", "ch")


@query("chars_text", f"with {_RUN_SQL} select doc_id, text from corpus")
def chars_text(spark, sf_dir):
    return layout.chars_text(layout.char_positions(run_table(spark, sf_dir), width=8))


@query("join_hit_chars", f"with {_RUN_SQL}, {_COVER_SQL} select doc_id, hit_no, cast(pos as integer) as pos, ch from covered")
def join_hit_chars(spark, sf_dir):
    placed, hits = _layout(spark, sf_dir)
    return layout.run_chars(hits, placed)


@query("agg_rect_box", f"{_LAYOUT} select doc_id, hit_no, page, x0, y0, x1, y1 from rects")
def agg_rect_box(spark, sf_dir):
    placed, hits = _layout(spark, sf_dir)
    rects = layout.hit_rects(layout.run_pieces(hits, placed))
    return rects.select("doc_id", "hit_no", "page", "x0", "y0", "x1", "y1")


@query("win_rect_runs", f"{_LAYOUT} select doc_id, hit_no, cast(row_number() over (partition by doc_id, hit_no order by line) as integer) as rect_no, page, x0 - 0.5 as x0, y0 - 0.5 as y0, x1 + 0.5 as x1, y1 + 0.5 as y1 from rects")
def win_rect_runs(spark, sf_dir):
    placed, hits = _layout(spark, sf_dir)
    return layout.padded(layout.hit_rects(layout.run_pieces(hits, placed)))


# A cap of one rectangle and only two thirds of the positions make every outcome occur.
_DECIDE = f"""{_LAYOUT}, page_text as (select conv_id as doc_id, turn as page, text from conversations),
 len as (select doc_id, 2 * length(text) // 3 as n_chars from corpus),
 nr as (select doc_id, hit_no, count(*) as n_rects from rects group by all),
 h as (select x.*, coalesce(n_rects, 0) > 0 and stop <= n_chars as coord, n_rects from hits x join len using (doc_id) left join nr using (doc_id, hit_no) where not starts_with(reason, 'keep')),
 f as (select h.doc_id, hit_no, coalesce(sum((length(text) - length(replace(text, original, ''))) // length(original)), 0) as n_found from h left join page_text p on p.doc_id = h.doc_id and contains(p.text, h.original) where not coord group by all),
 d as (select h.doc_id, h.hit_no, case when coord then n_rects else n_found end as n, case when (case when coord then n_rects else n_found end) > 1 then 'too_many' when coord then 'coord' when n_found = 0 then 'miss' else 'search' end as outcome
  from h left join f on f.doc_id = h.doc_id and f.hit_no = h.hit_no)"""


def _decided(spark, sf_dir):
    placed, hits = _layout(spark, sf_dir)
    pages = fx.texts(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    rects = layout.hit_rects(layout.run_pieces(hits, placed))
    lengths = layout.placed_lengths(placed).select(
        "doc_id", F.floor(F.col("n_chars") * 2 / 3).cast("int").alias("n_chars"))
    return layout.decide_redaction(hits, rects, pages, lengths, Policy(max_rects_per_term=1))


@query("agg_rect_cap", f"{_DECIDE} select doc_id, hit_no, outcome, case outcome when 'too_many' then 'warning:pdf_too_many_hits' when 'miss' then 'warning:pdf_search_failed' else 'mask:stable_id' end as reason from d")
def agg_rect_cap(spark, sf_dir):
    return _decided(spark, sf_dir).select("doc_id", "hit_no", "outcome", "reason")


@query(
    "agg_pdf_stats",
    f"{_DECIDE} select doc_id, cast(sum(case when outcome in ('coord', 'search') then n else 0 end) as bigint) as applied_rects,"
    + ", ".join(f"count(*) filter (where outcome = '{a}') as {b}" for a, b in (("coord", "coord_mapped"), ("search", "search_fallback"), ("miss", "search_misses"), ("too_many", "skipped_too_many")))
    + " from d group by doc_id",
)
def agg_pdf_stats(spark, sf_dir):
    return layout.redaction_stats(_decided(spark, sf_dir))


@query(
    "join_term_pages",
    f"{_LAYOUT} select h.doc_id, hit_no, cast(coalesce(sum((length(text) - length(replace(text, original, ''))) // length(original)), 0) as bigint) as n_found"
    " from hits h left join (select conv_id as doc_id, text from conversations) p on p.doc_id = h.doc_id and contains(p.text, h.original) group by all",
)
def join_term_pages(spark, sf_dir):
    _, hits = _layout(spark, sf_dir)
    pages = fx.texts(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return layout.search_pages(hits, pages)


# --- reports and sinks ---------------------------------------------------------------------

FAST = Policy(force_fast=True)


def _fast(spark, sf_dir):
    return mask(fx.mixed(spark, sf_dir), FAST)


def _chain(select: str) -> str:
    return o.chain(select, tier="fast")


@query("agg_summary", _chain(f"select t.doc_id, cast(count(h.s) as integer) as total_hits, cast(count(h.s) filter (where {o.REVIEW}) as integer) as review_hits from corpus t left join hits h on h.doc_id = t.doc_id group by t.doc_id"))
def agg_summary(spark, sf_dir):
    return report.summary(_fast(spark, sf_dir)).select("doc_id", "total_hits", "review_hits")


_NAMES = "(select string_agg(name, '|') from {0}_names n where n.doc_id = t.doc_id)"


@query(
    "agg_report",
    _chain(
        f"select t.doc_id, coalesce({_NAMES.format('self')}, '') as self_names, coalesce({_NAMES.format('counter')}, '') as counter_names,"
        f" cast(count(h.s) as integer) as total_hits, cast(count(h.s) filter (where {o.REVIEW}) as integer) as review_hits, cast(0.8 as double) as review_threshold,"
        " coalesce((select string_agg(concat(entity, '=', n), '|' order by entity) from (select doc_id, entity, count(*) as n from hits group by all) e where e.doc_id = t.doc_id), '') as by_entity"
        " from corpus t left join hits h on h.doc_id = t.doc_id group by t.doc_id"
    ),
)
def agg_report(spark, sf_dir):
    """The nested report of every document, its parts laid out as columns."""
    r = report.runtime_report(_fast(spark, sf_dir), FAST)
    counts = F.transform(
        F.array_sort(F.map_entries("summary.by_entity")), lambda e: F.concat_ws("=", e.key, e.value)
    )
    return r.select(
        "doc_id", F.array_join("party_auto.self_names", "|").alias("self_names"),
        F.array_join("party_auto.counter_names", "|").alias("counter_names"),
        F.size("hits").alias("total_hits"), F.size("review").alias("review_hits"),
        "review_threshold", F.array_join(counts, "|").alias("by_entity"),
    )


@query("sink_masked", _chain("select doc_id, masked from spliced"))
def sink_masked(spark, sf_dir):
    path = run_folder(spark, "masked")
    sinks.write_masked(_fast(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("sink_hits_csv", _chain('select entity as entity_type, cast(s as integer) as start, cast(e as integer) as "end", m as original, repl as replacement, score, reason, source from hits'))
def sink_hits_csv(spark, sf_dir):
    path = run_folder(spark, "hits")
    sinks.write_hits_csv(_fast(spark, sf_dir), path)
    return sinks.read_hits_csv(spark, path)


@query(
    "sink_payload_json",
    _chain(
        "select t.doc_id, cast((select count(*) from hits h where h.doc_id = t.doc_id) as integer) as n_spans, coalesce(items, '') as items from corpus t left join"
        " (select doc_id, string_agg(concat('rev_', lpad(cast(j as varchar), 6, '0'), ':m', lpad(cast(n as varchar), 6, '0'), ':', preview), '|' order by j) as items from"
        f" (select *, row_number() over (partition by doc_id order by s) as j from (select h.*, row_number() over (partition by h.doc_id order by s) as n,"
        " replace(substr(text, greatest(s - 24, 0) + 1, e + 24 - greatest(s - 24, 0)), chr(10), ' ') as preview from hits h join corpus c on c.doc_id = h.doc_id)"
        f" where {o.REVIEW}) group by doc_id) r on r.doc_id = t.doc_id"
    ),
)
def sink_payload_json(spark, sf_dir):
    """The payload of every document as JSON: span count, and review items with their context."""
    items = F.transform("review_items", lambda r: F.concat_ws(":", r.id, r.mark_id, r.context_preview))
    return _payloads(spark, sf_dir).select(
        "doc_id", F.size("spans").alias("n_spans"), F.array_join(items, "|").alias("items")
    )


def _payloads(spark, sf_dir):
    """Payload files, written and read."""
    path = run_folder(spark, "payloads")
    sinks.write_payloads(_fast(spark, sf_dir), path, FAST)
    return read_payloads(spark, path)


@query("src_payload", _chain('select doc_id, concat(\'span_\', lpad(cast(row_number() over (partition by doc_id order by s) as varchar), 6, \'0\')) as span_id, entity as entity_type, cast(s as integer) as start, cast(e as integer) as "end", repl as replacement from hits'))
def src_payload(spark, sf_dir):
    """Payloads written as JSON and read back give the spans again."""
    return payload_spans(_payloads(spark, sf_dir)).select("doc_id", "span_id", "entity_type", "start", "end", "replacement")


@query("sink_audit", _chain(f"select 'process_file' as action, t.doc_id, cast(count(h.s) as integer) as total_hits, cast(count(h.s) filter (where {o.REVIEW}) as integer) as review_hits from corpus t left join hits h on h.doc_id = t.doc_id group by t.doc_id"))
def sink_audit(spark, sf_dir):
    """Audit lines of a run: committed once, read back."""
    path = run_folder(spark, "audit")
    runs.write_run(_fast(spark, sf_dir), path, "run-1", ["audit"])
    return runs.read_run(spark, path, "audit").select("action", "doc_id", "total_hits", "review_hits")


def _esc(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{a}', '{b}')"
    return f"replace({x}, chr(10), '<br>')"


@query(
    "sink_marked_html",
    _chain(
        f"select p.doc_id, left_html, {_esc('masked')} as right_html from spliced p join (select t.doc_id,"
        f" concat(coalesce(string_agg(concat({_esc('substr(text, last + 1, s - last)')}, '<mark id=\"m', lpad(cast(n as varchar), 6, '0'), '\" class=\"mk\">', {_esc('substr(text, s + 1, e - s)')}, '</mark>'), '' order by s) filter (where s is not null), ''),"
        f" {_esc('case when max(e) is null then any_value(text) else substr(any_value(text), cast(max(e) as bigint) + 1) end')}) as left_html"
        " from corpus t left join (select *, row_number() over (partition by doc_id order by s) as n, coalesce(lag(e) over (partition by doc_id order by s), 0) as last from hits) h on h.doc_id = t.doc_id group by t.doc_id) q on q.doc_id = p.doc_id"
    ),
)
def sink_marked_html(spark, sf_dir):
    path = run_folder(spark, "html")
    sinks.write_html(_fast(spark, sf_dir), path)
    return spark.read.parquet(path).drop("warn")


# --- streaming and extensions -----------------------------------------------------------------


@query("stream_mask", o.chain("select cast(substr(doc_id, 2) as bigint) as doc_id, masked from spliced", tier="fast", src=fx.DOCUMENTS_SQL))
def stream_mask(spark, sf_dir):
    """Documents as a file stream, masked batch by batch."""
    from kuronuri.streaming.mask_stream import (
        document_stream,
        mask_stream,
        read_masked,
        write_stream,
    )

    out = run_folder(spark, "stream")
    docs = document_stream(spark, f"{sf_dir}/documents.parquet")
    write_stream(mask_stream(docs, FAST), out, f"{out}/checkpoint").awaitTermination()
    return read_masked(spark, out)


@query(
    "ext_patterns",
    o.with_corpus(f"select doc_id, cast(s as integer) as start, cast(e as integer) as \"end\", 'CODE' as entity from ({o.plain('corpus', 'en')})", fx.DOCUMENTS_SQL),
)
def ext_patterns(spark, sf_dir):
    """A caller's own pattern in place of the default list; empty matches fall away."""
    own = vocab.Pattern("CODE", "own_code", r"en|(?=q)", 0.6)
    found = detect_fast(F.col("text"), F.array().cast("array<string>"), [own])
    return (
        fx.documents(spark, sf_dir).select("doc_id", F.explode(found).alias("c"))
        .select("doc_id", "c.start", "c.end", "c.entity")
    )


_CUSTOM = Policy(label_format={"ID": "<{n}>"}, allow_terms=(), force_fast=True, priorities={"ID": 5})


with o.policy_values(_CUSTOM.priorities, _CUSTOM.label_format):
    _CUSTOM_SQL = _chain('select doc_id, cast(s as integer) as start, cast(e as integer) as "end", repl as replacement from hits')


@query("ext_policy", _CUSTOM_SQL)
def ext_policy(spark, sf_dir):
    """Own label formats and priorities."""
    return report.hits_table(mask(fx.mixed(spark, sf_dir), _CUSTOM)).select("doc_id", "start", "end", "replacement")


@query(
    "ext_dictionary",
    o.with_corpus(
        "select doc_id, cast(s as integer) as start, cast(e as integer) as \"end\", entity, original from"
        f" (select doc_id, s, e, 'COMPANY' as entity, m as original from ({o.in_runs('corpus', f'[{o.WORD}]+', '(?i)(?:dans|the)', o.WORD, o.WORD)})"
        f" union all select doc_id, s, e, 'KEYWORD', m from ({o.plain('corpus', '(?i)and')}))", fx.DOCUMENTS_SQL),
)
def ext_dictionary(spark, sf_dir):
    """Terms given as a table: bounded company terms and free keywords."""
    from kuronuri.operators.dictionary import detect_term_table

    terms = fx.table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("ord"),
        F.expr("case when r_regionkey < 2 then 'COMPANY' else 'KEYWORD' end").alias("entity"),
        F.expr("case r_regionkey when 0 then 'the' when 1 then 'Dans' else 'and' end").alias("term"),
        F.expr("cast(case when r_regionkey < 2 then 0.995 else 0.99 end as double)").alias("score"),
        F.expr("r_regionkey < 2").alias("bounded"),
    )
    return detect_term_table(fx.documents(spark, sf_dir), terms).select("doc_id", "start", "end", "entity", "original")
