"""The review loop: user decisions on spans, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.functions.spans import splice_reviewed
from kuronuri.functions.text import black, blocks, strip
from kuronuri.operators.ordinals import row_number_in


def detections(spans: DataFrame, review_span_ids: DataFrame) -> DataFrame:
    """Payload spans as reviewable detections: enabled, not overridden."""
    flagged = review_span_ids.select("doc_id", "span_id").distinct().withColumn(
        "is_review", F.lit(True)
    )
    return (
        spans.join(flagged, ["doc_id", "span_id"], "left")
        .withColumns(
            {
                "entity_type": F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("UNKNOWN")),
                "enabled": F.lit(True),
                "mask_override": F.lit(None).cast("string"),
                "is_review": F.coalesce("is_review", F.lit(False)),
            }
        )
    )


def number_detections(dets: DataFrame, after_manual_add: bool = False) -> DataFrame:
    """``id`` by start; after a manual add, the longer of two spans goes first."""
    d = dets.withColumn("__longest", -F.col("end"))
    ties = ["__longest", "span_id"] if after_manual_add else ["span_id"]
    return row_number_in(d, ["doc_id"], "start", "id", ties=ties).drop("__longest")


def filter_detections(dets: DataFrame, query: str = "", review_only: bool = False) -> DataFrame:
    """Detections whose entity, text or reason holds the query, whatever the case."""
    if review_only:
        dets = dets.where("is_review")
    q = query.strip().lower()
    if not q:
        return dets
    def has(name: str) -> Column:
        return F.contains(F.lower(F.coalesce(name, F.lit(""))), F.lit(q))

    return dets.where(has("entity_type") | has("original") | has("reason"))


def join_actions(actions: DataFrame, spans: DataFrame) -> DataFrame:
    """Actions with the text of their span; actions on unknown spans fall away."""
    return actions.join(
        spans.select("doc_id", "span_id", "original"), ["doc_id", "span_id"]
    )


def _first_of_each(acts: DataFrame, term: str) -> DataFrame:
    """Position of the first action on every term."""
    return acts.groupBy(term).agg(F.min(F.struct("doc_id", "seq")).alias("at"))


def new_allow_terms(joined: DataFrame, allow: DataFrame) -> DataFrame:
    """Terms that ALWAYS_KEEP adds to the allow-list ``allow(term)``."""
    asked = joined.where((F.col("op") == "ALWAYS_KEEP") & (F.col("original") != ""))
    return (
        _first_of_each(asked, "original").withColumnRenamed("original", "term")
        .join(allow, "term", "left_anti")
        .select("term", F.col("at.doc_id").alias("doc_id"), F.col("at.seq").alias("seq"))
    )


def extend_allowlist(joined: DataFrame, allow: DataFrame) -> DataFrame:
    return allow.select("term").unionByName(new_allow_terms(joined, allow).select("term"))


def new_company_terms(joined: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms that ALWAYS_MASK_AS_COMPANY adds to the company list ``terms(term)``."""
    asked = (
        joined.where(F.col("op") == "ALWAYS_MASK_AS_COMPANY")
        .withColumn("term", strip("original")).where(F.col("term") != "")
    )
    return _first_of_each(asked, "term").join(terms, "term", "left_anti").select("term")


def extend_companies(joined: DataFrame, terms: DataFrame) -> DataFrame:
    return terms.select("term").unionByName(new_company_terms(joined, terms))


def applied_log(joined: DataFrame, allow: DataFrame) -> DataFrame:
    """What each action did: ``(doc_id, seq, op, term, skipped)``.

    Keeping is logged only where it added its term; company terms are logged
    every time; any other action is logged as skipped.
    """
    added = new_allow_terms(joined, allow).withColumn("__new", F.lit(True))
    rows = joined.withColumnRenamed("original", "term").join(
        added, ["term", "doc_id", "seq"], "left"
    )
    keeps = F.col("op") == "ALWAYS_KEEP"
    return rows.where(~keeps | F.col("__new")).select(
        "doc_id", "seq", "op", "term",
        (~F.col("op").isin("ALWAYS_KEEP", "ALWAYS_MASK_AS_COMPANY")).alias("skipped"),
    )


def last_clicks(actions: DataFrame) -> DataFrame:
    """``doc_id, span_id, last_seq, last_op, forced``: what KEEP_ONCE and MASK_ONCE make of each span.

    The highest ``seq`` counts (a null one comes before all others; of equal ones the operation that is
    later in the alphabet), so neither order nor repetition of ``actions(doc_id, span_id, seq, op)`` matters.
    ``forced``: a mask was asked for at some time.  Works on batches and streams.
    """
    return (
        actions.where(F.col("op").isin("KEEP_ONCE", "MASK_ONCE"))
        .groupBy("doc_id", "span_id")
        .agg(
            F.max(F.struct("seq", "op")).alias("last"),
            F.bool_or(F.col("op") == "MASK_ONCE").alias("forced"),
        )
        .select("doc_id", "span_id", F.col("last.seq").alias("last_seq"),
                F.col("last.op").alias("last_op"), "forced")
    )


def apply_once(dets: DataFrame, actions: DataFrame) -> DataFrame:
    """KEEP_ONCE and MASK_ONCE, click by click: the latest decides ``enabled``."""
    return apply_clicks(dets, last_clicks(actions))


def apply_clicks(dets: DataFrame, clicks: DataFrame) -> DataFrame:
    """Detections with the decisions of :func:`last_clicks`; clicks on unknown spans fall away."""
    once = clicks.select("doc_id", "span_id", F.col("last_op").alias("__last"),
                         F.col("forced").alias("__forced"))
    return (
        dets.join(once, ["doc_id", "span_id"], "left")
        .withColumns(
            {
                "enabled": F.coalesce(F.col("__last") == "MASK_ONCE", "enabled"),
                "source": F.when(F.col("__forced"), "forced").otherwise(F.col("source")),
            }
        )
        .drop("__last", "__forced")
    )


def apply_always(dets: DataFrame, actions: DataFrame) -> DataFrame:
    """Effect of the lasting actions on the detections at hand."""
    last = (
        actions.where(F.col("op").isin("ALWAYS_KEEP", "ALWAYS_MASK_AS_COMPANY"))
        .groupBy("doc_id", "span_id")
        .agg(
            F.max_by("op", "seq").alias("__last"),
            F.bool_or(F.col("op") == "ALWAYS_MASK_AS_COMPANY").alias("__company"),
        )
    )
    return (
        dets.join(last, ["doc_id", "span_id"], "left")
        .withColumns(
            {
                "enabled": F.coalesce(F.col("__last") != "ALWAYS_KEEP", "enabled"),
                "entity_type": F.when(F.col("__company"), "COMPANY")
                .otherwise(F.col("entity_type")),
                "source": F.when(F.col("__company"), "forced").otherwise(F.col("source")),
            }
        )
        .drop("__last", "__company")
    )


def edit_label(dets: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits(doc_id, span_id, label)``: a new label, blank to take it back."""
    e = edits.select("doc_id", "span_id", F.nullif(strip("label"), F.lit("")).alias("__label"),
                     F.lit(True).alias("__edit"))
    return (
        dets.join(e, ["doc_id", "span_id"], "left")
        .withColumns(
            {
                "mask_override": F.when(F.col("__edit"), F.col("__label"))
                .otherwise(F.col("mask_override")),
                "enabled": F.coalesce("__edit", "enabled"),
            }
        )
        .drop("__label", "__edit")
    )


def keep_spans(dets: DataFrame) -> DataFrame:
    return dets.where(~F.col("enabled")).select("doc_id", "start", "end")


def forced_masks(dets: DataFrame) -> DataFrame:
    override = F.coalesce("mask_override", F.lit("")) != ""
    return dets.where(F.col("enabled") & ((F.col("source") == "forced") | override)).select(
        "doc_id", "start", "end", F.col("entity_type").alias("entity"),
        F.col("mask_override").alias("label"),
        F.when(override, "forced:ui_override").otherwise("forced:manual_add").alias("reason"),
    )


def reviewed_replacement(entity: Column, original: Column, override: Column,
                         blackout: bool = False) -> Column:
    if blackout:
        return black(original, 3)
    return F.coalesce(
        F.nullif(override, F.lit("")), F.concat(F.lit("["), entity, F.lit("]"))
    )


def mask_reviewed(docs: DataFrame, dets: DataFrame, blackout: bool = False) -> DataFrame:
    """Masked texts from reviewed detections; of overlapping ones the first wins.

    Of detections with one start only the first can be used, so the others are
    dropped before the rows of a document meet; what is left is bounded by the
    length of its text.
    """
    edit = F.struct(
        "start", "end",
        reviewed_replacement(
            F.col("entity_type"), F.col("original"), F.col("mask_override"), blackout
        ).alias("out"),
    )
    first = (
        dets.where("enabled").groupBy("doc_id", "start")
        .agg(F.min_by(edit, "span_id").alias("edit"))
    )
    edits = first.groupBy("doc_id").agg(F.sort_array(F.collect_list("edit")).alias("edits"))
    text = F.col("text")
    return docs.join(edits, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("edits").isNull(), text)
        .otherwise(splice_reviewed(blocks(text), F.length(text), F.col("edits")))
        .alias("masked"),
    )


# --- spans added by hand ------------------------------------------------------------


def _find(text: Column, sel: Column, low: Column, high: Column) -> Column:
    """First position of ``sel`` fully inside ``[low, high)``, else null."""
    at = F.instr(text.substr(low + 1, high - low), sel)
    return F.when(at > 0, low + at - 1)


def relocate(manual: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans marked by hand, moved to where their text really stands.

    ``manual(doc_id, start, end, sel, entity)``: a span whose text differs from the
    selection is shortened to it, else looked up within 200 characters, else
    anywhere, else left as it is.
    """
    s, e, sel, text = F.col("start"), F.col("end"), F.col("sel"), F.col("text")
    n, size = F.length("sel"), F.length("text")
    inside = (s >= 0) & (s <= size) & (e >= 0) & (e <= size)
    exact = inside & (text.substr(s + 1, e - s) == sel)
    shorter = inside & (text.substr(s + 1, n) == sel)
    near = _find(text, sel, F.greatest(F.lit(0), s - vocab.RELOCATE_WINDOW),
                 F.least(size, s + vocab.RELOCATE_WINDOW + n))
    anywhere = _find(text, sel, F.lit(0), size)
    found = F.coalesce(near, anywhere)
    span = (
        F.when(exact, F.struct(s.alias("s"), e.alias("e")))
        .when(shorter, F.struct(s.alias("s"), (s + n).alias("e")))
        .otherwise(
            F.struct(
                F.coalesce(found, s).alias("s"),
                F.when(found.isNotNull(), found + n).otherwise(e).alias("e"),
            )
        )
    )
    return (
        manual.where((e > s) & (strip(sel) != "")).join(docs.select("doc_id", "text"), "doc_id")
        .withColumn("__at", span)
        .select(*[c for c in manual.columns if c not in ("start", "end")],
                F.col("__at.s").alias("start"), F.col("__at.e").alias("end"), "text")
    )


def expand_manual_company(spans: DataFrame) -> DataFrame:
    """Company spans take in one designator directly on their left and right."""
    s, e, text = F.col("start"), F.col("end"), F.col("text")

    def left(t: str) -> Column:
        low = F.greatest(F.lit(0), s - len(t))
        return F.when(text.substr(low + 1, s - low) == t, s - len(t))

    def right(t: str) -> Column:
        return F.when(text.substr(e + 1, F.lit(len(t))) == t, e + len(t))

    company = F.upper("entity") == "COMPANY"
    return spans.withColumns(
        {
            "start": F.when(company, F.coalesce(*[left(t) for t in vocab.MANUAL_LEFT], s))
            .otherwise(s),
            "end": F.when(company, F.coalesce(*[right(t) for t in vocab.MANUAL_RIGHT], e))
            .otherwise(e),
        }
    )


def add_manual(dets: DataFrame, spans: DataFrame) -> DataFrame:
    """Add located spans as forced detections; one that is there is enabled again."""
    key = ["doc_id", "entity_type", "start", "end"]
    new = (
        spans.select(
            "doc_id", F.upper("entity").alias("entity_type"), "start", "end",
            F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))
            .alias("original"),
        )
        .dropDuplicates(key)
    )
    seen = new.select(*key).withColumn("__again", F.lit(True))
    old_key = F.upper("entity_type")
    old = (
        dets.withColumn("__e", old_key)
        .join(seen.withColumnRenamed("entity_type", "__e"), ["doc_id", "__e", "start", "end"],
              "left")
        .withColumn("enabled", F.col("enabled") | (
            F.coalesce("__again", F.lit(False)) & (F.col("source") == "forced")))
        .select(*dets.columns)
    )
    had = dets.where(F.col("source") == "forced").select(
        "doc_id", old_key.alias("entity_type"), "start", "end"
    )
    sid = F.concat_ws("_", F.lit("manual"), "start", "end")
    fresh = new.join(had, key, "left_anti").select(
        sid.alias("span_id"), sid.alias("mark_id"), "doc_id", "entity_type", "start", "end",
        "original", F.lit(1.0).alias("score"), F.lit("forced:manual_add").alias("reason"),
        F.lit("forced").alias("source"), F.lit(True).alias("enabled"),
        F.lit(None).cast("string").alias("mask_override"), F.lit(False).alias("is_review"),
    )
    return old.unionByName(fresh, allowMissingColumns=True)
