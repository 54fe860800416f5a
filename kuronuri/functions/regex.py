"""Regular expressions with Python meaning, and match offsets as Spark columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kuronuri.functions.arrays import empty, fold_emit, let

# What \w \d \s mean in Python, as character-class content under Java's (?U).
_CLASS = {"w": r"\p{L}\p{N}_", "d": r"\d", "s": r"\s\x1c-\x1f"}
SPACE = r"(?U:[\s\x1c-\x1f])"
NOT_SPACE = r"(?U:[^\s\x1c-\x1f])"
#: Put around matches and between their groups: noncharacters.
MARK, FIELD = "\ufffe", "\uffff"


def java_regex(pattern: str, flags: str = "") -> str:
    """Spell a Python pattern for Spark so that it matches the same strings.

    ``d`` makes only ``\\n`` a line end and ``U`` makes classes Unicode.  ``\\w`` and
    ``\\s`` are written out, because Java's take in marks that Python's leave out,
    and leave out four separators that Python's take in.
    """
    out, i, depth = [], 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two[0] == "\\" and len(two) == 2:
            kind = two[1]
            if kind in "wds":
                out.append(_CLASS[kind] if depth else f"[{_CLASS[kind]}]")
            elif kind in "WDS":
                out.append(f"[^{_CLASS[kind.lower()]}]")
            else:
                out.append(r"\z" if kind == "Z" else two)
            i += 2
            continue
        if depth and "i" in flags and pattern.startswith("A-Z", i):
            # Without case, Java's A-Z alone leaves out three letters that Python's takes in.
            out.append("A-Za-z")
            i += 3
            continue
        if depth:
            if two[0] == "]" and i > depth:
                depth = 0
            out.append("\\" + two[0] if two[0] in "[&" and depth else two[0])
        elif two[0] == "[":
            depth = i + (2 if pattern[i + 1 : i + 2] == "^" else 1)
            out.append("[")
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 4
            continue
        else:
            out.append(two[0])
        i += 1
    return f"(?Ud{flags})" + "".join(out)


def begins(first: str, regex: str) -> str:
    """Try at each place whether a match of a Java pattern can begin there, before it looks back."""
    if not first:
        return regex
    flags, body = re.fullmatch(r"(?s)(\(\?[a-zA-Z]+\))(.*)", regex).groups()
    case = "i" if "i" in flags else ""
    own = re.fullmatch(r"(?s)\(\?[a-zA-Z]+\)(.*)", java_regex(first, case)).group(1)
    return f"{flags}(?={own})(?:{body})"


def whole_characters(regex: str) -> str:
    """Keep a pattern that may match nothing from doing so inside a surrogate pair."""
    return rf"(?![\x{{dc00}}-\x{{dfff}}])(?:{regex})"


def has_any(text: Column, literals) -> Column:
    cond = F.lit(False)
    for lit in literals:
        cond = cond | F.contains(text, F.lit(lit))
    return cond


def could_match(text: Column, regex: str = "", needs=(), hint: str = "") -> Column:
    """A cheap filter: false only where ``regex``, or any pattern if none is given, has no match."""
    regex = java_regex(hint) if hint else regex
    hit = text.rlike(regex) if regex else text.isNotNull()
    for group in needs:
        hit = has_any(text, group) & hit
    return hit


def matches_and_gaps(text: Column, regex: str, groups=()) -> list[Column]:
    """The matches ``m``, the pieces around them ``g`` and capture groups ``g1``.., a pass for each."""
    p = F.lit(regex)
    return [
        F.regexp_extract_all(text, p, F.lit(0)).alias("m"),
        F.split(text, regex, -1).alias("g"),
        *[F.regexp_extract_all(text, p, F.lit(n)).alias(f"g{n}") for n in groups],
    ]


def holds_marks(text: Column) -> Column:
    """Does a text hold a mark itself?  Then :func:`one_pass` can not read it."""
    return F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(FIELD))


def one_pass(text: Column, regex: str, groups=()) -> Column:
    """The struct of :func:`matches_and_gaps` in one pass of the regex engine.

    Matches are put between marks, so that every second piece is one.
    """
    out = f"{MARK}$0" + "".join(f"{FIELD}${n}" for n in groups) + MARK
    pieces = F.split(F.regexp_replace(text, F.lit(regex), F.lit(out)), MARK, -1)

    def field(fs: Column, k: int) -> Column:
        return F.transform(fs, lambda f: f[k])

    def parts(v: Column) -> Column:
        gaps = F.filter(v, lambda x, i: i % 2 == 0).alias("g")
        ms = F.filter(v, lambda x, i: i % 2 == 1)
        if not groups:
            return F.struct(ms.alias("m"), gaps)
        fields = F.transform(ms, lambda x: F.split(x, FIELD, -1))
        return let(fields, lambda fs: F.struct(
            field(fs, 0).alias("m"), gaps,
            *[field(fs, k).alias(f"g{n}") for k, n in enumerate(groups, 1)]))

    return let(pieces, parts)


def matched(text: Column, regex: str, groups=()) -> Column:
    """As :func:`one_pass`; a text that holds a mark itself is read in several passes."""
    return F.when(holds_marks(text), F.struct(*matches_and_gaps(text, regex, groups))).otherwise(
        one_pass(text, regex, groups))


def offsets(v: Column, groups=()) -> Column:
    """``array<struct<s,e,m,..>>`` from the parts of :func:`matches_and_gaps`.

    The pieces between matches and the matches interleave, so offsets are the
    running sum of their lengths.
    """
    names = [f"g{n}" for n in groups]
    out_type = "struct<s:int,e:int,m:string" + "".join(f",{n}:string" for n in names) + ">"
    # A zero-width match at the very start yields no empty piece before it.
    gaps = F.when(F.size(v.g) == F.size(v.m), F.concat(F.array(F.lit("")), v.g)).otherwise(v.g)
    fields = [F.slice(gaps, 1, F.size(v.m)).alias("gap"), v.m.alias("m")]
    rows = F.arrays_zip(*fields, *[v[n].alias(n) for n in names])

    def step(st, x):
        s = st.pos + F.length(x.gap)
        e = s + F.length(x.m)
        row = F.struct(
            s.alias("s"), e.alias("e"), x.m.alias("m"), *[x[n].alias(n) for n in names]
        )
        return F.struct(e.alias("pos")), e > s, row

    return fold_emit(rows, F.struct(F.lit(0).alias("pos")), step, out_type)


def match_spans(text: Column, regex: str, needs=(), groups=(), hint: str = "") -> Column:
    """All matches of a Java pattern as ``array<struct<s,e,m[,g1..]>>`` in code points.

    One pass of the regex engine in the JVM; texts that miss a needed literal skip that work.
    """
    out_type = "struct<s:int,e:int,m:string" + "".join(f",g{n}:string" for n in groups) + ">"
    return F.when(
        could_match(text, "", needs, hint),
        let(matched(text, regex, groups),
            lambda v: F.when(F.size(v.m) > 0, offsets(v, groups)).otherwise(empty(out_type))),
    ).otherwise(empty(out_type))
