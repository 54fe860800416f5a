"""Names that end in a company designator, found from the designator backwards.

``\\S{1,30}\\s*DESIGNATOR`` makes a regex engine try thirty lengths at every
character.  Designators are rare and cannot overlap, so they are found first.  For
the one at ``c``, blanks before it end the name at ``b``, and a name may start
anywhere in the last thirty non-blank characters before ``b``.  Walking the
designators in order gives what the pattern finds: the leftmost start not yet
used, and for that start the farthest designator that a name from there reaches.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kuronuri import vocab
from kuronuri.functions.arrays import empty, fold_emit, let
from kuronuri.functions.regex import NOT_SPACE, SPACE, has_any, match_spans
from kuronuri.functions.text import blocks, cut

NAME_MAX = 30
SPAN = "struct<s:int,e:int>"
MATCH = "struct<s:int,e:int,m:string>"


def suffix_spans(text: Column) -> Column:
    """``array<struct<s,e,m>>`` of names with a designator behind them."""
    designators = match_spans(text, "|".join(vocab.CORPORATE))

    def reach(pieces: Column, c: Column) -> Column:
        """``struct<low, b, e>``: a name can start in [low, b) and the match ends at e."""
        before = cut(pieces, F.greatest(c.s - NAME_MAX, F.lit(0)), c.s)
        # Blanks may go back farther than the window; then look at all before it.
        seen = let(
            F.length(F.regexp_extract(before, f"{SPACE}*\\z", 0)),
            lambda n: F.when(n < F.length(before), n).otherwise(
                F.length(F.regexp_extract(cut(pieces, F.lit(0), c.s), f"(?<!{SPACE}){SPACE}*\\z", 0))
            ),
        )

        def row(blanks: Column) -> Column:
            b = c.s - blanks
            name = F.regexp_extract(
                cut(pieces, F.greatest(b - NAME_MAX, F.lit(0)), b), f"{NOT_SPACE}*\\z", 0
            )
            return F.struct((b - F.length(name)).alias("low"), b.alias("b"), c.e.alias("e"))

        return let(seen, row)

    def step(st, x):
        more = (st.e > 0) & (st.s >= x.low) & (st.s < x.b)
        start = F.greatest(x.low, st.e)
        fresh = ~more & (start < x.b)
        state = F.struct(
            F.when(fresh, start).otherwise(st.s).alias("s"),
            F.when(more | fresh, x.e).otherwise(st.e).alias("e"),
        )
        return state, fresh & (st.e > 0), F.struct(st.s.alias("s"), st.e.alias("e"))

    def spans(pieces: Column) -> Column:
        zero = F.struct(F.lit(-1).alias("s"), F.lit(0).alias("e"))
        walked = fold_emit(
            F.transform(designators, lambda c: reach(pieces, c)), zero, step, SPAN,
            last=lambda st: (st.e > 0, F.struct(st.s.alias("s"), st.e.alias("e"))),
        )
        return F.transform(
            walked,
            lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), cut(pieces, x.s, x.e).alias("m")),
        )

    return F.when(has_any(text, vocab.CORPORATE), let(blocks(text), spans)).otherwise(empty(MATCH))
