"""Small building blocks on array columns: let-binding and ordered folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folds go block by block: a fold copies what it has gathered at every item, so only a block's
# rows are gathered item by item, and all of them once a block.  n items cost about
# n * (BLOCK / 2 + n / BLOCK / 2) copies, not n * n / 2.
BLOCK = 128


def empty(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def fold_emit(
    items: Column,
    init: Column,
    step: Callable[[Column, Column], tuple[Column, Column, Column]],
    element_type: str,
    last: Callable[[Column], tuple[Column, Column]] | None = None,
) -> Column:
    """Walk ``items`` in order with a state and emit at most one value per item.

    ``step(state, item)`` gives ``(new_state, emit?, value)``; ``last(state)``
    may emit one closing value.
    """
    none = empty(element_type)

    def merge(acc: Column, x: Column) -> Column:
        state, emit, value = step(acc.st, x)
        return F.struct(
            state.alias("st"),
            F.when(emit, F.array_append(acc.open, value)).otherwise(acc.open).alias("open"),
        )

    def block(xs: Column, acc: Column, at: Column) -> Column:
        done = F.aggregate(
            F.slice(xs, at, BLOCK), F.struct(acc.st.alias("st"), none.alias("open")), merge)
        return let(done, lambda d: F.struct(
            d.st.alias("st"), F.array_append(acc.full, d.open).alias("full")))

    def finish(acc: Column) -> Column:
        out = F.flatten(acc.full)
        if last is None:
            return out
        emit, value = last(acc.st)
        return F.when(emit, F.array_append(out, value)).otherwise(out)

    def walk(xs: Column) -> Column:
        heads = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK)))
        zero = F.struct(init.alias("st"), empty(f"array<{element_type}>").alias("full"))
        return F.when(xs.isNotNull(), F.aggregate(
            F.coalesce(heads, empty("int")), zero, lambda acc, at: block(xs, acc, at), finish))

    return let(items, walk)


def count_below(sorted_: Column, n: Column, below: Callable[[Column], Column]) -> Column:
    """How many items at the head of ``sorted_``, of length ``n``, fulfil ``below``, found by halving.

    ``below`` must hold for a head of the array and for nothing behind it.
    """
    steps = F.filter(F.array(*[F.lit(1 << k) for k in reversed(range(31))]), lambda s: s <= n)
    return F.aggregate(
        steps, F.lit(0),
        lambda at, s: at + F.when((at + s <= n) & below(F.get(sorted_, at + s - 1)), s).otherwise(0))
