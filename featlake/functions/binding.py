"""Naming intermediate values inside one column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[..., "Column | tuple[Column, ...]"]


def let(fn: Step, *values) -> Column | tuple[Column, ...]:
    """``fn(*values)`` with every value computed once per row, however often ``fn`` uses it.

    A column expression is a tree: using a value twice repeats its whole subtree. Passing the
    values through a one-element array and a lambda gives them names instead.
    """
    return pipe(values, fn)


def pipe(values, *steps: Step) -> Column | tuple[Column, ...]:
    """Feed values through steps; what a step returns (one column or several) feeds the next."""
    names = [f"v{i}" for i in range(len(values))]
    row = F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for v, n in zip(values, names)])
    single = False
    for step in steps:
        row, names, single = _apply(step, row, names)
    return row["v0"] if single else tuple(row[n] for n in names)


def _apply(step: Step, row: Column, names: list[str]) -> tuple[Column, list[str], bool]:
    made: list[tuple[list[str], bool]] = []

    def body(r: Column) -> Column:
        out = step(*[r[n] for n in names])
        columns = out if isinstance(out, tuple) else (out,)
        new = [f"v{i}" for i in range(len(columns))]
        made.append((new, not isinstance(out, tuple)))
        return F.struct(*[c.alias(n) for c, n in zip(columns, new)])

    applied = F.get(F.transform(F.array(row), body), F.lit(0))
    return applied, *made[0]
