"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.spec import Range, Rectangle, f32

#: How a missing category is stored and named.
MISSING = "N/A"


def real(value: float) -> Column:
    """A 32-bit literal: comparing a FLOAT column with a double literal would widen the column."""
    return F.lit(f32(value)).cast("float")


def inside(column: str | Column, r: Range) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return (c >= real(r.lo) if r.lo_closed else c > real(r.lo)) & (c <= real(r.hi) if r.hi_closed else c < real(r.hi))


def in_window(rect: Rectangle, x: str = "x", y: str = "y") -> Column:
    return inside(x, rect.x) & inside(y, rect.y)


def has_values(filters: dict) -> Column:
    """Conjunction of equalities on columns where a missing value is stored as `N/A`."""
    out = F.lit(True)
    for c, v in filters.items():
        out = out & (F.col(c) == F.lit(MISSING if v is None else str(v)))
    return out


def has_values_raw(filters: dict) -> Column:
    """The same on columns that still hold nulls, in a form that the scan can take where possible."""
    out = F.lit(True)
    for c, v in filters.items():
        text = MISSING if v is None else str(v)
        out = out & ((F.coalesce(F.col(c), F.lit(MISSING)) == text) if text == MISSING else (F.col(c) == text))
    return out


_COMPARE = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
}


def compare(column: str, op: str, value: float) -> Column:
    """Comparison of a FLOAT column with a constant; null is false. NaN equals NaN; 0.0 equals -0.0."""
    if op not in _COMPARE:
        raise ValueError(f"unknown comparison {op!r}")
    return F.coalesce(_COMPARE[op](F.col(column), real(value)), F.lit(False))


def zone_test(op: str, value: float, lo: str = "lo", hi: str = "hi") -> Column:
    """Over a tile's least and greatest value: true if all rows pass, false if none does, else null."""
    v, low, high = real(value), F.col(lo), F.col(hi)
    if op == "<":
        return F.when(high < v, True).when(low >= v, False)
    if op == ">":
        return F.when(low > v, True).when(high <= v, False)
    if op in _COMPARE:
        return F.lit(None).cast("boolean")
    raise ValueError(f"unknown comparison {op!r}")
