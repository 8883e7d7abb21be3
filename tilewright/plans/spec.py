"""What is asked of a table: axes, windows, queries, and their text forms."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np


def f32(value: float) -> float:
    """The value as a 32-bit float, widened again: all axis bounds go through here."""
    return float(np.float32(value))


@dataclass(frozen=True)
class Range:
    """An interval of 32-bit floats, open unless said otherwise."""

    lo: float
    hi: float
    lo_closed: bool = False
    hi_closed: bool = False

    def __post_init__(self):
        object.__setattr__(self, "lo", f32(self.lo))
        object.__setattr__(self, "hi", f32(self.hi))

    @property
    def size(self) -> float:
        return f32(np.float32(self.hi) - np.float32(self.lo))

    @property
    def center(self) -> float:
        return (self.lo + self.hi) / 2

    def contains(self, v: float) -> bool:
        return (v > self.lo or (self.lo_closed and v == self.lo)) and (v < self.hi or (self.hi_closed and v == self.hi))

    def intersects(self, other: Range) -> bool:
        """Whether some number lies in both (touching counts only where both ends are closed)."""
        left = self.lo < other.hi or (self.lo == other.hi and self.lo_closed and other.hi_closed)
        right = other.lo < self.hi or (other.lo == self.hi and other.lo_closed and self.hi_closed)
        return left and right

    def encloses(self, other: Range) -> bool:
        low = self.lo < other.lo or (self.lo == other.lo and (self.lo_closed or not other.lo_closed))
        high = self.hi > other.hi or (self.hi == other.hi and (self.hi_closed or not other.hi_closed))
        return low and high

    def __str__(self) -> str:
        return f"{'[' if self.lo_closed else '('}{self.lo:g}..{self.hi:g}{']' if self.hi_closed else ')'}"


@dataclass(frozen=True)
class Rectangle:
    x: Range
    y: Range

    @classmethod
    def of(cls, x0: float, x1: float, y0: float, y1: float) -> Rectangle:
        return cls(Range(x0, x1), Range(y0, y1))

    def contains(self, x: float, y: float) -> bool:
        return self.x.contains(x) and self.y.contains(y)

    def intersects(self, other: Rectangle) -> bool:
        return self.x.intersects(other.x) and self.y.intersects(other.y)

    def encloses(self, other: Rectangle) -> bool:
        return self.x.encloses(other.x) and self.y.encloses(other.y)

    @property
    def center(self) -> tuple[float, float]:
        return self.x.center, self.y.center

    @property
    def area(self) -> float:
        return f32(np.float32(self.x.size) * np.float32(self.y.size))

    def distance(self, other: Rectangle) -> float:
        (a, b), (c, d) = self.center, other.center
        return math.hypot(a - c, b - d)

    def widened(self) -> Rectangle:
        """The open rectangle, one float larger on each side, that keeps points on the edges."""
        grow = lambda r: Range(np.nextafter(np.float32(r.lo), np.float32(-np.inf)), np.nextafter(np.float32(r.hi), np.float32(np.inf)))
        return Rectangle(grow(self.x), grow(self.y))


@dataclass(frozen=True)
class DatasetSpec:
    """Roles of a table's columns. `columns` names the positions of a headerless file."""

    x: str
    y: str
    cats: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    bounds: Rectangle | None = None
    n_rows: int | None = None
    columns: tuple[str, ...] = ()
    delimiter: str = ","
    header: bool = False

    def __post_init__(self):
        if len(self.measures) > 2:
            raise ValueError("at most two measures")
        if len(set(self.cats)) < len(self.cats):
            raise ValueError("a categorical column is named twice")


@dataclass(frozen=True)
class IndexConfig:
    grid: int = 100
    subtile_ratio: float = 0.2
    threshold: int = 200
    filter_score: float = 0.5
    group_score: float = 0.4
    other_score: float = 0.1
    delimiter: str = ","

    @property
    def subtiles(self) -> int:
        return int(self.grid * self.grid * self.subtile_ratio)

    @classmethod
    def from_properties(cls, text: str) -> IndexConfig:
        """From lines `NAME=value`; names that are not known are left out."""
        known = {
            "GRID_SIZE": ("grid", int),
            "SUBTILE_RATIO": ("subtile_ratio", float),
            "THRESHOLD": ("threshold", int),
            "DELIMITER": ("delimiter", str),
            "FILTER_SCORE": ("filter_score", float),
            "GROUP_BY_SCORE": ("group_score", float),
            "OTHER_SCORE": ("other_score", float),
        }
        found = {}
        for line in text.splitlines():
            name, sep, value = line.partition("=")
            if sep and not line.lstrip().startswith(("#", "!")) and name.strip().upper() in known:
                to, kind = known[name.strip().upper()]
                found[to] = kind(value.strip())
        return cls(**found)


@dataclass(frozen=True)
class WindowQuery:
    """A window on both axes, equalities on categories, grouping columns, and maybe one measure."""

    rect: Rectangle
    filters: dict = field(default_factory=dict)
    group_by: tuple = ()
    measure: str | int | None = None

    def __post_init__(self):
        object.__setattr__(self, "filters", dict(self.filters or {}))
        object.__setattr__(self, "group_by", tuple(self.group_by or ()))

    def __hash__(self):
        return hash((self.rect, tuple(sorted(self.filters.items(), key=str)), self.group_by, self.measure))

    def validate(self, spec: DatasetSpec) -> WindowQuery:
        for c in [*self.filters, *self.group_by]:
            if c not in spec.cats:
                raise ValueError(f"{c!r} is not a categorical column of the dataset")
        if self.measure is not None and self.measure not in spec.measures:
            raise ValueError(f"{self.measure!r} is not a measure of the dataset")
        return self

    @property
    def attributes(self) -> set:
        return {*self.filters, *self.group_by}


def parse_range(text: str) -> Range:
    lo, hi = text.split(":")
    return Range(float(lo), float(hi))


def parse_rectangle(text: str) -> Rectangle:
    x, y = text.split(",")
    return Rectangle(parse_range(x), parse_range(y))


def parse_filters(text: str) -> dict[int, str]:
    found = {}
    for part in filter(None, text.split(",")):
        column, _, value = part.partition(":")
        found[int(column)] = value
    return found


_NUMBER = r"[-+0-9.eE]+"
_QUERY = re.compile(
    rf"Query\{{rect=\(({_NUMBER})\.\.({_NUMBER})\),\(({_NUMBER})\.\.({_NUMBER})\), "
    r"categoricalFilters=\{(.*?)\}, groupByCols=\[(.*?)\], measureCol=(\w+)\}"
)


def parse_query(line: str) -> WindowQuery:
    """From the logged text form; columns are positions."""
    m = _QUERY.fullmatch(line.strip())
    if not m:
        raise ValueError(f"not a query: {line!r}")
    filters = dict(part.split("=", 1) for part in m[5].split(", ") if part)
    groups = tuple(int(c) for c in m[6].split(", ") if c)
    return WindowQuery(Rectangle.of(*map(float, m.group(1, 2, 3, 4))), {int(k): v for k, v in filters.items()}, groups, None if m[7] == "null" else int(m[7]))


def _short(v: float) -> str:
    """The shortest text that reads back as the same 32-bit float."""
    text = np.format_float_positional(np.float32(v), unique=True, trim="0")
    return text


def format_query(q: WindowQuery) -> str:
    r = q.rect
    filters = ", ".join(f"{k}={v}" for k, v in q.filters.items())
    return (
        f"Query{{rect=({_short(r.x.lo)}..{_short(r.x.hi)}),({_short(r.y.lo)}..{_short(r.y.hi)}), categoricalFilters={{{filters}}}, "
        f"groupByCols=[{', '.join(map(str, q.group_by))}], measureCol={'null' if q.measure is None else q.measure}}}"
    )
