"""The definition of an answer: one aggregate over the qualifying rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import MISSING, has_values, in_window
from ..plans.spec import DatasetSpec, WindowQuery
from . import stats


@dataclass
class Answer:
    """Lazy frames, each planned when it is first asked for: group metrics, the window's total, the points (y, x); and counters."""

    of_groups: Callable[[], DataFrame]
    of_total: Callable[[], DataFrame]
    of_points: Callable[[], DataFrame]
    metrics: dict = field(default_factory=dict)

    @cached_property
    def groups(self) -> DataFrame:
        return self.of_groups()

    @cached_property
    def total(self) -> DataFrame:
        return self.of_total()

    @cached_property
    def points(self) -> DataFrame:
        return self.of_points()


def prepare(df: DataFrame, spec: DatasetSpec, row_id: str | None = None, precision: str = "double") -> DataFrame:
    """Roles to fixed columns: x and y FLOAT, categories with `N/A`, m0 and m1, maybe row_id.

    Rows without x or y, or outside the spec's bounds, go. A missing measure stays null: such a
    row is a point but takes no part in statistics.
    """
    kind = dict(df.dtypes)
    number = lambda c, t: F.expr(f"try_cast(trim(`{c}`) as {t})") if kind[c] == "string" else F.col(c).cast(t)
    m = [number(c, "float" if precision == "float" else "double").cast("double") for c in spec.measures]
    m += [F.lit(0.0)] * (2 - len(m)) if m else [F.lit(None).cast("double")] * 2
    got = df.select(
        number(spec.x, "float").alias("x"),
        number(spec.y, "float").alias("y"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in spec.cats],
        m[0].alias("m0"),
        m[1].alias("m1"),
        *([F.col(row_id).alias("row_id")] if row_id else []),
    ).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    return got.where(in_window(spec.bounds)) if spec.bounds else got


def qualifying(rows: DataFrame, query: WindowQuery) -> DataFrame:
    return rows.where(in_window(query.rect) & has_values(query.filters))


def with_measure(rows: DataFrame, spec: DatasetSpec, query: WindowQuery) -> tuple[DataFrame, bool]:
    """Rows with the asked measure alone as m0, if one is asked; and whether there are two."""
    if query.measure is None:
        return rows, len(spec.measures) == 2
    source = f"m{spec.measures.index(query.measure)}"
    return rows.withColumns({"m0": F.col(source), "m1": F.when(F.col(source).isNotNull(), 0.0)}), False


def answer(rows: DataFrame, spec: DatasetSpec, query: WindowQuery) -> Answer:
    """Over prepared rows."""
    query.validate(spec)
    found = qualifying(rows, query)
    measured, two = with_measure(found, spec, query)
    keys = list(query.group_by)
    return Answer(
        lambda: stats.metrics(stats.aggregate(measured, keys), keys, two),
        lambda: stats.metrics(stats.aggregate(measured, []), [], two),
        lambda: found.select("y", "x"),
    )


def rollup(rows: DataFrame, spec: DatasetSpec, query: WindowQuery) -> DataFrame:
    """Groups and their total in one pass: `is_total` marks the rows above the groups."""
    query.validate(spec)
    measured, two = with_measure(qualifying(rows, query), spec, query)
    keys = list(query.group_by)
    used = measured.where(F.col("m0").isNotNull() & F.col("m1").isNotNull())
    marks = [F.grouping(k).cast("int").alias(f"g_{k}") for k in keys]
    got = used.rollup(*keys).agg(*stats.state_of(F.col("m0"), F.col("m1")), *marks)
    whole = reduce(lambda a, b: a & b, [F.col(f"g_{k}") == 1 for k in keys], F.lit(True))
    edge = reduce(lambda a, b: a & b, [F.col(f"g_{k}") == 0 for k in keys], F.lit(True))
    got = got.where((whole | edge) & (F.col("n") > 0)).withColumn("is_total", whole)
    return stats.metrics(got, [*keys, "is_total"], two)
