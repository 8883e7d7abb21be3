"""Paired statistics of up to two measures: direct aggregates, mergeable states, and their merge.

A state is (n, mean0, m2_0, min0, max0, mean1, m2_1, min1, max1, c01), with m2 the centred sum of
squares and c01 the centred sum of products. Rows count only if both measures are present. With
one measure the second is the constant 0, so its correlation is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = ("n", "mean0", "m2_0", "min0", "max0", "mean1", "m2_1", "min1", "max1", "c01")


def state_of(m0: Column, m1: Column) -> list[Column]:
    """Aggregates over raw rows; `m0` and `m1` are not null together."""
    n = F.count(m0)
    return [
        n.alias("n"),
        F.avg(m0).alias("mean0"),
        (F.var_pop(m0) * n).alias("m2_0"),
        F.min(m0).alias("min0"),
        F.max(m0).alias("max0"),
        F.avg(m1).alias("mean1"),
        (F.var_pop(m1) * n).alias("m2_1"),
        F.min(m1).alias("min1"),
        F.max(m1).alias("max1"),
        (F.covar_pop(m0, m1) * n).alias("c01"),
    ]


def aggregate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """State per group of rows with measures `m0` and `m1`; without keys one row, or none over no rows."""
    used = rows.where(F.col("m0").isNotNull() & F.col("m1").isNotNull())
    return used.groupBy(*keys).agg(*state_of(F.col("m0"), F.col("m1"))).where("n > 0")


def merge(states: DataFrame, keys: list[str], pivot: tuple[float, float] | None = None) -> DataFrame:
    """Groups of states to one state each.

    Centred sums are taken about a pivot, so that nothing cancels: with d = mean - pivot, M2 = sum m2 + sum n d^2 - (sum n d)^2 / N.
    With a given pivot (means of the whole table, which an index keeps) this is one aggregate. Without, each group's pivot is the middle of its means,
    found first and joined.
    """
    used = states.where("n > 0")
    if pivot is not None:
        both = used.withColumns({"p0": F.lit(float(pivot[0])), "p1": F.lit(float(pivot[1]))})
    else:
        found = used.groupBy(*keys).agg(F.min("mean0").alias("p0"), F.max("mean0").alias("q0"), F.min("mean1").alias("p1"), F.max("mean1").alias("q1"))
        found = found.select(*keys, ((F.col("p0") + F.col("q0")) / 2).alias("p0"), ((F.col("p1") + F.col("q1")) / 2).alias("p1"))
        both = used.join(found, keys) if keys else used.join(F.broadcast(found), F.lit(True), "left")
    n, d0, d1 = F.col("n"), F.col("mean0") - F.col("p0"), F.col("mean1") - F.col("p1")
    sums = both.groupBy(*keys).agg(
        F.sum(n).alias("n"),
        F.first("p0").alias("p0"),
        F.first("p1").alias("p1"),
        F.sum(n * d0).alias("s0"),
        F.sum(n * d1).alias("s1"),
        F.sum(F.col("m2_0") + n * d0 * d0).alias("q0"),
        F.sum(F.col("m2_1") + n * d1 * d1).alias("q1"),
        F.sum(F.col("c01") + n * d0 * d1).alias("q01"),
        *[f(c).alias(c) for c, f in (("min0", F.min), ("max0", F.max), ("min1", F.min), ("max1", F.max))],
    )
    n = F.col("n")
    return sums.where("n > 0").select(
        *keys,
        n,
        (F.col("p0") + F.col("s0") / n).alias("mean0"),
        F.greatest(F.col("q0") - F.col("s0") * F.col("s0") / n, F.lit(0.0)).alias("m2_0"),
        "min0",
        "max0",
        (F.col("p1") + F.col("s1") / n).alias("mean1"),
        F.greatest(F.col("q1") - F.col("s1") * F.col("s1") / n, F.lit(0.0)).alias("m2_1"),
        "min1",
        "max1",
        (F.col("q01") - F.col("s0") * F.col("s1") / n).alias("c01"),
    )


def of_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with both measures as a state of its own: merging takes rows and states in one aggregate."""
    zero = F.lit(0.0)
    per = [x for i in (0, 1) for m in [F.col(f"m{i}")] for x in (m.alias(f"mean{i}"), zero.alias(f"m2_{i}"), m.alias(f"min{i}"), m.alias(f"max{i}"))]
    return rows.where(F.col("m0").isNotNull() & F.col("m1").isNotNull()).select(*keys, F.lit(1).cast("long").alias("n"), *per, zero.alias("c01"))


def of_one(states: DataFrame, i: int) -> DataFrame:
    """States of two measures to states of one: right where no row has but one of them."""
    if i:
        states = states.withColumns({"mean0": F.col("mean1"), "m2_0": F.col("m2_1"), "min0": F.col("min1"), "max0": F.col("max1")})
    return states.withColumns(dict.fromkeys(("mean1", "m2_1", "min1", "max1", "c01"), F.lit(0.0)))


def metrics(states: DataFrame, keys: list[str], two: bool = True) -> DataFrame:
    """What a state says: counts, sums, means, extrema, variances, and of both: covariance, correlation, fit."""
    n = F.col("n")
    per = []
    for i in (0, 1) if two else (0,):
        mean, m2 = F.col(f"mean{i}"), F.col(f"m2_{i}")
        per += [
            (mean * n).alias(f"sum{i}"),
            mean,
            F.col(f"min{i}"),
            F.col(f"max{i}"),
            (m2 / n).alias(f"var_pop{i}"),
            F.when(n > 1, m2 / (n - 1)).alias(f"var_samp{i}"),
            F.sqrt(m2 / n).alias(f"std_pop{i}"),
            F.when(n > 1, F.sqrt(m2 / (n - 1))).alias(f"std_samp{i}"),
        ]
    scale = F.sqrt(F.col("m2_0") / n) * F.sqrt(F.col("m2_1") / n)
    slope = F.try_divide(F.col("c01"), F.col("m2_0"))
    pair = [
        (F.col("c01") / n).alias("covar_pop"),
        F.when(n > 1, F.col("c01") / (n - 1)).alias("covar_samp"),
        F.try_divide(F.col("c01") / n, scale).alias("corr"),
        slope.alias("slope"),
        (F.col("mean1") - slope * F.col("mean0")).alias("intercept"),
    ]
    return states.select(*keys, n, *per, *pair)
