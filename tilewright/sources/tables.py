"""Tables: delimited files, bounds and domains, synthetic data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import MISSING
from ..plans.spec import DatasetSpec, Rectangle


def read_csv(spark: SparkSession, path: str, spec: DatasetSpec) -> DataFrame:
    """All columns as strings, by the spec's positions; `#` lines and blank lines are skipped, short rows padded."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in spec.columns])
    reader = spark.read.schema(schema).option("sep", spec.delimiter).option("header", spec.header).option("comment", "#").option("mode", "PERMISSIVE")
    return reader.csv(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.option("sep", delimiter).csv(path)


def bounds(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least and greatest x and y over rows that have both, in 32-bit floats."""
    kind = dict(df.dtypes)
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as float)") if kind[c] == "string" else F.col(c).cast("float")
    rows = df.select(number(x).alias("x"), number(y).alias("y")).where("x is not null and y is not null")
    return rows.agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def bounds_rectangle(df: DataFrame, x: str, y: str) -> Rectangle:
    """The open rectangle, widened by one float, that holds every point."""
    r = bounds(df, x, y).first()
    return Rectangle.of(r["x_min"], r["x_max"], r["y_min"], r["y_max"]).widened()


def domain_sizes(df: DataFrame, cats: list[str], sample: int | None = None) -> DataFrame:
    """Distinct values per categorical column, a missing one being `N/A`; of the first `sample` rows if given."""
    rows = df.select(*cats) if sample is None else df.select(*cats).limit(sample)
    return rows.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(MISSING))).alias(c) for c in cats])


def domains(df: DataFrame, cats: list[str]) -> dict[str, list[str]]:
    """Sorted values of each categorical column."""
    got = df.agg(*[F.array_sort(F.collect_set(F.coalesce(F.col(c).cast("string"), F.lit(MISSING)))).alias(c) for c in cats]).first()
    return {c: list(got[c]) for c in cats}


def synthetic(spark: SparkSession, rows: int, columns: int, cats: list[int], cardinality: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """Columns c0...: uniform on [0, 1000) with six decimals; categories are a digit before nine zeros."""
    base = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)

    def column(i: int):
        u = F.rand(seed * 1_000 + i)
        if i in cats:
            return F.concat(F.floor(u * cardinality).cast("string"), F.lit("000000000")).alias(f"c{i}")
        return F.format_string("%.6f", F.least(u * 1000, F.lit(999.999999))).alias(f"c{i}")

    return base.select(*[column(i) for i in range(columns)])


PRESETS = {
    "synth10": {"rows": 100_000_000, "columns": 10, "cats": list(range(2, 8)), "cardinality": 10},
    "synth50": {"rows": 100_000_000, "columns": 50, "cats": list(range(10, 30)), "cardinality": 10},
}


def preset(spark: SparkSession, name: str, rows: int | None = None, seed: int = 0) -> DataFrame:
    p = PRESETS[name] | ({"rows": rows} if rows is not None else {})
    return synthetic(spark, p["rows"], p["columns"], p["cats"], p["cardinality"], seed)
