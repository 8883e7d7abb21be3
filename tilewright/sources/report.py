"""Log sinks: small tables of measurements, appended as CSV."""

from __future__ import annotations

from pyspark.sql import SparkSession

_RUN = [("dataset", "string"), ("categories", "int"), ("mode", "string"), ("budget_gb", "double"), ("budget_states", "long"), ("bins", "int")]
SCHEMAS = {
    "queries": [
        *_RUN,
        *[("session", "int"), ("query_no", "int"), ("query", "string"), ("utility", "double"), ("states", "long"), ("leaf_tiles", "long")],
        *[("overlapped_tiles", "long"), ("contained_tiles", "long"), ("expanded_nodes", "long"), ("rows_scanned", "long"), ("rows_read", "long"), ("split_tiles", "long"), ("seconds", "double"), ("result", "string")],
    ],
    "initialization": [*_RUN, ("sort", "string"), ("seconds", "double"), ("utility", "double"), ("leaf_tiles", "long"), ("states", "long"), ("cube_bytes", "long"), ("points_bytes", "long")],
    "assignment": [*_RUN, ("grid", "int"), ("cardinality", "int"), ("seconds", "double"), ("utility", "double"), ("leaf_tiles", "long")],
    "utility": [*_RUN, ("utility", "double"), ("leaf_tiles", "long")],
}


def append(spark: SparkSession, kind: str, rows: list[dict], path: str) -> None:
    """Add rows to a log; each written part has a header of its own, so the log reads back as one table."""
    names = SCHEMAS[kind]
    for r in rows:
        if extra := set(r) - {n for n, _ in names}:
            raise ValueError(f"unknown columns {sorted(extra)}")
    schema = ", ".join(f"{n} {t}" for n, t in names)
    data = [tuple(r.get(n) for n, _ in names) for r in rows]
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").option("header", True).csv(path)


def read(spark: SparkSession, kind: str, path: str):
    return spark.read.option("header", True).schema(", ".join(f"{n} {t}" for n, t in SCHEMAS[kind])).csv(path)
