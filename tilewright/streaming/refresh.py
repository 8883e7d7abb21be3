"""A cube that a stream keeps up to date.

States of a group merge, whatever batches they come from, so the cube is append-only: each
micro-batch adds its own partial states, under its batch id, and readers merge them. A batch
that is run again after a failure overwrites its own folder, so nothing counts twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import direct, grid, stats
from ..plans.catalog import Layout
from ..plans.spec import DatasetSpec


def stream_cube(rows: DataFrame, spec: DatasetSpec, layout: Layout, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Start keeping (tile, categories) states of a streaming table below `path`."""
    keys = ["tile_id", *spec.cats]

    def add(batch: DataFrame, number: int) -> None:
        placed = grid.assign(direct.prepare(batch, spec), layout)
        stats.aggregate(placed, keys).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_cube(spark: SparkSession, path: str, keys: list[str], two: bool = True) -> DataFrame:
    """Metrics per `keys`, over all batches so far."""
    return stats.metrics(stats.merge(spark.read.parquet(path), keys), keys, two)


def compact(spark: SparkSession, path: str, spec: DatasetSpec, into: str) -> None:
    """One state per group, written elsewhere; readers switch to it."""
    keys = ["tile_id", *spec.cats]
    stats.merge(spark.read.parquet(path), keys).repartition(F.col("tile_id")).write.parquet(f"{into}/batch=0")
